"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from check import compare, connection

SF_DIR = "/root/testdata/sf0.001"
# The corpus operators have tests of their own.
NAMES = [n for n in entry_points.queries() if n not in entry_points.CORPUS_QUERIES]


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql_without_cross_joins(spark, con, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan
    result = compare(spark, con, SF_DIR, name, df)
    assert result.startswith(("ok", "rows-only")), result


def test_entry_gives_one_answer(spark):
    row = entry_points.entry(spark).collect()
    assert len(row) == 1
    assert row[0]["ci_lower"] <= row[0]["ci_upper"]
