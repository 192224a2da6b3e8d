"""Registered corpus queries: against their SQL, and held-out accuracy where SQL cannot say."""

import pytest
from pyspark.sql import functions as F

from check import compare, connection
from cohortry.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_matches_sql_and_multiplies_nothing(spark, con, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan
    result = compare(spark, con, SF_DIR, name, df)
    assert result.startswith(("ok", "rows-only")), result


def test_every_operator_has_one_query():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")]
    assert sorted(numbers) == list(range(1, 14))
    assert "pipeline" in queries.QUERIES


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found = queries.QUERIES["op5_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out and toxic is not null")
    row = found.agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("caught"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrong")
    ).first()
    assert row["caught"] > 0.85
    assert row["wrong"] < 0.03
