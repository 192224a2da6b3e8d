"""Scans read the columns and rows a query needs."""

import __spark_entry__ as entry_points

SF_DIR = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_needed(spark):
    plan = physical(entry_points.queries()["x1_auroc"](spark, SF_DIR))
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "o_totalprice" not in scan and "o_custkey" not in scan and "o_orderdate" not in scan


def test_filters_reach_the_scan(spark):
    plan = physical(entry_points.queries()["p5_population"](spark, SF_DIR))
    assert "PushedFilters: [" in plan and "o_orderpriority" in plan.split("PushedFilters")[1]
