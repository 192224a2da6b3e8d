"""Joins with a key that holds a third of the rows give what a plain join gives, in more tasks."""

import pytest
from pyspark.sql import functions as F

from cohortry.operators.skew import broadcast_checked, hot_keys, is_small, join_on, salted_join


def rows(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 90))
    return spark.range(3000).select("id", key.alias("k"))


def test_hot_keys_are_found(spark):
    found = hot_keys(rows(spark), ["k"], shares=16)
    assert [r["k"] for r in found] == ["hot"]
    assert hot_keys(rows(spark), ["k"], least=5000) == []
    assert hot_keys(rows(spark).limit(0), ["k"]) == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, how):
    left = rows(spark)
    lookup = left.select("k").distinct().where("k is null or k <> 'k7'").withColumn("v", F.length("k"))
    plain, salted = join_on(left, lookup, ["k"], how), salted_join(left, lookup, ["k"], F.col("id"), how, salts=8)
    assert plain.exceptAll(salted).count() == salted.exceptAll(plain).count() == 0
    assert salted.count() == plain.count() > 0


def test_array_keys_can_be_hot(spark):
    left = spark.range(300).select("id", F.when(F.col("id") % 2 == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("id").cast("int"))).alias("bits"))
    lookup = left.groupBy("bits").agg(F.min("id").alias("rep"))
    got = salted_join(left, lookup, ["bits"], F.col("id"), salts=4)
    assert got.count() == 300 and got.where("id % 2 = 0 and rep <> 0").count() == 0


def test_hot_rows_reach_several_tasks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        lookup = rows(spark).select("k").distinct().withColumn("v", F.lit(1))
        tasks = lambda df: df.where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks(join_on(rows(spark), lookup, ["k"])) == 1
        assert tasks(salted_join(rows(spark), lookup, ["k"], F.col("id"))) > 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_size_checks(spark):
    assert is_small(spark.range(10), 10) and not is_small(spark.range(11), 10)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    assert hinted(broadcast_checked(spark.range(10), 10)) and not hinted(broadcast_checked(spark.range(11), 10))


def test_bytes_count_as_well_as_rows(spark):
    wide = spark.range(10).select("id", F.array_repeat(F.lit(1.0), 1_000).alias("v"), F.repeat(F.lit("x"), 500).alias("t"))
    assert is_small(wide, 10, 100_000) and not is_small(wide, 10, 80_000)
    nested = spark.range(2).select(
        F.array(F.struct(F.lit("abc").alias("a"), F.lit(None).cast("string").alias("b"))).alias("s"),
        F.create_map(F.lit("k"), F.array(F.lit("v"))).alias("m"), F.lit(None).cast("array<string>").alias("n"), F.lit(1).alias("_bytes"),
    )
    assert is_small(nested, 2) and not is_small(nested, 2, 50) and is_small(nested.limit(0), 0, 0)
