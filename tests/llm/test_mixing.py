import math

import pytest
from pyspark.sql import functions as F

from cohortry.llm.mixing import MixSpec, bisect_exponent, mix

SCHEMA = "doc_id bigint, source string, text string"


def documents(spark, sizes):
    rows, doc = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((doc, source, "a b c d"))
            doc += 1
    return spark.createDataFrame(rows, SCHEMA)


def test_repetition_limit_and_whole_sources(spark):
    docs = documents(spark, {"large": 200, "middle": 50, "small": 10})
    copies = mix(docs, MixSpec(repetition_limit=3.0)).groupBy("source", "doc_id").count()
    rows = {r["source"]: r for r in copies.groupBy("source").agg(F.min("count").alias("least"), F.max("count").alias("most"), F.sum("count").alias("all"), F.count("*").alias("n")).collect()}
    assert {s: r["n"] for s, r in rows.items()} == {"large": 200, "middle": 50, "small": 10}
    assert rows["large"]["all"] == 200
    assert rows["small"]["most"] <= 3
    assert rows["small"]["all"] / 10 > rows["middle"]["all"] / 50 > 1
    exponent = 1 - math.log(3) / math.log(20)
    assert rows["middle"]["all"] == pytest.approx(200 ** (1 - exponent) * 50**exponent, abs=1)


@pytest.mark.parametrize("share", [0.3, 0.7])
def test_entropy_is_met(spark, share):
    n = [1000, 100, 10]
    sources = spark.createDataFrame([(str(i), x) for i, x in enumerate(n)], "_source string, _n bigint")
    entropy = lambda a: -sum(p * math.log(p) for p in [x**a / sum(y**a for y in n) for x in n])
    target = entropy(1) + share * (entropy(0) - entropy(1))
    found = bisect_exponent(sources, MixSpec(repetition_limit=None, target_entropy=target))
    assert entropy(found) == pytest.approx(target, abs=1e-6)


def test_budget_cuts_by_blocks(spark):
    docs = documents(spark, {"a": 100, "b": 100})
    mixed = mix(docs, MixSpec(budget=400, repetition_limit=1.0))
    assert mixed.count() == 100
    assert mixed.groupBy("source").count().where("count <> 50").count() == 0
    with pytest.raises(ValueError):
        mix(docs, MixSpec(budget=10_000, repetition_limit=2.0))


def test_edge_cases(spark):
    rows = [(1, "s", "a b"), (1, "s", "a b"), (None, "s", "c"), (2, None, "x y z"), (3, "empty", ""), (4, "empty", None), (5, "s", "w " * 50_000)]
    mixed = mix(spark.createDataFrame(rows, SCHEMA).withColumn("_source", F.lit(1)).withColumn("epoch", F.lit("x")))
    assert mixed.columns == ["doc_id", "source", "text", "_source", "epoch", "block", "place"]
    found = mixed.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()
    assert {(r["doc_id"], r["source"]) for r in found} == {(1, "s"), (None, "s"), (2, None), (3, "empty"), (4, "empty"), (5, "s")}
    assert {r["doc_id"]: r["n"] for r in found if r["source"] == "empty"} == {3: 1, 4: 1}
    assert next(r["n"] for r in found if r["doc_id"] == 1) % 2 == 0
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
