"""Every stage against a brute-force version on its own input."""

import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortry.llm.jaccard_join import ForestSpec
from cohortry.llm.shared import written
from tests.llm.test_decontaminate import words
from tests.llm.test_jaccard_join import brute

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert [re.sub("_.*", "", n) for n in stages] == ["toxicity", "ngram", "benchmark", "source", "token"]

    clean = written(stages["toxicity"](spark, docs, SF_DIR))
    assert clean.columns == columns and 0.8 * docs.count() < clean.count() <= docs.count()
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    wrongly = docs.join(clean, "doc_id", "left_anti").join(labels.where("toxic = 0"), "doc_id").count()
    assert wrongly <= 0.05 * labels.where("toxic = 0").count()

    single = written(stages["ngram_jaccard_join"](spark, clean, SF_DIR))
    groups = brute([(r["doc_id"], r["text"]) for r in clean.collect()], ForestSpec())
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({c for _, c in groups.values()})
    assert single.columns == columns

    apart = written(stages["benchmark_decontamination"](spark, single, SF_DIR))
    windows = set()
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    holds = lambda w: any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(r["doc_id"] for r in single.collect() if not holds(words(r["text"])))

    mixed = written(stages["source_mixing"](spark, apart, SF_DIR))
    assert mixed.columns == columns
    copies = mixed.groupBy(*columns).count()
    assert copies.exceptAll(copies.where("count between 1 and 3")).count() == 0
    assert mixed.select("doc_id").distinct().count() == apart.count()
    shares = {r["source"]: r["n"] for r in apart.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    taken = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    assert taken[max(shares, key=shares.get)] == max(shares.values())
    assert all(taken[s] >= shares[s] for s in shares)

    last = sorted(stages["token_output"](spark, mixed, SF_DIR).collect(), key=lambda r: r["start"])
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r["doc_id"], r["text"]) for r in mixed.collect())
    assert [r["doc_id"] for r in last] == [d for d, _ in want]
    place = 0
    for row, (_, text) in zip(last, want):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        assert (row["start"], row["n_tokens"]) == (place, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        place += len(ids)


def test_stages_take_odd_rows(spark):
    rows = [
        (1, None, None, None, None), (None, "words here to keep", "en", "s", 4), (None, None, None, None, None), (2, "", "xx", None, 0),
        (3, "w " * 50_000, "de", "s", 7), (4, "same text", "en", "t", 9), (4, "same text", "en", "t", 9), (5, "same text", None, "t", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("_id", F.lit(1)).withColumn("place", F.lit("p"))
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, SF_DIR))
            if name != "token_output" and name != "source_mixing":
                assert now.columns == start.columns
        if start is docs:
            assert {r["doc_id"] for r in now.collect()} == {1, None, 2, 3, 4}
        else:
            assert now.count() == 0
