"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cohortry.llm import centroid_clusters, decontaminate, embedding_dedup, html_extract, jaccard_join, language_id, line_dedup, merkle_manifest, mixing, personal_data, suffix_dedup, token_output, toxicity
from cohortry.llm.shared import remainder, table


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    tokens = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("bigint")
    return mixed.select("doc_id", "source", tokens.alias("n_tokens"), "epoch", "block", "place")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(language_id.learnable(docs))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    held_out = remainder(F.col("doc_id"), 4) == 2
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def decontaminate_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 with the proximity matches, which its SQL does not have, behind its columns."""
    return _matches(decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=decontaminate.NEAR), "near_items")


def _matches(found: DataFrame, *more: str) -> DataFrame:
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), *more,
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    found = toxicity.score(docs.select("doc_id", "text"), model)
    held_out = remainder(F.col("doc_id"), 3) == 1
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.TARGET).cast("int").alias("predicted"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents")).drop("n_rows")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_output.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_output.read_tokens(spark, path)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle_manifest.proofs(merkle_manifest.hashed(docs, merkle_manifest.lowered(docs))).withColumnRenamed("key", "doc_id")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.find(docs, personal_data.fit(docs))
    own = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[number(kind) for kind in personal_data.KINDS],
        F.sha2(personal_data.joined(own), 256).alias("base_sha256"), personal_data.joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(own)).cast("bigint").alias("n_added"),
    )


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.cluster(table(spark, sf_dir, "embeddings"))[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_decontaminate": op4_decontaminate,
    "decontaminate_near": decontaminate_near,
    "op5_toxicity": op5_toxicity,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_html_extract": op7_html_extract,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_token_output": op9_token_output,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_personal_data": op12_personal_data,
    "op13_centroid_clusters": op13_centroid_clusters,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op1_source_mixing": mixing.SQL,
    "op2_line_dedup": line_dedup.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op6_jaccard_join": jaccard_join.SQL,
    "op8_embedding_dedup": embedding_dedup.SQL,
    "op11_merkle_manifest": merkle_manifest.SQL,
    "op13_centroid_clusters": centroid_clusters.SQL,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
