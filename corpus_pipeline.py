"""A corpus pipeline: from documents to token files, one operator a stage.

1. toxicity: documents at or over the toxicity threshold of their language go;
2. n-gram Jaccard join: one document of each group of near copies stays;
3. benchmark decontamination: documents that hold a benchmark window go;
4. mixing sources to target weights: small sources repeat, up to twice; none is cut;
5. token-ID output: the mix is tokenised, Huffman-coded, written and read back.

Every stage gets what its predecessor kept. All but the last return the columns of
``documents``, whatever they are; extra columns ride along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortry.llm import decontaminate, jaccard_join, mixing, token_output, toxicity
from cohortry.llm.shared import table, written

END_ID = 2
#: Workers come here from other stages, so they encode less at once and keep less (bytes).
ENCODED, KNOWN = 2_000_000, 100_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, toxicity.learnable(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).where("not toxic").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = token_output.write_tokens(
        docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, encoded=ENCODED, known=KNOWN
    )
    return token_output.read_tokens(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_output", write_token_files),
]

#: SQL cannot express the classifier; the tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
