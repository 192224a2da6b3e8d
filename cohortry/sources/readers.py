"""Readers: noisy delimited text, headered CSV, vector tables, nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.operators.contracts import enforce


def parse_delimited(lines: DataFrame, columns: list[str], key_regex: str, delimiter: str = "\t", line: str = "value") -> DataFrame:
    """Records from text lines: exactly the right number of fields and a key that matches; other lines drop."""
    fields = F.split(F.col(line), f"\\Q{delimiter}\\E", -1)
    kept = lines.select(fields.alias("_f")).where(
        (F.size("_f") == len(columns)) & F.col("_f")[0].rlike(f"^(?:{key_regex})$")
    )
    return kept.select(*[F.col("_f")[i].alias(name) for i, name in enumerate(columns)])


def read_delimited(spark: SparkSession, path: str, columns: list[str], key_regex: str, delimiter: str = "\t") -> DataFrame:
    return parse_delimited(spark.read.text(path), columns, key_regex, delimiter)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Headered CSV with a declared schema; ids never become numbers by inference."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def vector_length_violations(df: DataFrame, dimension: int, vec: str = "vec") -> DataFrame:
    return df.where(F.col(vec).isNull() | (F.size(vec) != dimension))


def read_vectors(spark: SparkSession, path: str, dimension: int | None = None, id: str = "id", vec: str = "vec") -> DataFrame:
    """Ids with their vectors; with ``dimension`` given, every vector must have it."""
    df = spark.read.parquet(path).select(id, vec)
    if dimension is not None:
        enforce(vector_length_violations(df, dimension, vec).select(id), "vectors of another length")
    return df


TUNING_SCHEMA = (
    "model string, repeat int, outer_fold int, selected_c double, "
    "candidates array<struct<c: double, inner_auroc: double, convergence_warnings: int>>"
)


def read_tuning_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per fit and candidate from nested JSON records."""
    return explode_candidates(spark.read.schema(TUNING_SCHEMA).json(path))


def explode_candidates(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return log.select(*(keys or ["model", "repeat", "outer_fold", "selected_c"]), F.inline("candidates"))
