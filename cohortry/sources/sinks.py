"""Writers that leave a summary beside the data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortry.session import cut_lineage


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        cut_lineage(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def write_with_summary(df: DataFrame, path: str, label: str | None = None, mode: str = "errorifexists") -> dict:
    """Write Parquet and count rows and missing labels in the same job; label counts go to ``<path>.summary``."""
    observed = Observation()
    missing = F.count_if(F.col(label).isNull()) if label else F.lit(0)
    df.observe(observed, F.count(F.lit(1)).alias("rows"), missing.alias("missing_labels")).write.mode(mode).parquet(path)
    summary = dict(observed.get)
    if label:
        counts = df.sparkSession.read.parquet(path).groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
        counts.write.mode(mode).json(f"{path}.summary")
    return summary


def write_vectors(df: DataFrame, path: str, id: str = "id", vec: str = "vec", mode: str = "errorifexists") -> None:
    """Ids and vectors as zstd Parquet, in a layout ``read_vectors`` takes back."""
    df.select(F.col(id).alias("id"), F.col(vec).alias("vec")).write.mode(mode).option("compression", "zstd").parquet(path)


def write_draws(draws: DataFrame, path: str, analysis: str, value: str = "delta", mode: str = "append") -> None:
    """Every resample's statistic, kept under the name of its analysis."""
    draws.select(F.lit(analysis).alias("analysis"), "resample", F.col(value).alias("stat")).write.mode(mode).partitionBy(
        "analysis"
    ).parquet(path)
