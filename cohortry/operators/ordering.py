"""Sampling, sequences and shares that depend on a total order, without a one-task sort."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.hashing import hash_cell, stable_hash
from cohortry.operators.contracts import enforce
from cohortry.operators.prefix import (
    CELL, default_cells, numbered, running_sums, score_splits, with_score_cells,
)
from cohortry.operators.skew import join_on


def hash_sample(df: DataFrame, fraction: float, seed: int, id: str = "id") -> DataFrame:
    """Exactly max(1, ceil(fraction x rows)) rows, the ones with the smallest seeded hash.

    Counts per hash cell show which cell holds the last sampled row. Rows of the cells below
    it pass a filter, without a shuffle; only the rows of that one cell are ordered.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    hashed = df.withColumns({"_h": stable_hash(seed, id), CELL: hash_cell(stable_hash(seed, id), default_cells(df))})
    # as many rows as there are cells
    counts = sorted((r[CELL], r["count"]) for r in hashed.groupBy(CELL).count().collect())
    left = max(1, math.ceil(sum(n for _, n in counts) * fraction))
    for cell, n in counts:
        if n >= left:
            break
        left -= n
    else:
        return df
    below, at = hashed.where(F.col(CELL) < cell), hashed.where(F.col(CELL) == cell)
    placed = at.withColumn("_no", F.row_number().over(Window.partitionBy(CELL).orderBy("_h", id)))
    return below.select(*df.columns).unionByName(placed.where(F.col("_no") <= left).select(*df.columns))


def review_packets(
    df: DataFrame, fraction: float, seed: int, id: str = "id", columns: list[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All exclusions, a sample of the inclusions, and the counts of both."""
    wanted = [c for c in (columns or df.columns) if c in df.columns]
    exclusions = df.where(~F.col("eligibility")).select(*wanted)
    eligible = df.where("eligibility").select(*wanted)
    routine = hash_sample(eligible, fraction, seed, id).orderBy(id)
    counts = df.agg(
        F.count_if(~F.col("eligibility")).alias("exclusion_rows"),
        F.count_if(F.col("eligibility")).alias("inclusion_population"),
    ).withColumn(
        "sample_rows",
        F.when(F.col("inclusion_population") > 0, F.greatest(F.lit(1), F.ceil(F.col("inclusion_population") * float(fraction))))
        .otherwise(0).cast("bigint"),
    ).withColumns({"fraction": F.lit(float(fraction)), "seed": F.lit(seed)})
    return exclusions, routine, counts


def integer_islands(df: DataFrame, value: str = "value") -> DataFrame:
    """Maximal runs of consecutive integers as (start_value, end_value, members)."""
    distinct = df.select(value).where(F.col(value).isNotNull()).distinct()
    celled = with_score_cells(distinct, value, score_splits(distinct, value))
    placed = numbered(celled, [], [F.col(value)])
    return (
        placed.groupBy((F.col(value) - F.col("row_no")).alias("_island"))
        .agg(F.min(value).alias("start_value"), F.max(value).alias("end_value"), F.count(F.lit(1)).alias("members"))
        .drop("_island")
    )


def integer_holes(df: DataFrame, value: str = "value") -> DataFrame:
    """Maximal runs of absent integers between the least and the greatest one present.

    Each value looks at the next one; past the end of a cell that is the least value
    of the next filled cell, read from the small cell table.
    """
    distinct = df.select(value).where(F.col(value).isNotNull()).distinct()
    celled = with_score_cells(distinct, value, score_splits(distinct, value))
    following = Window.partitionBy(F.lit(0)).orderBy(CELL)
    starts = celled.groupBy(CELL).agg(F.min(value).alias("_least")).select(
        CELL, F.lead("_least").over(following).alias("_next_cell")
    )
    within = Window.partitionBy(CELL).orderBy(value)
    stepped = join_on(celled, starts, [CELL]).withColumn(
        "_next", F.coalesce(F.lead(value).over(within), F.col("_next_cell"))
    )
    return stepped.where(F.col("_next") > F.col(value) + 1).select(
        (F.col(value) + 1).alias("start_value"), (F.col("_next") - 1).alias("end_value")
    ).withColumn("missing", F.col("end_value") - F.col("start_value") + 1)


def groups_to_target(df: DataFrame, group: str, seed: int, target: int | None = None) -> DataFrame:
    """Whole groups in seeded order until at least ``target`` rows; the crossing group is taken.

    The default target is half of the rows, rounded down.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows")).withColumn("_h", stable_hash(seed, group))
    celled = sizes.withColumn(CELL, hash_cell(F.col("_h"), default_cells(df)))
    placed = running_sums(celled, [], [F.col("_h"), F.col(group)], {"upto": F.col("rows")}, totals=True)
    goal = F.floor(F.col("upto_total") / 2) if target is None else F.lit(target)
    prior = F.col("upto") - F.col("rows")
    # the first group is always taken, as the loop tests the target after adding one
    return placed.where((prior < goal) | (prior == 0)).select(group, "rows", "upto")


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


def running_share(counts: DataFrame, rows: str, order: list[str]) -> DataFrame:
    """Start and end share of each category along ``order``, of the total.

    Takes the counts of categories, one row each. ``order`` starts with a number, which
    cuts the categories into cells, so many categories do not meet in one task.
    """
    celled = with_score_cells(counts, order[0], score_splits(counts, order[0]))
    placed = running_sums(celled, [], [F.col(c) for c in order], {"_upto": F.col(rows)}, totals=True)
    total = F.col("_upto_total").cast("double")
    return placed.withColumns(
        {"share_start": (F.col("_upto") - F.col(rows)) / total, "share_end": F.col("_upto") / total}
    ).drop("_upto", "_upto_total", CELL)


def order_differences(operator, df: DataFrame, id: str = "id", partitions: int = 7) -> DataFrame:
    """Rows an operator gives for the input as it is or for a reshuffled copy, but not for both."""
    first = operator(df)
    second = operator(df.repartition(partitions, F.xxhash64(id)).sortWithinPartitions(F.col(id).desc()))
    return first.exceptAll(second).unionByName(second.exceptAll(first))


def assert_order_invariant(operator, df: DataFrame, id: str = "id", partitions: int = 7) -> None:
    enforce(order_differences(operator, df, id, partitions), "result depends on input order")
