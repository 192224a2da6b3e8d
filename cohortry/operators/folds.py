"""Repeated folds that keep groups whole and classes balanced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.hashing import hash_cell, stable_hash
from cohortry.operators.contracts import enforce
from cohortry.operators.prefix import CELL, default_cells, numbered
from cohortry.operators.skew import salted_join

MIX_STEPS = 4


def snake(position: Column, k: int) -> Column:
    """Fold of the position in a deal that runs forwards, then backwards."""
    lap, place = F.floor(position / k), position % k
    return F.when(lap % 2 == 0, place).otherwise(k - 1 - place).cast("int")


def seed_column(seeds: list[int], repeat: str = "repeat") -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in seeds]), F.col(repeat) + 1)


def group_sizes(df: DataFrame, keys: list[str], group: str, outcome: str) -> DataFrame:
    return df.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n"), F.sum(outcome).alias("_pos"))


def deal_groups(sizes: DataFrame, keys: list[str], group: str, k: int, seed: Column) -> DataFrame:
    """Fold per keys and group from the group sizes, which stay beside it.

    Groups are dealt in a snake from large to small (by powers of two), within a size from
    mostly positive to mostly negative, and in seeded order within that. The deal numbers
    groups over cells of (size, mix, hash), so no key is ordered in one task.
    """
    bucket = 63 - F.floor(F.log2(F.col("_n").cast("double")) + 1e-9).cast("int")
    mix = MIX_STEPS - F.round(F.col("_pos") * F.lit(float(MIX_STEPS)) / F.col("_n")).cast("int")
    hashed = sizes.withColumns({"_stratum": bucket * (MIX_STEPS + 1) + mix, "_h": stable_hash(seed, group)})
    cells = default_cells(sizes)
    width = 1 << max(1, (cells - 1).bit_length())
    celled = hashed.withColumn(CELL, F.col("_stratum") * width + hash_cell(F.col("_h"), cells))
    dealt = numbered(celled, keys, [F.col("_stratum"), F.col("_h"), F.col(group)])
    return dealt.select(*keys, group, snake(F.col("row_no") - 1, k).alias("fold"), "_n", "_pos")


def repeated(df: DataFrame, repeats: int, name: str = "repeat") -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias(name))


def stratified_group_folds(
    df: DataFrame,
    k: int,
    seeds: list[int],
    group: str = "group_id",
    outcome: str = "outcome",
    id: str = "id",
    check: bool = True,
) -> DataFrame:
    """Fold of each row and repeat, one repeat per seed: (id, group, repeat, fold). Groups stay whole.

    A fold without both outcome classes is an error; it is looked for in the group table.
    """
    # sizes do not depend on the repeat, so groups are counted once and dealt per repeat
    sizes = group_sizes(df, [], group, outcome)
    deals = deal_groups(repeated(sizes, len(seeds)), ["repeat"], group, k, seed_column(seeds))
    if check:
        enforce(dealt_violations(deals, ["repeat"], k), "folds need both outcome classes")
    # one row per group carries its folds of all repeats, so rows are joined once and multiplied after
    folds = deals.groupBy(group).agg(F.collect_list(F.struct("repeat", "fold")).alias("_folds"))
    joined = salted_join(df.select(id, group, outcome), folds, [group], F.col(id))
    return joined.select(id, group, outcome, F.inline("_folds"))


def stratified_folds(
    df: DataFrame, k: int, seeds: list[int], outcome: str = "outcome", id: str = "id", group: str = "group_id"
) -> DataFrame:
    """Row folds with balanced classes that ignore groups; the true group stays beside them."""
    rows = repeated(df.select(id, group, outcome), len(seeds)).withColumn("_h", stable_hash(seed_column(seeds), id))
    celled = rows.withColumn(CELL, hash_cell(F.col("_h"), default_cells(df)))
    placed = numbered(celled, ["repeat", outcome], [F.col("_h"), F.col(id)])
    return placed.select(id, group, outcome, "repeat", ((F.col("row_no") - 1) % k).cast("int").alias("fold"))


def dealt_violations(deals: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The problems ``fold_violations`` finds, read off dealt groups instead of rows."""
    per_fold = deals.groupBy(*keys, "fold").agg(F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos"))
    per_fold = per_fold.withColumn("_one", (F.col("_pos") == 0) | (F.col("_pos") == F.col("_n")))
    return _fold_problems(per_fold, keys, k, "fold")


def _fold_problems(per_fold: DataFrame, keys: list[str], k: int, fold: str) -> DataFrame:
    one_class = per_fold.where("_one").select(*keys, F.col(fold), F.lit("one_class").alias("problem"))
    short = per_fold.groupBy(*keys).agg(F.count(F.lit(1)).alias("_f")).where(F.col("_f") != k)
    return one_class.unionByName(short.select(*keys, F.lit(None).cast("int").alias(fold), F.lit("empty_folds").alias("problem")))


def fold_violations(folds: DataFrame, keys: list[str], k: int, fold: str = "fold", outcome: str = "outcome") -> DataFrame:
    """Folds that lack an outcome class, and keys that do not fill all k folds."""
    per_fold = folds.groupBy(*keys, fold).agg((F.min(outcome) == F.max(outcome)).alias("_one"))
    return _fold_problems(per_fold, keys, k, fold)


def fold_profile(folds: DataFrame, keys: list[str], fold: str = "fold", outcome: str = "outcome") -> DataFrame:
    """Rows and positives per fold."""
    return folds.groupBy(*keys, fold).agg(F.count(F.lit(1)).alias("rows"), F.sum(outcome).alias("positives"))
