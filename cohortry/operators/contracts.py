"""Table contracts. Each returns its violations as rows; an empty result means the table passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.hashing import HEX_DIGITS
from cohortry.operators.skew import join_on, salted_join, whole_row


class ContractError(ValueError):
    """A table broke its contract."""


def enforce(violations: DataFrame, message: str, shown: int = 5) -> None:
    """Raise when there is any violation, naming the first few."""
    found = violations.limit(shown).collect()
    if found:
        raise ContractError(f"{message}: {[row.asDict() for row in found]}")


def literal_rows(spark: SparkSession, dims: dict[str, list]) -> DataFrame:
    """Every combination of the given values; for parameters, not for data."""
    rows = spark.range(1).drop("id")
    for name, values in dims.items():
        rows = rows.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return rows


def _problems(**checks: Column) -> Column:
    """The names of the checks that hold, as an array without NULLs."""
    named = F.array(*[F.when(condition, F.lit(name)) for name, condition in checks.items()])
    return F.filter(named, lambda name: name.isNotNull())


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once or hold a NULL."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn(
        "problem", F.explode(_problems(duplicate=F.col("rows") > 1, missing=missing))
    )


def count_violations(df: DataFrame, column: str, expected: dict[str, int], total: int) -> DataFrame:
    """Where the row total or the histogram of ``column`` differs from what was promised."""
    spark = df.sparkSession
    found = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("found"))
    promised = spark.createDataFrame(list(expected.items()), "value string, expected bigint")
    # the histogram and its total come from the same grouped count
    with_total = found.unionByName(
        found.agg(F.lit("(total)").alias("value"), F.coalesce(F.sum("found"), F.lit(0)).alias("found"))
    )
    promised = promised.unionByName(spark.createDataFrame([("(total)", total)], "value string, expected bigint"))
    both = with_total.alias("f").join(promised.alias("p"), F.col("f.value").eqNullSafe(F.col("p.value")), "full_outer")
    return both.select(
        F.coalesce("f.value", "p.value").alias("value"),
        F.coalesce("p.expected", F.lit(0)).alias("expected"),
        F.coalesce("f.found", F.lit(0)).alias("found"),
    ).where("expected <> found")


def set_diff(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Ids on one side only, from one shuffle of both sides together."""
    sides = left.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    seen = sides.groupBy(key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return seen.where("_l <> _r").select(key, F.when(F.col("_l") == 1, "left").otherwise("right").alias("only_in"))


def partition_violations(
    full: DataFrame, parts: dict[str, DataFrame], key: str = "id", label: str | None = None,
    labels: dict[str, str] | None = None,
) -> DataFrame:
    """Where the parts fail to split ``full`` exactly: repeats, overlaps, gaps, strangers, wrong labels.

    With ``label`` every row of part ``p`` must carry the value ``labels[p]``.
    """
    def tagged(df: DataFrame, name: str) -> DataFrame:
        wrong = F.lit(0)
        if label and name != "full":
            wrong = F.when(F.col(label).eqNullSafe(F.lit(labels[name])), 0).otherwise(1)
        return df.select(key, F.lit(name).alias("_part"), wrong.alias("_wrong"))

    rows = reduce(DataFrame.unionByName, [tagged(full, "full"), *[tagged(df, name) for name, df in parts.items()]])
    in_part = F.col("_part") != "full"
    per_part = rows.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.max("_wrong").alias("_wrong"))
    seen = per_part.groupBy(key).agg(
        F.max("_n").alias("_most"),
        F.max("_wrong").alias("_wrong"),
        F.count_if(~in_part).alias("_full"),
        F.count_if(in_part).alias("_parts"),
    )
    problems = _problems(
        repeated=F.col("_most") > 1,
        overlap=F.col("_parts") > 1,
        uncovered=(F.col("_full") > 0) & (F.col("_parts") == 0),
        stranger=F.col("_full") == 0,
        wrong_label=F.col("_wrong") > 0,
    )
    return seen.select(key, F.explode(problems).alias("problem"))


def reconcile(requested: DataFrame, succeeded: DataFrame, failed: DataFrame, key: str = "id") -> DataFrame:
    """Requested ids must each have exactly one outcome: one success or one failure record."""
    def tagged(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, *[F.lit(int(name == n)).alias(n) for n in ("_req", "_ok", "_bad")])

    rows = tagged(requested, "_req").unionByName(tagged(succeeded, "_ok")).unionByName(tagged(failed, "_bad"))
    seen = rows.groupBy(key).agg(*[F.sum(n).alias(n) for n in ("_req", "_ok", "_bad")])
    problems = _problems(
        repeated_request=F.col("_req") > 1,
        not_requested=F.col("_req") == 0,
        no_outcome=(F.col("_ok") == 0) & (F.col("_bad") == 0),
        both_outcomes=(F.col("_ok") > 0) & (F.col("_bad") > 0),
        repeated_success=F.col("_ok") > 1,
        repeated_failure=F.col("_bad") > 1,
    )
    return seen.select(key, F.explode(problems).alias("problem"))


def split_groups(folds: DataFrame, group: str, repeat: str, fold: str) -> DataFrame:
    """Groups whose rows lie in more than one fold of a repeat."""
    spans = folds.groupBy(group, repeat).agg(F.min(fold).alias("lowest_fold"), F.max(fold).alias("highest_fold"))
    return spans.where("lowest_fold <> highest_fold")


def long_folds(wide: DataFrame, ids: list[str], prefix: str) -> DataFrame:
    """Turn one fold column per repeat into rows (ids, repeat, fold)."""
    columns = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot(ids, columns, "_column", "fold")
    return long.withColumn("repeat", F.substring("_column", F.lit(len(prefix) + 1), F.length("_column")).cast("int")).drop("_column")


def pairing_violations(
    df: DataFrame, keys: list[str], model: str, models: list[str], outcome: str, group: str
) -> DataFrame:
    """Keys where a model is missing, or where the models disagree on outcome or group."""
    paired = df.where(F.col(model).isin(models))
    seen = paired.groupBy(*keys).agg(
        F.size(F.collect_set(model)).alias("_models"),
        F.min(outcome).alias("_y0"), F.max(outcome).alias("_y1"), F.count(outcome).alias("_ys"),
        F.min(group).alias("_g0"), F.max(group).alias("_g1"),
    )
    problems = _problems(
        unpaired=F.col("_models") < len(models),
        outcomes_differ=(F.col("_y0") != F.col("_y1")) | (F.col("_ys") == 0),
        groups_differ=F.col("_g0") != F.col("_g1"),
    )
    return seen.select(*keys, F.explode(problems).alias("problem"))


def assignment_mismatches(df: DataFrame, reference: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows whose values differ from the reference table's, or that it does not know."""
    renamed = reference.select(*keys, *[F.col(c).alias(f"expected_{c}") for c in columns])
    joined = join_on(df.select(*keys, *columns), renamed, keys, "left")
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"expected_{c}")) for c in columns])
    return joined.where(differs)


def grid_gaps(df: DataFrame, dims: dict[str, list]) -> DataFrame:
    """Cells of the full grid that are missing or repeated, and rows outside the grid."""
    keys = list(dims)
    observed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    grid = literal_rows(df.sparkSession, dims)
    for key in keys:
        grid = grid.withColumn(key, F.col(key).cast(df.schema[key].dataType))
    tagged = observed.withColumn("_expected", F.lit(0)).unionByName(
        grid.withColumns({"_n": F.lit(0).cast("bigint"), "_expected": F.lit(1)})
    )
    seen = tagged.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.max("_expected").alias("_expected"))
    problems = _problems(
        missing=(F.col("_expected") == 1) & (F.col("rows") == 0),
        repeated=F.col("rows") > 1,
        outside=F.col("_expected") == 0,
    )
    return seen.select(*keys, "rows", F.explode(problems).alias("problem"))


def _finite(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(column) & (F.abs(F.col(column)) != F.lit(float("inf")))


def prediction_violations(
    df: DataFrame,
    ids: DataFrame,
    models: list[str],
    repeats: int | None,
    release_value: str,
    numeric: list[str],
    id: str = "id",
    model: str = "model",
    repeat: str = "repeat",
    outcome: str = "outcome",
    score: str = "probability",
    release: str = "release",
) -> DataFrame:
    """Failed checks of a prediction table with the number of offending rows, ids or cells.

    Column presence is checked at once; the rest is one pass over the rows, one count
    per key and one comparison of id sets.
    """
    needed = {id, model, outcome, score, release, *numeric} | ({repeat} if repeats else set())
    absent = sorted(needed - set(df.columns))
    if absent:
        raise ContractError(f"missing columns: {absent}")
    one = F.lit(1)
    checks = {
        "model_unknown": F.coalesce(~F.col(model).isin(models), F.lit(True)),
        "release_wrong": ~F.col(release).eqNullSafe(F.lit(release_value)),
        "not_finite": ~reduce(lambda a, b: a & b, [_finite(c) for c in numeric]),
        "score_out_of_range": F.coalesce(~F.col(score).between(0, 1), F.lit(True)),
        "outcome_not_binary": F.coalesce(~F.col(outcome).isin(0, 1), F.lit(True)),
    }
    if repeats:
        checks["repeat_unknown"] = F.coalesce(~F.col(repeat).isin(list(range(repeats))), F.lit(True))
    names = list(checks)
    row_checks = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    keys = [id, model] + ([repeat] if repeats else [])
    per_key = df.groupBy(*keys).agg(F.count(one).alias("_n"))
    duplicates = per_key.agg(F.count_if(F.col("_n") > 1).alias("duplicate_key"))
    seen_ids = per_key.groupBy(id).agg(F.count(one).alias("_cells"))
    coverage = (
        seen_ids.withColumn("_w", F.lit(0))
        .unionByName(ids.select(id).distinct().withColumns({"_cells": F.lit(0).cast("bigint"), "_w": F.lit(1)}))
        .groupBy(id)
        .agg(F.sum("_cells").alias("_cells"), F.sum("_w").alias("_w"))
        .agg(
            F.count_if((F.col("_w") == 1) & (F.col("_cells") == 0)).alias("id_missing"),
            F.count_if(F.col("_w") == 0).alias("id_unknown"),
            F.count_if((F.col("_w") == 1) & (F.col("_cells") > 0)
                       & (F.col("_cells") != len(models) * (repeats or 1))).alias("cells_incomplete"),
        )
    )
    long = [
        frame.unpivot([], columns, "problem", "violations")
        for frame, columns in (
            (row_checks, names),
            (duplicates, ["duplicate_key"]),
            (coverage, ["id_missing", "id_unknown", "cells_incomplete"]),
        )
    ]
    return reduce(DataFrame.unionByName, long).where("violations > 0")


def estimation_violations(
    df: DataFrame,
    keys: list[str],
    models: list[str],
    numeric: list[str],
    id: str = "id",
    model: str = "model",
    outcome: str = "outcome",
    score: str = "probability",
    group: str = "group_id",
) -> DataFrame:
    """What would make a paired estimate unsound, counted per problem.

    ``keys`` are the columns besides the model that identify a prediction.
    """
    rows = df.agg(
        F.count_if(~reduce(lambda a, b: a & b, [_finite(c) for c in numeric])).alias("not_finite"),
        F.count_if(F.coalesce(~F.col(score).between(0, 1), F.lit(True))).alias("score_out_of_range"),
    ).unpivot([], ["not_finite", "score_out_of_range"], "problem", "violations")
    repeated = key_violations(df, [*keys, model]).groupBy("problem").agg(F.count(F.lit(1)).alias("violations"))
    unpaired = pairing_violations(df, keys, model, models, outcome, group).groupBy("problem").agg(
        F.count(F.lit(1)).alias("violations")
    )
    return rows.unionByName(repeated).unionByName(unpaired).where("violations > 0")


def id_digest(df: DataFrame, key: str = "id") -> DataFrame:
    """A digest of the set of distinct ids, and their number; order and repeats never matter.

    The SHA-256 of every distinct id is cut into four 60-bit pieces, and each piece is summed
    over the set. The digest is the SHA-256 of the count and the four sums, joined by colons.
    Sums come together map-side, so one definition holds for sets of any size.
    """
    ids = df.select(F.col(key).cast("string").alias("_id")).where("_id is not null").distinct()
    hashed = ids.select(F.sha2("_id", 256).alias("_h"))
    piece = lambda i: F.conv(F.substring("_h", 1 + i * HEX_DIGITS, HEX_DIGITS), 16, 10).cast("decimal(20,0)")
    sums = hashed.agg(F.count(F.lit(1)).alias("ids"), *[F.coalesce(F.sum(piece(i)), F.lit(0)).alias(f"_s{i}") for i in range(4)])
    text = F.concat_ws(":", F.col("ids").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(4)])
    return sums.select("ids", F.sha2(text, 256).alias("digest"))


def table_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Row count and order-free content sum of a table, in one pass."""
    ordered = sorted(df.columns)
    mark = F.xxhash64(F.struct(*ordered)).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(mark), F.lit(0)).cast("string").alias("mark")).select(
        F.lit(name).alias("table_name"), "rows", "mark"
    )


def drifted_tables(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Tables whose fingerprint changed, vanished or was never recorded."""
    renamed = current.select("table_name", F.col("rows").alias("rows_now"), F.col("mark").alias("mark_now"))
    joined = recorded.join(renamed, "table_name", "full_outer")
    same = F.col("rows").eqNullSafe(F.col("rows_now")) & F.col("mark").eqNullSafe(F.col("mark_now"))
    return joined.where(~same).select("table_name", "rows", "rows_now")


def lineage_conflicts(lineage: DataFrame, field: str = "field", value: str = "value", run: str = "run") -> DataFrame:
    """Settings on which runs disagree, or that some run did not record."""
    runs = lineage.agg(F.count_distinct(run)).scalar()
    seen = lineage.groupBy(field).agg(
        F.count_distinct(F.coalesce(F.col(value), F.lit("(null)"))).alias("distinct_values"),
        F.count_distinct(run).alias("runs"),
    )
    return seen.where((F.col("distinct_values") > 1) | (F.col("runs") < runs))


def modal_choice(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value per keys, ties to the smallest, with its count and all fits counted."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        F.max_by(value, F.struct(F.col("_n"), -F.col(value))).alias("chosen"),
        F.max("_n").alias("times_chosen"),
        F.sum("_n").alias("fits"),
    )


def selection_conflicts(choices: DataFrame, stored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose stored choice or count is not what the choices give when counted again."""
    again = modal_choice(choices, keys, value).select(
        *keys, F.col("chosen").alias("expected_chosen"), F.col("times_chosen").alias("expected_times")
    )
    both = stored.select(*keys, "chosen", "times_chosen").join(again, keys, "full_outer")
    same = F.col("chosen").eqNullSafe(F.col("expected_chosen")) & F.col("times_chosen").eqNullSafe(F.col("expected_times"))
    return both.where(~same)


def split_cohort(df: DataFrame, release: str, development: str, update: str, id: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both cohorts and the ids that belong to both or to neither."""
    dev, upd = df.where(F.col(release) == development), df.where(F.col(release) == update)
    known = F.coalesce(F.col(release).isin(development, update), F.lit(False))
    seen = df.groupBy(id).agg(
        F.min(F.when(known, F.col(release))).alias("_a"),
        F.max(F.when(known, F.col(release))).alias("_b"),
        F.count_if(~known).alias("_other"),
    )
    problems = _problems(overlap=F.col("_a") != F.col("_b"), unknown_release=F.col("_other") > 0)
    return dev, upd, seen.select(id, F.explode(problems).alias("problem"))


def common_complete(df: DataFrame, tables: list[DataFrame], id: str = "id") -> DataFrame:
    """Rows whose id is present in every table."""
    return reduce(lambda kept, other: kept.join(other.select(id), id, "left_semi"), tables, df)


def held_out_ids(first: DataFrame, second: DataFrame, development: DataFrame, id: str = "id") -> DataFrame:
    """Ids in both feature tables that are not in the development cohort."""
    return common_complete(first.select(id), [second], id).join(development.select(id), id, "left_anti").distinct()


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], cardinality: str = "many_to_one") -> DataFrame:
    """Left join after checking that the sides called one are unique on the keys."""
    if cardinality not in ("one_to_one", "many_to_one"):
        raise ValueError(f"unknown cardinality: {cardinality}")
    enforce(key_violations(right, keys).where("problem = 'duplicate'"), "right side is not unique")
    if cardinality == "one_to_one":
        enforce(key_violations(left, keys).where("problem = 'duplicate'"), "left side is not unique")
        return join_on(left, right, keys, "left")
    return salted_join(left, right, keys, whole_row(left), "left")


def concatenate(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
