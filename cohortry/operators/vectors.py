"""Vector tables: pooling, triage, quality checks, run comparison, block assembly."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.contracts import enforce, key_violations, set_diff
from cohortry.operators.skew import join_on
from cohortry.session import saved, ship_package

TOLERANCE = 1e-5


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def all_finite(vec: Column) -> Column:
    return F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def masked_mean_pool(df: DataFrame, id: str = "id", mask: str = "mask", vec: str = "vec") -> DataFrame:
    """Mean of the unmasked vectors per id, scaled to unit length; an all-masked id gets zeros.

    Neighbouring rows of an id are added up in the task that reads them, in any order of
    the rows; positions are never unfolded, and a very long sequence is summed where it lies.
    """
    pooled = run_sums(df, id, mask, vec).groupBy("_id").agg(
        vector_to_array(Summarizer.sum(array_to_vector("_v"))).alias("_sum"), F.sum("_m").alias("attended")
    ).withColumnRenamed("_id", id)
    mean = pooled.withColumn("_mean", F.transform("_sum", lambda x: x / F.greatest(F.col("attended"), F.lit(1.0))))
    length = F.greatest(norm(F.col("_mean")), F.lit(1e-12))
    return mean.withColumn("_n", length).select(
        id, F.col("attended").cast("bigint").alias("attended"), F.transform("_mean", lambda x: x / F.col("_n")).alias("vec")
    )


def run_sums(df: DataFrame, id: str = "id", mask: str = "mask", vec: str = "vec") -> DataFrame:
    """(_id, _v, _m): sum of the masked vectors and of the mask over each run of rows with one id."""
    ship_package(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, m, v = batch.columns
            if m.null_count or v.null_count or v.flatten().null_count or len(np.unique(pc.list_value_length(v))) != 1:
                raise ValueError("vectors to pool must be whole, of one length and with a mask")
            m = m.to_numpy()
            weighted = v.flatten().to_numpy().reshape(len(m), -1) * m[:, None]
            # nulls and NaN do not equal themselves: their runs are just shorter
            same = pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, ~same])
            sums = pa.array(list(np.add.reduceat(weighted, starts, axis=0)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(starts)), sums, pa.array(np.add.reduceat(m, starts))], names=["_id", "_v", "_m"])

    rows = df.select(F.col(id).alias("_id"), F.col(mask).cast("double").alias("_m"), F.col(vec).cast("array<double>").alias("_v"))
    return rows.mapInArrow(task, f"_id {rows.schema['_id'].dataType.simpleString()}, _v array<double>, _m double")


def triage_sequences(
    df: DataFrame, max_length: int, unknown: int = 0, id: str = "id", tokens: str = "token_ids", warned: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split token rows into accepted ones and failures with their reason.

    An unknown token (or a warning about one) fails the row before its length is looked at.
    Rows are judged once and kept as Parquet: whoever reads both parts does not make the
    tokens twice, and lengths and reasons are read without them.
    """
    unknowns = F.size(tokens) - F.size(F.array_remove(tokens, unknown))
    warned = F.lit(False) if warned is None else warned
    judged = saved(df.select(
        "*",
        F.size(tokens).alias("sequence_length"),
        unknowns.alias("unknown_count"),
        F.when((unknowns > 0) | warned, "TOKENIZATION_FAILURE").when(F.size(tokens) > max_length, "OVERLENGTH").alias("reason"),
    ))
    ok = judged.where("reason is null").drop("reason", "unknown_count")
    return ok, judged.where("reason is not null").select(id, "reason", "unknown_count", "sequence_length")


def vector_violations(df: DataFrame, dimension: int, id: str = "id", vec: str = "vec", tolerance: float = TOLERANCE) -> DataFrame:
    """Vectors of another length, with a value that is not finite, or not of unit length."""
    v = F.col(vec)
    sized = v.isNotNull() & (F.size(v) == dimension)
    finite = F.coalesce(all_finite(v), F.lit(False))
    problems = F.filter(
        F.array(
            F.when(~sized, "dimension"),
            F.when(~finite, "not_finite"),
            F.when(finite & (F.abs(norm(v) - 1.0) > tolerance + tolerance), "not_unit"),
        ),
        lambda p: p.isNotNull(),
    )
    return df.select(id, F.explode(problems).alias("problem"))


def _near(x: Column, y: Column, atol: float, rtol: float) -> Column:
    """Closeness relative to y; values that are not finite are near only if equal, NaN never is."""
    finite = lambda v: ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    within = F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)
    equal = (x == y) & ~F.isnan(x)
    return F.coalesce(equal | (finite(x) & finite(y) & within), F.lit(False))


def compare_vectors(
    first: DataFrame, second: DataFrame, id: str = "id", vec: str = "vec", atol: float = TOLERANCE, rtol: float = TOLERANCE
) -> DataFrame:
    """Per id: in which runs it is, and how far apart its vectors are."""
    a = first.select(id, F.col(vec).alias("_a"))
    b = second.select(id, F.col(vec).alias("_b"))
    both = a.join(b, id, "full_outer")
    shared = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    gaps = F.zip_with("_a", "_b", lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    near = F.zip_with("_a", "_b", lambda x, y: _near(x.cast("double"), y.cast("double"), atol, rtol))
    return both.select(
        id,
        shared.alias("in_both"),
        F.when(shared, all_finite(F.col("_a")) & all_finite(F.col("_b"))).alias("finite"),
        F.when(shared, F.forall(near, lambda ok: ok)).alias("close"),
        F.when(shared, F.array_max(gaps)).alias("max_abs_diff"),
    )


def compare_vector_runs(first: DataFrame, second: DataFrame, **options) -> DataFrame:
    """One row: whether two runs cover the same ids and agree, and by how much they differ."""
    return compare_vectors(first, second, **options).agg(
        F.coalesce(F.bool_and("in_both"), F.lit(True)).alias("same_ids"),
        F.count_if("in_both").alias("in_both"),
        F.coalesce(F.bool_and("finite"), F.lit(True)).alias("finite"),
        F.coalesce(F.bool_and("close"), F.lit(True)).alias("within_tolerance"),
        F.max("max_abs_diff").alias("max_abs_diff"),
    )


def repeatability_report(baseline: DataFrame, same_order: DataFrame, reordered: DataFrame, required: int, **options) -> DataFrame:
    """The two comparisons of a baseline run, and whether both pass."""
    rows = compare_vector_runs(baseline, same_order, **options).withColumn("comparison", F.lit("same_order")).unionByName(
        compare_vector_runs(baseline, reordered, **options).withColumn("comparison", F.lit("reordered"))
    )
    passed = (F.col("in_both") >= required) & F.col("same_ids") & F.col("finite") & F.col("within_tolerance")
    return rows.withColumn("passed", passed)


def coverage_report(
    requested: DataFrame, full: DataFrame, repeat: DataFrame, id: str = "id", fraction: float = 0.05, **options
) -> DataFrame:
    """One row: does the full run hold every requested id, and does the repeat sample agree with it."""
    spread = set_diff(requested, full.select(id), id)
    asked = requested.agg(F.count(F.lit(1)).alias("requested"), F.count_distinct(id).alias("requested_ids"))
    found = full.agg(F.count(F.lit(1)).alias("successful"))
    off = spread.agg(F.count(F.lit(1)).alias("differing_ids"))
    sample = repeat.agg(F.count(F.lit(1)).alias("repeat_rows"), F.count_distinct(id).alias("repeat_ids"))
    pairs = compare_vectors(repeat, full.join(repeat.select(id), id, "left_semi"), id, **options).agg(
        F.coalesce(F.bool_and(F.coalesce("close", F.lit(False))), F.lit(True)).alias("within_tolerance"),
        F.max("max_abs_diff").alias("max_abs_diff"),
    )
    one = asked.select(
        "*", *[part.select(F.struct("*")).scalar().alias(name) for name, part in (
            ("found", found), ("off", off), ("sample", sample), ("pairs", pairs))]
    ).select("*", "found.*", "off.*", "sample.*", "pairs.*")
    size = F.greatest(F.lit(1), F.ceil(F.col("requested") * F.lit(fraction)))
    coverage = F.col("successful") / F.nullif(F.col("requested"), F.lit(0))
    passed = (
        (F.col("differing_ids") == 0) & (coverage == 1.0) & F.col("within_tolerance")
        & (F.col("repeat_rows") == F.col("repeat_ids")) & (F.col("repeat_rows") == size)
    )
    return one.select(
        "requested", "successful", "differing_ids", coverage.alias("coverage"), "repeat_rows",
        "within_tolerance", "max_abs_diff", F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def vector_summary(df: DataFrame, vec: str = "vec", token_count: str | None = None) -> DataFrame:
    """Dimension, range of lengths and token counts, number of vectors."""
    tokens = F.col(token_count) if token_count else F.lit(None).cast("bigint")
    sized = df.select(F.size(vec).alias("_d"), norm(F.col(vec)).alias("_n"), tokens.alias("_t"))
    return sized.agg(
        F.max("_d").alias("dimension"),
        (F.min("_d") == F.max("_d")).alias("one_dimension"),
        F.min("_n").alias("norm_min"), F.max("_n").alias("norm_max"),
        F.min("_t").alias("token_count_min"), F.max("_t").alias("token_count_max"),
        F.count(F.lit(1)).alias("rows"),
    )


@dataclass(frozen=True)
class Block:
    """A named part of a feature vector; continuous parts are scaled, binary ones pass through."""

    name: str
    width: int
    continuous: bool = True


def continuous_positions(blocks: list[Block]) -> list[int]:
    """Positions of the continuous blocks in the assembled vector."""
    positions, start = [], 0
    for block in blocks:
        if block.continuous:
            positions.extend(range(start, start + block.width))
        start += block.width
    return positions


def missing_features(ids: DataFrame, tables: dict[str, DataFrame], blocks: list[Block], id: str = "id") -> DataFrame:
    """Ids without a vector of the right width in some block."""
    rows = None
    for block in blocks:
        present = tables[block.name].where(F.size("vec") == block.width).select(id)
        absent = ids.select(id).join(present, id, "left_anti").withColumn("block", F.lit(block.name))
        rows = absent if rows is None else rows.unionByName(absent)
    return rows


def assemble_blocks(
    ids: DataFrame, tables: dict[str, DataFrame], blocks: list[Block], id: str = "id", check: bool = True
) -> DataFrame:
    """Concatenate the named blocks per id in the given order. A missing or repeated id is an error."""
    if check:
        enforce(missing_features(ids, tables, blocks, id), "ids without features")
        for block in blocks:
            enforce(key_violations(tables[block.name], [id]).where("problem = 'duplicate'"), f"ids repeat in block {block.name}")
    joined = ids
    for block in blocks:
        side = tables[block.name].select(id, F.col("vec").alias(f"_{block.name}"))
        joined = join_on(joined, side, [id])
    parts = [F.transform(f"_{b.name}", lambda x: x.cast("double")) for b in blocks]
    return joined.withColumn("vec", F.concat(*parts)).drop(*[f"_{b.name}" for b in blocks])
