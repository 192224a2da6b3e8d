"""Many regularised logistic fits in shared passes over one feature table.

Every row carries ``parts``: for each outer split its inner part, or -1 where it is
outer test data. A fit is (outer split, excluded part, C), so thousands of fits are a
list of parameters while the rows stay one table. Each step of the optimiser is one
Spark job: tasks add up loss and derivatives of all fits over their rows, the sums meet
in a vector aggregate, and only coefficients return to the driver. Their number depends
on the fits and the vector width, not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.metrics import exact_quantiles
from cohortry.operators.skew import broadcast_checked, join_on
from cohortry.session import cut_lineage, saved, set_for, ship_package

NEWTON_WIDTH = 300
PASS_BYTES = 256 << 20
FAN_IN = 64
PACKET_ROWS = 128
#: Bytes of vectors that a pass turns into arrays at a time.
SLICE_BYTES = 4 << 20
#: For jobs that read whole wide vectors: by default a task gathers 4,096 of them from a file, and sends 64 MB at once.
WIDE_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "256", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: For jobs that read packets, each of which takes up to megabytes.
PACKETS = WIDE_ROWS | {"spark.sql.parquet.columnarReaderBatchSize": "16"}
TEST = -1


@dataclass(frozen=True)
class FitTask:
    """One fit: the outer split it belongs to, the inner part left out (None for none), and C."""

    outer: int
    excluded: int | None
    c: float


@dataclass(frozen=True)
class FitOptions:
    """Objective 1/2 w'w + C x sum of weighted log loss, and how far to take it."""

    penalise_intercept: bool = True
    balanced: bool = False
    max_iterations: int = 5000
    tolerance: float = 1e-7
    method: str = "auto"


@dataclass(frozen=True)
class Scaling:
    """Training-only imputation and scaling of one fit, with its class counts."""

    median: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    rows: int
    positives: int

    def apply(self, x: np.ndarray) -> np.ndarray:
        if np.isnan(x).any():
            x = np.where(np.isnan(x), self.median, x)
        return (x - self.mean) / self.scale


@dataclass
class Fitted:
    """Coefficients on scaled features, intercept last, and whether the optimiser got there."""

    task: FitTask
    coefficients: np.ndarray
    steps: int
    converged: bool


def fold_scaler(
    df: DataFrame, keys: list[str], part: str, positions: list[int], width: int, vec: str = "vec", outcome: str = "outcome"
) -> DataFrame:
    """Training statistics per keys with each part left out, and with none (``excluded`` NULL).

    One row holds arrays over all positions: ``median`` of the values present, and ``mean``
    and population ``scale`` after filling gaps with it. A constant position has scale 1;
    positions not listed pass through (mean 0, scale 1). The rows are read for the sums and
    the squared deviations of each part; training sets are put together from those small
    tables, never by subtracting the part that is left out.
    """
    gap = lambda x: x.isNull() | F.isnan(x)
    sums = df.groupBy(*keys, part).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum(F.col(outcome).cast("bigint")).alias("_pos"),
        summed(F.transform(vec, lambda x: F.when(gap(x), 0.0).otherwise(x))).alias("_s"),
        summed(F.transform(vec, lambda x: F.when(gap(x), 0.0).otherwise(1.0))).alias("_n"),
    ).withColumn("_mean", F.zip_with("_s", "_n", _ratio)).drop("_s")
    # as many rows as there are training sets and parts
    sums = cut_lineage(sums)
    own = broadcast_checked(sums.select(*keys, part, "_mean"))
    off = F.zip_with(vec, "_mean", lambda x, m: F.when(gap(x), 0.0).otherwise((x - m) * (x - m)))
    spread = join_on(df, own, [*keys, part]).groupBy(*keys, part).agg(summed(off).alias("_m2"))
    parts = cut_lineage(join_on(sums, spread, [*keys, part]))
    left_out = parts.select(*keys, F.col(part).cast("int").alias("excluded")).unionByName(
        parts.select(*keys).distinct().withColumn("excluded", F.lit(None).cast("int"))
    )
    members = join_on(parts, left_out, keys).where(F.col("excluded").isNull() | (F.col("excluded") != F.col(part)))
    sets = [*keys, "excluded"]
    centres = members.groupBy(*sets).agg(
        F.sum("_rows").alias("rows"), F.sum("_pos").alias("positives"),
        summed(F.col("_n")).alias("_present"),
        summed(F.zip_with("_n", "_mean", lambda n, m: n * m)).alias("_total"),
    ).withColumn("_centre", F.zip_with("_total", "_present", _ratio))
    between = F.transform(
        F.arrays_zip("_m2", "_n", "_mean", "_centre"),
        lambda e: e["_m2"] + e["_n"] * (e["_mean"] - e["_centre"]) * (e["_mean"] - e["_centre"]),
    )
    squares = join_on(members, centres.select(*sets, "_centre"), sets).groupBy(*sets).agg(summed(between).alias("_m2"))
    stats = join_on(centres, squares, sets)
    gaps = _positions_with_gaps(parts, positions)
    if gaps:
        stats = join_on(stats, _medians(df, keys, part, gaps, width, vec), sets, "left")
        stats = stats.withColumn("_median", F.coalesce("_median", "_centre"))
    else:
        # without gaps nothing is filled in, and the median is never used
        stats = stats.withColumn("_median", F.col("_centre"))
    listed = set(positions)
    used = F.array(*[F.lit(i in listed) for i in range(width)])

    def finished(e):
        missing = F.col("rows") - e["_present"]
        rows = F.nullif(F.col("rows").cast("double"), F.lit(0.0))
        mean = (e["_present"] * e["_centre"] + missing * e["_median"]) / rows
        variance = (
            e["_m2"] + e["_present"] * (e["_centre"] - mean) * (e["_centre"] - mean)
            + missing * (e["_median"] - mean) * (e["_median"] - mean)
        ) / rows
        constant = variance <= F.lit(1e-24) * mean * mean
        return F.struct(
            F.when(e["used"], e["_median"]).otherwise(0.0).alias("median"),
            F.when(e["used"], mean).otherwise(0.0).alias("mean"),
            F.when(~e["used"] | constant, 1.0).otherwise(F.sqrt(variance)).alias("scale"),
        )

    zipped = F.arrays_zip("_m2", "_present", "_centre", "_median", used.alias("used"))
    return stats.withColumn("_z", F.transform(zipped, finished)).select(
        *sets, "rows", "positives", *[F.col(f"_z.{n}").alias(n) for n in ("median", "mean", "scale")]
    )


def split_scalings(df: DataFrame, positions: list[int], width: int) -> dict[tuple[int, int | None], Scaling]:
    """What ``collect_scalings(fold_scaler(...))`` gives for every outer split, over rows (vec, outcome, parts).

    Each row adds its vector to the sums of its part in every split, inside the task, so no
    vector is copied per split; a second pass adds squared deviations from the part's mean.
    The sums come back as one row per split and part, a number the settings fix, and are put
    together into training sets there, never by subtracting the part that is left out.
    """
    ship_package(df.sparkSession)
    rows = df.select("vec", "outcome", "parts")

    def run(means: dict | None) -> dict[tuple[int, int], np.ndarray]:
        sent = df.sparkSession.sparkContext.broadcast(means)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            means, totals = sent.value, {}
            for batch in _slices(batches):
                x, y, parts = _arrays(batch)
                present = ~np.isnan(x)
                filled = np.where(present, x, 0.0)
                for outer in range(parts.shape[1]):
                    for part in np.unique(parts[parts[:, outer] != TEST, outer]).tolist():
                        own = parts[:, outer] == part
                        if means is None:
                            stats = np.concatenate([[own.sum(), y[own].sum()], filled[own].sum(axis=0), present[own].sum(axis=0)])
                        else:
                            stats = (np.where(present[own], x[own] - means[(outer, part)], 0.0) ** 2).sum(axis=0)
                        totals[(outer, part)] = totals[(outer, part)] + stats if (outer, part) in totals else stats
            if totals:
                outer, part = (pa.array([k[i] for k in totals], pa.int32()) for i in (0, 1))
                sums = pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([outer, part, sums], names=["outer", "part", "stats"])

        added = _summed_by(rows.mapInArrow(task, "outer int, part int, stats array<double>"), ["outer", "part"])
        with set_for(df.sparkSession, WIDE_ROWS):
            return {(r["outer"], r["part"]): np.array(r["stats"], float) for r in added.collect()}

    safe = lambda top, n: np.divide(top, n, out=np.zeros_like(top), where=n > 0)
    sums = run(None)
    means = {k: safe(v[2 : 2 + width], v[2 + width :]) for k, v in sums.items()}
    squares = run(means)
    gaps = sorted({int(i) for v in sums.values() for i in np.flatnonzero(v[2 + width :] < v[0])} & set(positions))
    medians: dict = {}
    if gaps:
        long = rows.select("outcome", "vec", F.posexplode("parts").alias("outer", "part")).where(F.col("part") != TEST)
        medians = {(r["outer"], r["excluded"]): np.array(r["_median"], float) for r in _medians(long, ["outer"], "part", gaps, width, "vec").collect()}
    used = np.isin(np.arange(width), positions)
    found = {}
    for outer in sorted({o for o, _ in sums}):
        parts = sorted(p for o, p in sums if o == outer)
        for excluded in [None, *parts]:
            kept = [(outer, p) for p in parts if p != excluded]
            if not kept:
                continue
            total, positives = (int(sum(sums[k][i] for k in kept)) for i in (0, 1))
            present = sum(sums[k][2 + width :] for k in kept)
            centre = safe(sum(sums[k][2 + width :] * means[k] for k in kept), present)
            spread = sum(squares[k] + sums[k][2 + width :] * (means[k] - centre) ** 2 for k in kept)
            median = medians.get((outer, excluded), centre)
            missing = total - present
            mean = (present * centre + missing * median) / total
            variance = (spread + present * (centre - mean) ** 2 + missing * (median - mean) ** 2) / total
            plain = ~used | (variance <= 1e-24 * mean * mean)
            found[(outer, excluded)] = Scaling(
                np.where(used, median, 0.0), np.where(used, mean, 0.0), np.where(plain, 1.0, np.sqrt(variance)), total, positives
            )
    return found


def summed(c) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(c)))


def _ratio(s: Column, n: Column) -> Column:
    return F.coalesce(s / F.nullif(n, F.lit(0.0)), F.lit(0.0))


def _summed_by(partial: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors ``stats`` added up by keys; of many tasks first in groups, so that no reducer reads them all."""
    if partial.rdd.getNumPartitions() > FAN_IN:
        salted = partial.withColumn("_salt", F.spark_partition_id() % FAN_IN)
        partial = salted.groupBy(*keys, "_salt").agg(summed("stats").alias("stats"))
    return partial.groupBy(*keys).agg(summed("stats").alias("stats"))


def _positions_with_gaps(parts: DataFrame, positions: list[int]) -> list[int]:
    """Positions where some value is missing; at most the vector width of them."""
    short = parts.select("_rows", F.posexplode("_n").alias("position", "_present")).where("_present < _rows")
    found = {row["position"] for row in short.select("position").distinct().collect()}
    return sorted(found & set(positions))


def _medians(df: DataFrame, keys: list[str], part: str, gaps: list[int], width: int, vec: str) -> DataFrame:
    """Exact medians of the values present, per training set, for the positions that need them."""
    parts = [row[0] for row in df.select(part).distinct().orderBy(part).collect()]
    cells = df.select(
        *keys, part,
        F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.col(vec)[i].alias("value")) for i in gaps])).alias("_c"),
    ).select(*keys, part, "_c.position", "_c.value").where("value is not null and not isnan(value)")
    sets = F.filter(F.array(F.lit(None).cast("int"), *[F.lit(int(p)) for p in parts]), lambda e: e.isNull() | (e != F.col(part)))
    spread = cells.select(*keys, "position", "value", F.explode(sets).alias("excluded"))
    found = exact_quantiles(spread, [*keys, "excluded", "position"], "value", [0.5])
    pairs = found.groupBy(*keys, "excluded").agg(
        F.map_from_entries(F.collect_list(F.struct("position", "quantile"))).alias("_map")
    )
    filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.col("_map")[i], F.lit(0.0)))
    return pairs.select(*keys, "excluded", filled.alias("_median"))


def collect_scalings(scaler: DataFrame, outer: str = "outer") -> dict[tuple[int, int | None], Scaling]:
    """Bring the scaling of every training set to the driver: as many rows as training sets."""
    return {
        (row[outer], row["excluded"]): Scaling(
            np.array(row["median"], float), np.array(row["mean"], float), np.array(row["scale"], float),
            int(row["rows"]), int(row["positives"]),
        )
        for row in scaler.collect()
    }


def _class_weights(scaling: Scaling, balanced: bool) -> tuple[float, float]:
    if not balanced:
        return 1.0, 1.0
    negatives = scaling.rows - scaling.positives
    return scaling.rows / (2 * max(negatives, 1)), scaling.rows / (2 * max(scaling.positives, 1))


def _packed(width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(width)


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors (gaps as NaN), outcomes and parts of a batch, straight from its buffers."""
    rows = batch.num_rows
    x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)
    parts = batch.column("parts").flatten().to_numpy(zero_copy_only=False).astype(int).reshape(rows, -1)
    return x, batch.column("outcome").to_numpy(zero_copy_only=False).astype(float), parts


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, with at most SLICE_BYTES of vectors at a time."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, SLICE_BYTES * batch.num_rows // (8 * max(1, len(batch.column("vec").flatten()))))
            yield from (batch.slice(start, step) for start in range(0, batch.num_rows, step))


def _with_ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def _grouped(tasks: dict[int, FitTask]) -> dict[tuple[int, int | None], list[int]]:
    groups: dict[tuple[int, int | None], list[int]] = {}
    for number, task in tasks.items():
        groups.setdefault((task.outer, task.excluded), []).append(number)
    return groups


def _sum_pass(df: DataFrame, tasks, points, scalings, options: FitOptions, curvature: bool) -> DataFrame:
    """(task, stats): loss, gradient and, with ``curvature``, the packed Hessian of the data term."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((tasks, points, scalings))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks, points, scalings = shared.value
        groups, totals = _grouped(tasks), {}
        for batch in _slices(batches):
            x, y, parts = _arrays(batch)
            for (outer, excluded), numbers in groups.items():
                own = parts[:, outer]
                rows = own != TEST
                if excluded is not None:
                    rows &= own != excluded
                if not rows.any():
                    continue
                scaling = scalings[(outer, excluded)]
                features, target = _with_ones(scaling.apply(x[rows])), y[rows]
                low, high = _class_weights(scaling, options.balanced)
                weight = np.where(target == 1, high, low)
                margins = features @ np.array([points[n] for n in numbers]).T
                fitted = 1.0 / (1.0 + np.exp(-np.clip(margins, -500, 500)))
                losses = weight @ (np.logaddexp(0.0, margins) - target[:, None] * margins)
                gradients = features.T @ (weight[:, None] * (fitted - target[:, None]))
                for place, number in enumerate(numbers):
                    stats = [np.array([losses[place]]), gradients[:, place]]
                    if curvature:
                        bend = weight * fitted[:, place] * (1.0 - fitted[:, place])
                        hessian = (features * bend[:, None]).T @ features
                        stats.append(hessian[_packed(features.shape[1])])
                    stats = np.concatenate(stats)
                    totals[number] = totals[number] + stats if number in totals else stats
        if totals:
            sums = pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), sums], names=["task", "stats"])

    return _summed_by(df.select("vec", "outcome", "parts").mapInArrow(add, "task int, stats array<double>"), ["task"])


PACKED = "n int, outcome binary, parts binary, row binary, place binary, value binary"


def packed_rows(df: DataFrame) -> DataFrame:
    """Rows (vec, outcome, parts) in packets of up to PACKET_ROWS, written once for the passes of wide fits.

    A packet holds (row, place, value) of what is not zero, gaps as NaN, or the whole
    matrix, with ``row`` NULL, where a quarter of it or more is not zero.
    """
    ship_package(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PACKET_ROWS):
                x, y, parts = _arrays(batch.slice(start, PACKET_ROWS))
                row, place = np.nonzero(x)
                sparse = 4 * len(row) < x.size
                held = (row.astype(np.int32).tobytes(), place.astype(np.int32).tobytes(), x[row, place].tobytes()) if sparse else (None, None, x.tobytes())
                values = (len(y), y.tobytes(), parts.astype(np.int32).tobytes(), *held)
                kinds = [pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["n", "outcome", "parts", "row", "place", "value"])

    with set_for(df.sparkSession, WIDE_ROWS):
        return saved(df.select("vec", "outcome", "parts").mapInArrow(task, PACKED))


def _packed_pass(packets: DataFrame, tasks, points, scalings, options: FitOptions) -> DataFrame:
    """(task, stats) as of ``_sum_pass`` without curvature, over ``packed_rows``; time goes with the values that are not zero.

    Scaling is folded into the coefficients: a margin is the sum of value x w / scale,
    less mean x w / scale, which is the same for all rows.
    """
    ship_package(packets.sparkSession)
    shared = packets.sparkSession.sparkContext.broadcast((tasks, points, scalings))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks, points, scalings = shared.value
        groups, totals = _grouped(tasks), {}
        for packet in (p for batch in batches for at in range(batch.num_rows) for p in batch.slice(at, 1).to_pylist()):
            n, y = packet["n"], np.frombuffer(packet["outcome"])
            parts, value = np.frombuffer(packet["parts"], np.int32).reshape(n, -1), np.frombuffer(packet["value"])
            dense = packet["row"] is None
            row, place = (None, None) if dense else (np.frombuffer(packet[k], np.int32) for k in ("row", "place"))
            gaps = np.isnan(value)
            for (outer, excluded), numbers in groups.items():
                own = parts[:, outer]
                rows = (own != TEST) & (own != excluded) if excluded is not None else own != TEST
                if not rows.any():
                    continue
                scaling = scalings[(outer, excluded)]
                width = len(scaling.mean)
                low, high = _class_weights(scaling, options.balanced)
                weight = np.where(rows, np.where(y == 1, high, low), 0.0)
                if dense:
                    features = scaling.apply(value.reshape(n, width))
                else:
                    filled = np.where(gaps, scaling.median[place], value) if gaps.any() else value
                for number in numbers:
                    point = points[number]
                    if dense:
                        margin = features @ point[:-1] + point[-1]
                    else:
                        slopes = point[:-1] / scaling.scale
                        margin = np.bincount(row, filled * slopes[place], n) + (point[-1] - scaling.mean @ slopes)
                    off = weight * (1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))) - y)
                    if dense:
                        gradient = off @ features
                    else:
                        gradient = (np.bincount(place, filled * off[row], width) - scaling.mean * off.sum()) / scaling.scale
                    stats = np.concatenate([[weight @ (np.logaddexp(0.0, margin) - y * margin)], gradient, [off.sum()]])
                    totals[number] = totals[number] + stats if number in totals else stats
        if totals:
            sums = pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), sums], names=["task", "stats"])

    return _summed_by(packets.mapInArrow(add, "task int, stats array<double>"), ["task"])


def _penalty(width: int, options: FitOptions) -> np.ndarray:
    penalty = np.ones(width)
    if not options.penalise_intercept:
        penalty[-1] = 0.0
    return penalty


def _newton_pass(df: DataFrame, tasks, points, scalings, options: FitOptions) -> dict[int, tuple]:
    """Per task: objective, gradient norm and Newton direction at its point."""
    width = len(next(iter(points.values())))
    penalty = _penalty(width, options)
    shared = df.sparkSession.sparkContext.broadcast((tasks, points))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tasks, points = shared.value
        upper = _packed(width)
        for batch in batches:
            rows = []
            for number, stats in zip(batch["task"], batch["stats"]):
                stats, c, point = np.asarray(stats), tasks[number].c, points[number]
                hessian = np.zeros((width, width))
                hessian[upper] = stats[1 + width:]
                hessian = c * (hessian + np.triu(hessian, 1).T) + np.diag(penalty)
                gradient = c * stats[1:1 + width] + penalty * point
                direction = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
                value = c * stats[0] + 0.5 * float(penalty @ point**2)
                rows.append((number, value, float(np.linalg.norm(gradient)), direction.tolist()))
            yield pd.DataFrame(rows, columns=["task", "value", "size", "direction"])

    summed = _sum_pass(df, tasks, points, scalings, options, curvature=True)
    solved = summed.mapInPandas(solve, "task int, value double, size double, direction array<double>")
    return {r["task"]: (r["value"], r["size"], np.array(r["direction"])) for r in solved.collect()}


def _chunks(numbers: list[int], stats_width: int) -> list[list[int]]:
    """Tasks per pass, so that the sums a Python worker holds stay within PASS_BYTES."""
    size = max(1, PASS_BYTES // (8 * stats_width))
    return [numbers[i:i + size] for i in range(0, len(numbers), size)]


def _fit_newton(df: DataFrame, tasks: dict[int, FitTask], scalings, width: int, options: FitOptions) -> dict[int, Fitted]:
    points = {n: np.zeros(width) for n in tasks}
    accepted: dict[int, tuple] = {}
    first: dict[int, float] = {}
    steps = dict.fromkeys(tasks, 0)
    fitted: dict[int, Fitted] = {}
    while len(fitted) < len(tasks):
        live = [n for n in tasks if n not in fitted]
        for chunk in _chunks(live, 1 + width + width * (width + 1) // 2):
            found = _newton_pass(df, {n: tasks[n] for n in chunk}, {n: points[n] for n in chunk}, scalings, options)
            for n in chunk:
                if n not in found:
                    raise ValueError(f"no training rows for {tasks[n]}")
                value, size, direction = found[n]
                first.setdefault(n, max(size, 1e-300))
                steps[n] += 1
                # at the limit of precision a step no longer moves the point
                still = np.linalg.norm(direction) <= 1e-13 * (1.0 + np.linalg.norm(points[n]))
                if size <= options.tolerance * first[n] or still:
                    fitted[n] = Fitted(tasks[n], points[n], steps[n], True)
                    continue
                if n in accepted and value > accepted[n][0] + 1e-10 * abs(accepted[n][0]):
                    # the full step overshot: halve it from the last good point
                    base_value, base, base_direction, length = accepted[n]
                    accepted[n] = (base_value, base, base_direction, length / 2)
                    points[n] = base - accepted[n][3] * base_direction
                else:
                    accepted[n] = (value, points[n], direction, 1.0)
                    points[n] = points[n] - direction
                if steps[n] >= options.max_iterations or accepted[n][3] < 1e-8:
                    fitted[n] = Fitted(tasks[n], accepted[n][1], steps[n], accepted[n][3] < 1e-8)
    return fitted


SEARCH = (
    "task int, steps int, state int, value double, length double, first double, trial array<double>, "
    "point array<double>, gradient array<double>, direction array<double>, moves array<array<double>>, turns array<array<double>>"
)
OPEN, CONVERGED, STOPPED = 0, 1, 2


def _bent(gradient: np.ndarray, moves: list[np.ndarray], turns: list[np.ndarray]) -> np.ndarray:
    """The quasi-Newton direction from the last moves and the turns of the gradient they brought."""
    q, kept = gradient.copy(), []
    for ds, dg in zip(reversed(moves), reversed(turns)):
        a = (ds @ q) / (ds @ dg)
        q -= a * dg
        kept.append(a)
    q *= (moves[-1] @ turns[-1]) / (turns[-1] @ turns[-1]) if moves else 1 / max(1.0, np.linalg.norm(q))
    for ds, dg, a in zip(moves, turns, reversed(kept)):
        q += ds * (a - (dg @ q) / (ds @ dg))
    return q


def _search_step(row: dict, loss: float, slope: np.ndarray, c: float, penalty: np.ndarray, options: FitOptions, memory: int) -> dict:
    """The search of one task after the data term and its gradient at the trial point are known."""
    arrays = {k: np.asarray(row[k], float) for k in ("trial", "point", "gradient", "direction") if row[k] is not None}
    moves, turns = ([np.asarray(v, float) for v in row[k]] for k in ("moves", "turns"))
    trial = arrays["trial"]
    value = c * loss + 0.5 * float(penalty @ trial**2)
    gradient = c * slope + penalty * trial
    steps, length, size = row["steps"] + 1, row["length"], float(np.linalg.norm(gradient))
    first = max(size, 1e-300) if row["first"] is None else row["first"]
    started = "point" in arrays
    if not started or value <= row["value"] - 1e-4 * length * float(arrays["gradient"] @ arrays["direction"]):
        if started:
            ds, dg = trial - arrays["point"], gradient - arrays["gradient"]
            if ds @ dg > 1e-12 * np.linalg.norm(ds) * np.linalg.norm(dg):
                moves, turns = [*moves, ds][-memory:], [*turns, dg][-memory:]
        point, length, direction = trial, 1.0, _bent(gradient, moves, turns)
    else:
        value, point, gradient, direction, length = row["value"], arrays["point"], arrays["gradient"], arrays["direction"], length / 2
    there = float(np.linalg.norm(gradient)) <= options.tolerance * first or length < 1e-10
    state = CONVERGED if there else STOPPED if steps >= options.max_iterations else OPEN
    return {
        "task": row["task"], "steps": steps, "state": state, "value": value, "length": length, "first": first,
        "trial": point if state else point - length * direction, "point": point, "gradient": gradient, "direction": direction, "moves": moves, "turns": turns,
    }


def _fit_gradient(df: DataFrame, tasks: dict[int, FitTask], scalings, width: int, options: FitOptions, memory: int = 10) -> dict[int, Fitted]:
    """Limited-memory quasi-Newton steps for wide vectors: only loss and gradient per pass.

    Points, gradients and the last moves of every search stay in a table with a row per
    task; a step joins it with the sums of the pass and writes it anew. The driver gets the
    next trial points, which the next pass sends to all tasks, and nothing of the history.
    The rows are packed once, without their zeros.
    """
    packets = packed_rows(df)
    penalty, spark = _penalty(width, options), df.sparkSession
    strengths = {n: t.c for n, t in tasks.items()}

    def advance(sums: pa.Table, searches: pa.Table) -> pa.Table:
        stats = {n: np.asarray(v) for n, v in zip(sums.column("task").to_pylist(), sums.column("stats").to_pylist())}
        rows = [
            _search_step(row, float(stats[row["task"]][0]), stats[row["task"]][1:], strengths[row["task"]], penalty, options, memory)
            for row in searches.to_pylist() if row["task"] in stats
        ]
        plain = lambda v: v.tolist() if isinstance(v, np.ndarray) else [x.tolist() for x in v] if isinstance(v, list) else v
        return pa.Table.from_pylist([{k: plain(v) for k, v in r.items()} for r in rows], schema=searches.schema)

    none = (0, OPEN, 0.0, 1.0, None, [0.0] * width, None, None, None, [], [])
    searches = spark.createDataFrame([(n, *none) for n in tasks], SEARCH)
    points = {n: np.zeros(width) for n in tasks}
    fitted: dict[int, Fitted] = {}
    while points:
        chunks = _chunks(list(points), 1 + width)
        passes = [_packed_pass(packets, {n: tasks[n] for n in chunk}, {n: points[n] for n in chunk}, scalings, options) for chunk in chunks]
        sums = reduce(DataFrame.unionByName, passes)
        with set_for(spark, PACKETS):
            searches = saved(sums.groupBy("task").cogroup(searches.where(F.col("state") == OPEN).groupBy("task")).applyInArrow(advance, SEARCH))
        found = {r["task"]: r for r in searches.select("task", "steps", "state", "trial").collect()}
        lost = [tasks[n] for n in points if n not in found]
        if lost:
            raise ValueError(f"no training rows for {lost[0]}")
        fitted.update({n: Fitted(tasks[n], np.asarray(r["trial"]), r["steps"], r["state"] == CONVERGED) for n, r in found.items() if r["state"] != OPEN})
        points = {n: np.asarray(r["trial"]) for n, r in found.items() if r["state"] == OPEN}
    return fitted


def objective_gradient(df: DataFrame, fitted: Fitted, scaling: Scaling, width: int, options: FitOptions = FitOptions()) -> DataFrame:
    """(rows, size, start): gradient norms of the objective at a fit's coefficients and at zero, in column expressions only.

    ``df`` has (vec, outcome, parts). Apart from its own plan it shares nothing with the
    passes of the fits, so that one can check the other.
    """
    part = F.col("parts")[fitted.task.outer]
    rows = df.where(part != TEST) if fitted.task.excluded is None else df.where((part != TEST) & (part != fitted.task.excluded))
    known = lambda values: F.lit(np.asarray(values, np.float64))
    filled = F.zip_with("vec", known(scaling.median), lambda x, m: F.when(x.isNull() | F.isnan(x), m).otherwise(x))
    scaled = F.zip_with(F.zip_with(filled, known(scaling.mean), lambda x, m: x - m), known(scaling.scale), lambda x, s: x / s)
    with_one = rows.select("outcome", F.concat(scaled, F.array(F.lit(1.0))).alias("x"))
    margin = F.aggregate(F.zip_with("x", known(fitted.coefficients), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    low, high = _class_weights(scaling, options.balanced)
    weight = F.when(F.col("outcome") == 1, high).otherwise(low)
    off = with_one.select("x", (weight * (1 / (1 + F.exp(-margin)) - F.col("outcome"))).alias("now"), (weight * (F.lit(0.5) - F.col("outcome"))).alias("zero"))
    times = lambda name: summed(F.transform("x", lambda v: v * F.col(name)))
    sums = off.agg(F.count(F.lit(1)).alias("rows"), times("now").alias("now"), times("zero").alias("zero"))
    pull = known(_penalty(width + 1, options) * fitted.coefficients)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))
    c = F.lit(float(fitted.task.c))
    return sums.select(
        "rows", norm(F.zip_with("now", pull, lambda g, w: c * g + w)).alias("size"), norm(F.transform("zero", lambda g: c * g)).alias("start")
    )


def fit_logistic_tasks(
    df: DataFrame, tasks: list[FitTask], scalings: dict, width: int, options: FitOptions = FitOptions()
) -> list[Fitted]:
    """Fit every task over ``df`` (vec, outcome, parts). ``width`` is the vector length."""
    numbered = dict(enumerate(tasks))
    method = options.method
    if method == "auto":
        method = "newton" if width <= NEWTON_WIDTH else "gradient"
    run = {"newton": _fit_newton, "gradient": _fit_gradient}[method]
    fitted = run(df, numbered, scalings, width + 1, options)
    return [fitted[n] for n in numbered]


def predict_tasks(df: DataFrame, fitted: list[Fitted], scalings: dict, keep: list[str], held_out: str = "inner") -> DataFrame:
    """Probabilities for the rows each fit did not see: (keep..., outer, c, probability).

    ``inner`` scores the part a fit left out; ``outer`` scores the outer test rows.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((fitted, scalings))
    fields = {f.name: f.dataType.simpleString() for f in df.select(*keep).schema}
    schema = ", ".join(f"`{n}` {t}" for n, t in fields.items()) + ", outer int, c double, probability double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, scalings = shared.value
        groups = _grouped({n: f.task for n, f in enumerate(fitted)})
        for batch in _slices(batches):
            x, _, parts = _arrays(batch)
            carried = batch.select(keep)
            for (outer, excluded), numbers in groups.items():
                rows = parts[:, outer] == (TEST if held_out == "outer" else excluded)
                n = int(rows.sum())
                if not n:
                    continue
                features = _with_ones(scalings[(outer, excluded)].apply(x[rows]))
                kept = carried.filter(pa.array(rows))
                for number in numbers:
                    margins = np.clip(features @ fitted[number].coefficients, -500, 500)
                    yield pa.RecordBatch.from_arrays([
                        *kept.columns, pa.array(np.full(n, outer), pa.int32()), pa.array(np.full(n, float(fitted[number].task.c))),
                        pa.array(1.0 / (1.0 + np.exp(-margins))),
                    ], names=[*keep, "outer", "c", "probability"])

    columns = list(dict.fromkeys([*keep, "vec", "outcome", "parts"]))
    return df.select(*columns).mapInArrow(score, schema)
