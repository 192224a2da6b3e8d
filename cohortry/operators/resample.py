"""Paired cluster bootstrap: whole groups drawn with replacement, weights instead of row copies.

Rows are ordered by score once, over all tasks, packed, and written: a few bytes a row. A task of
the sweep hashes how often each resample of a block drew every group, one byte each and
BROADCAST_BYTES in all, and streams the written rows past that table with running sums per
resample. So blocks read the same files, and neither rows nor draws are copied per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.hashing import hash_cell, stable_hash, stable_hashes
from cohortry.operators.metrics import auroc_of_cells
from cohortry.operators.prefix import CELL, default_cells, numbered
from cohortry.operators.skew import join_on, salted_join
from cohortry.session import saved, set_for, ship_package

DRAW_BLOCK = 500
CHUNK_ROWS = 1_024
#: Products of rows and resamples that a sweep weighs at a time, where a block has few resamples.
CHUNK_PRODUCTS = 1 << 18
#: Bytes of draws of all groups that a task of the sweep holds. With more groups than that, rows meet their draws in a join.
BROADCAST_BYTES = 128 << 20
#: Draws that a task hashes at a time, and products of rows and resamples for which the sweep takes another task.
DRAWN_AT_ONCE = 1 << 20
TASK_PRODUCTS = 4_000_000_000
#: Bytes of the group numbers of a packed row, at most.
PACKED_BYTES = 32_768
#: Rows that take as long to read and weigh in a resample as one draw to hash.
HASHED_AS_ROWS = 100


def numbered_groups(df: DataFrame, group: str, seed: int) -> DataFrame:
    """Each group once, with ``group_no`` from 0 in seeded hash order."""
    groups = df.select(group).distinct().withColumn("_h", stable_hash(seed, group))
    celled = groups.withColumn(CELL, hash_cell(F.col("_h"), default_cells(df)))
    return numbered(celled, [], [F.col("_h"), F.col(group)]).select(
        group, (F.col("row_no") - 1).alias("group_no")
    )


def _draws(spark: SparkSession, size: int, resamples: int, seed: int) -> DataFrame:
    """Single draws (resample, group_no).

    Every resample makes as many draws as there are groups. A draw is a hash of
    (seed, resample, draw number), so it can be recomputed anywhere.
    """
    draws = spark.range(resamples * size).select(
        F.floor(F.col("id") / size).cast("bigint").alias("resample"), (F.col("id") % size).alias("draw")
    )
    return draws.select("resample", (stable_hash(seed, "resample", "draw") % size).alias("group_no"))


def _drawn(spark: SparkSession, size: int, resamples: int, seed: int) -> DataFrame:
    """The draws of ``_draws`` by ranges of groups: (range, resample, drawn), places in the range as two bytes each.

    A task hashes one resample, or a part of its draws, at a time.
    """
    ship_package(spark)
    width, parts = _range_width(size), -(-size // DRAWN_AT_ONCE)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.column("id").to_pylist():
                resample, part = divmod(unit, parts)
                hashed = stable_hashes(f"{seed}:{resample}", size * part // parts, size * (part + 1) // parts)
                drawn = np.sort((hashed % np.uint64(size)).astype(np.uint32 if size <= 2**32 else np.uint64))
                first, last = int(drawn[0]) // width, int(drawn[-1]) // width
                cuts = np.searchsorted(drawn, np.arange(first, last + 2) * width)
                found = [(first + i, (drawn[x:y] - (first + i) * width).astype(np.uint16).tobytes()) for i, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r for r, _ in found], pa.int64()), pa.array([resample] * len(found), pa.int64()), pa.array([places for _, places in found], pa.binary()),
                ], names=["range", "resample", "drawn"])

    units = resamples * parts
    tasks = max(1, min(units, max(spark.sparkContext.defaultParallelism, units * size // parts // 20_000_000)))
    return spark.range(0, units, 1, tasks).mapInArrow(task, "range bigint, resample bigint, drawn binary")


def _range_width(size: int) -> int:
    """Groups of a range: a number that two bytes hold, and about a thousand ranges where there are many groups."""
    return min(65_536, max(4_096, -(-size // 1_024)))


def _same_rows(batch: pa.RecordBatch, columns: list[str]) -> list[int]:
    """Borders of the runs of rows that are equal in ``columns``."""
    new = np.zeros(batch.num_rows, bool)
    for column in columns:
        codes = batch.column(column).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return [0, *np.flatnonzero(new).tolist(), batch.num_rows]


def _counting_tasks(spark: SparkSession, size: int, resamples: int) -> int:
    return max(spark.sparkContext.defaultParallelism, size * resamples // 50_000_000)


def group_draws(df: DataFrame, group: str, resamples: int, seed: int) -> DataFrame:
    """Multiplicity of each drawn group: (resample, group, times).

    The groups of a range and its draws come to one task per block of resamples, which holds
    those groups and counts one resample at a time.
    """
    spark = df.sparkSession
    groups = saved(numbered_groups(df, group, seed))
    size = max(1, groups.count())
    width, block_of = _range_width(size), lambda: F.floor(F.col("resample") / DRAW_BLOCK)
    kind = groups.schema[group].dataType
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((resamples - 1) // DRAW_BLOCK).cast("bigint"))).alias("block")
    named = groups.select(
        F.floor(F.col("group_no") / width).alias("range"), blocks, F.lit(-1).cast("bigint").alias("resample"), F.lit(None).cast("binary").alias("drawn"), "group_no", group
    )
    drawn = _drawn(spark, size, resamples, seed).select(
        "range", block_of().alias("block"), "resample", "drawn", F.lit(None).cast("bigint").alias("group_no"), F.lit(None).cast(kind).alias(group)
    )
    placed = named.unionByName(drawn).repartition(_counting_tasks(spark, size, resamples), "range", "block")
    fields = ["range", "block", "resample"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, times, at = [], None, None, None

        def told() -> Iterator[pa.RecordBatch]:
            if times is not None:
                own = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), at[2]), pa.int64()), names.take(pa.array(own)), pa.array(times[own])], names=["resample", group, "times"]
                )

        for batch in batches:
            cuts = _same_rows(batch, fields)
            for x, y in zip(cuts, cuts[1:]):
                key = tuple(batch.column(f)[x].as_py() for f in fields)
                if key != at:
                    yield from told()
                    if at is None or key[:2] != at[:2]:
                        held, names = [], None
                    times, at = None, key
                if key[2] < 0:
                    held.append(batch.column(group).slice(x, y - x))
                    continue
                if names is None:
                    if not held:  # no groups at all
                        continue
                    names = pa.concat_arrays(held)
                for drawn in batch.column("drawn").slice(x, y - x):
                    n = np.bincount(np.frombuffer(drawn.as_buffer(), np.uint16), minlength=len(names))
                    times = n if times is None else times + n
        yield from told()

    return placed.sortWithinPartitions(*fields, "group_no").mapInArrow(task, f"resample bigint, `{group}` {kind.simpleString()}, times bigint")


def _drawn_table(size: int, first: int, width: int, seed: int) -> np.ndarray:
    """How often each of ``width`` resamples from ``first`` drew every group: a row per group, one byte each, more where a byte is too small."""
    table = np.zeros((size, width), np.uint8)
    for column in range(width):
        for start in range(0, size, DRAWN_AT_ONCE):
            hashed = stable_hashes(f"{seed}:{first + column}", start, min(size, start + DRAWN_AT_ONCE))
            drawn, times = np.unique((hashed % np.uint64(size)).astype(np.int32), return_counts=True)
            times += table[drawn, column]
            kind = _narrow(int(times.max()))
            if np.dtype(kind).itemsize > table.itemsize:
                table = table.astype(kind)
            table[drawn, column] = times
    return table


def _narrow(most: int) -> type:
    return next(kind for size, kind in KINDS.items() if most < 256**size)


def _multiplicities(draws: DataFrame, groups: DataFrame, group: str, resamples: int, draw_block: int) -> DataFrame:
    """(group, block, times): how often each resample of a block drew the group, one byte each, two where a byte is too small."""
    block = F.floor(F.col("resample") / draw_block).cast("int").alias("block")
    lists = draws.groupBy("group_no", block).agg(F.collect_list("resample").alias("drawn"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = []
            for k, found in zip(batch.column("block").to_pylist(), batch.column("drawn")):
                n = np.bincount(found.values.to_numpy() - k * draw_block, minlength=min(draw_block, resamples - k * draw_block))
                times.append(n.astype(np.uint8 if n.max() < 256 else np.uint16 if n.max() < 65_536 else np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("group_no"), batch.column("block"), pa.array(times, pa.binary())], names=["group_no", "block", "times"])

    packed = lists.mapInArrow(task, "group_no bigint, block int, times binary")
    return join_on(packed, groups, ["group_no"]).drop("group_no")


class Sweep:
    """Weighted areas under scores that come in order, for all resamples of a block.

    The first and the last score are kept apart, since they may go on in other tasks. What
    is held are a few numbers per resample, whatever the number of rows.
    """

    def __init__(self, width: int):
        self.width = width
        self.runs: list[tuple[float, np.ndarray, np.ndarray]] = []  # the first score, and the present one
        self.area, self.pos, self.neg = np.zeros(width), np.zeros(width, np.int64), np.zeros(width, np.int64)

    def add(self, score: np.ndarray, times: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        """Rows in order of their score; ``times`` has a row for each and a column per resample."""
        new = np.r_[True, (score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1]))]
        self.add_runs(float(score[0]), float(score[-1]), new, times, np.arange(len(score)), pos, neg)

    def add_runs(self, first: float, last: float, new: np.ndarray, table: np.ndarray, at: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        """Rows in order of their score: the first and last score, where a score begins, and where in ``table`` the row's draws stand."""
        run = np.cumsum(new) - int(new[0])
        # sums, and twice them, stay in four bytes where they fit
        most = int(np.iinfo(table.dtype).max) if table.dtype.kind == "u" else int(table.max())
        wide = np.int32 if most * (int(pos.sum()) + int(neg.sum())) < 2**30 else np.int64
        sides = [_run_sums(table, at, counts, run, wide) for counts in (pos, neg)]
        start, end = 0, int(run[-1])
        if self.runs and (self.runs[-1][0] == first or (np.isnan(first) and np.isnan(self.runs[-1][0]))):
            for held, side in zip(self.runs[-1][1:], sides):
                held[:] += _of_run(side, 0)
            start = 1
        if start > end:
            return
        if len(self.runs) > 1:
            score, of_pos, of_neg = self.runs.pop()
            self._pass((np.zeros(1, int), of_pos[None, :]), (np.zeros(1, int), of_neg[None, :]))
        if not self.runs:
            self.runs.append((first, *(_of_run(side, 0).astype(np.int64) for side in sides)))
            start = 1
        if start <= end:
            self._pass(*(_between(side, start, end) for side in sides))
            self.runs.append((last, *(_of_run(side, end).astype(np.int64) for side in sides)))

    def _pass(self, pos: tuple[np.ndarray, np.ndarray], neg: tuple[np.ndarray, np.ndarray]) -> None:
        """Whole scores behind the first one: numbers of the scores that have positives, negatives, and their weights."""
        (at_pos, of_pos), (at_neg, of_neg) = pos, neg
        if len(at_pos):
            total = of_pos.sum(axis=0, dtype=np.int64)
            self.area += 2.0 * self.neg * total
            if len(at_neg):
                upto = np.cumsum(of_neg, axis=0, dtype=of_neg.dtype)
                below, upto_same = np.searchsorted(at_neg, at_pos, "left"), np.searchsorted(at_neg, at_pos, "right")
                padded = np.concatenate([np.zeros((1, self.width), upto.dtype), upto])
                self.area += np.einsum("ij,ij->j", of_pos.astype(np.float64), (padded[below] + padded[upto_same]).astype(np.float64))
            self.pos += total
        if len(at_neg):
            self.neg += of_neg.sum(axis=0, dtype=np.int64)

    def pieces(self) -> Iterator[tuple[float, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(score, kind, twice_area, pos, neg): scores that may go on elsewhere (kind 0), and what lies between them (kind 1)."""
        for score, pos, neg in self.runs:
            yield score, 0, np.zeros(self.width), pos, neg
        if self.pos.any() or self.neg.any():
            yield self.runs[0][0], 1, self.area, self.pos, self.neg


def _run_sums(table: np.ndarray, at: np.ndarray, counts: np.ndarray, run: np.ndarray, wide: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs that have counts, and the draws times counts summed up in each."""
    own = np.flatnonzero(counts)
    if not len(own):
        return own, np.zeros((0, table.shape[1]), wide)
    weights, runs = np.take(table, at[own], axis=0), run[own]
    if counts[own].max() > 1:
        weights = weights * counts[own].astype(wide)[:, None]
    starts = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
    if len(starts) == len(own):
        return runs, weights.astype(wide)
    return runs[starts], np.add.reduceat(weights, starts, axis=0, dtype=wide)


def _of_run(side: tuple[np.ndarray, np.ndarray], number: int) -> np.ndarray:
    at = int(np.searchsorted(side[0], number))
    return side[1][at] if at < len(side[0]) and side[0][at] == number else np.zeros(side[1].shape[1], side[1].dtype)


def _between(side: tuple[np.ndarray, np.ndarray], start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    own = slice(*np.searchsorted(side[0], [start, end]))
    return side[0][own], side[1][own]


KINDS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}
PIECES = "resample bigint, _at double, kind int, twice_area double, pos bigint, neg bigint"


def _told(sweep: Sweep, first: int, key: list, kinds: list[pa.DataType], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The pieces of a sweep over resamples from ``first``."""
    for score, kind, area, pos, neg in sweep.pieces():
        own = np.flatnonzero((pos > 0) | (neg > 0))
        n = len(own)
        yield pa.RecordBatch.from_arrays([
            pa.array(own + first, pa.int64()), pa.array(np.full(n, score)), pa.array(np.full(n, kind), pa.int32()),
            pa.array(area[own]), pa.array(pos[own], pa.int64()), pa.array(neg[own], pa.int64()),
            *[pa.array([v] * n, k) for v, k in zip(key, kinds)],
        ], names=["resample", "_at", "kind", "twice_area", "pos", "neg", *keys])


def _packed(rows: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """Rows (keys, _score, group_no, pos, neg, part) that are in order of keys and score, some hundreds packed to one.

    What is kept are group numbers, the first and last score, where a score begins, and counts.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    chunk_rows = max(1, min(chunk_rows, PACKED_BYTES // 4))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            score, at, pos, neg = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_score", "group_no", "pos", "neg"))
            new = np.r_[True, (score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1]))]
            found, starts = [], []
            cuts = _same_rows(batch, keys)
            for a, b in zip(cuts, cuts[1:]):
                for x in range(a, b, chunk_rows):
                    y = min(b, x + chunk_rows)
                    starts.append(x)
                    found.append((
                        seq, float(score[x]), float(score[y - 1]), at[x:y].astype(np.int32).tobytes(), new[x:y].tobytes(),
                        *(n[x:y].astype(_narrow(int(n[x:y].max()))).tobytes() for n in (pos, neg)),
                    ))
                    seq += 1
            if not found:
                continue
            part = batch.column("part").slice(0, len(found))
            own = pa.array(starts, pa.int64())
            yield pa.RecordBatch.from_arrays([
                part, *[pa.array(column, kind) for column, kind in zip(zip(*found), (pa.int64(), pa.float64(), pa.float64(), *[pa.binary()] * 4))],
                *[batch.column(k).take(own) for k in keys],
            ], names=["part", "at", "first", "last", "data", "new", "pos", "neg", *keys])

    schema = "part int, at bigint, first double, last double, data binary, new binary, pos binary, neg binary"
    return rows.mapInArrow(task, ", ".join([schema, *(f"`{k}` {fields[k]}" for k in keys)]))


def _numbers(raw: pa.Scalar, n: int) -> np.ndarray:
    buffer = raw.as_buffer()
    return np.frombuffer(buffer, KINDS[buffer.size // n]).astype(np.int64)


def _swept_packed(rows: DataFrame, keys: list[str], size: int, resamples: int, seed: int, draw_block: int) -> DataFrame:
    """Pieces from packed rows, each with the block of resamples it is for, and the draws hashed here.

    Files may be split and come in any order; where a row does not follow the last one, a new sweep begins.
    """
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, table, sweep, key, kinds, follows, first = None, None, None, None, [], None, 0
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            blocks, parts, ats = (batch.column(c).to_pylist() for c in ("block", "part", "at"))
            names = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
            for i in range(batch.num_rows):
                if sweep is not None and (blocks[i] != block or names[i] != key or (parts[i], ats[i]) != follows):
                    yield from _told(sweep, first, key, kinds, keys)
                    sweep = None
                if blocks[i] != block:
                    block, first, table = blocks[i], blocks[i] * draw_block, None
                    table = _drawn_table(size, first, min(draw_block, resamples - first), seed)
                if sweep is None:
                    sweep, key = Sweep(table.shape[1]), names[i]
                follows = (parts[i], ats[i] + 1)
                at = np.frombuffer(batch.column("data")[i].as_buffer(), np.int32)
                new = np.frombuffer(batch.column("new")[i].as_buffer(), bool)
                sweep.add_runs(batch.column("first")[i].as_py(), batch.column("last")[i].as_py(), new, table, at, *(_numbers(batch.column(c)[i], len(at)) for c in ("pos", "neg")))
        if sweep is not None:
            yield from _told(sweep, first, key, kinds, keys)

    return rows.mapInArrow(task, ", ".join([PIECES, *(f"`{k}` {fields[k]}" for k in keys)]))


def _swept(rows: DataFrame, keys: list[str], resamples: int, draw_block: int, chunk_rows: int) -> DataFrame:
    """Pieces per (keys, resample) of rows (keys, block, _score, pos, neg, times) that are in order of keys and score."""
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweeps: dict[int, Sweep] = {}
        last, kinds = None, []

        def told() -> Iterator[pa.RecordBatch]:
            for block, sweep in sweeps.items():
                yield from _told(sweep, block * draw_block, last, kinds, keys)

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(k).type for k in keys]
            names = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
            score, pos, neg = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_score", "pos", "neg"))
            blocks, times = batch.column("block").to_numpy(), batch.column("times")
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if last is not None and names[a] != last:
                    yield from told()
                    sweeps = {}
                last = names[a]
                for block in np.unique(blocks[a:b]).tolist():
                    width = min(draw_block, resamples - block * draw_block)
                    sweep = sweeps.setdefault(block, Sweep(width))
                    own = a + np.flatnonzero(blocks[a:b] == block)
                    for start in range(0, len(own), chunk_rows):
                        rows = own[start : start + chunk_rows]
                        sweep.add(score[rows], _unpacked(times.take(pa.array(rows)), width), pos[rows], neg[rows])
        if last is not None:
            yield from told()

    return rows.mapInArrow(task, ", ".join([PIECES, *(f"`{k}` {fields[k]}" for k in keys)]))


def _unpacked(times: pa.Array, width: int) -> np.ndarray:
    """Rows of draws, straight from the buffer where every row has one byte a resample."""
    raw = times.to_pylist()
    if all(len(r) == width for r in raw):
        return np.frombuffer(b"".join(raw), np.uint8).reshape(-1, width)
    return np.stack([np.frombuffer(r, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(r) // width]).astype(np.int64) for r in raw])


def _pieces_by_tables(
    rows: DataFrame, groups: DataFrame, group: str, keys: list[str], size: int, resamples: int, seed: int, draw_block: int, chunk_rows: int
) -> DataFrame:
    """Every block of resamples meets every slot of the rows in one task, which reads the slot's packed rows where they were written."""
    spark = rows.sparkSession
    cores, blocks, n = spark.sparkContext.defaultParallelism, -(-resamples // draw_block), rows.count()
    # a slot hashes the draws of its block anew, so there are several only where rows are many times the groups
    slots = max(1, min(-(-n * resamples // (TASK_PRODUCTS * blocks)), n // (HASHED_AS_ROWS * size)))
    parts = max(slots, cores, n // 2_000_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = salted_join(rows, groups, [group], F.col("_score")).select(*keys, "_score", "group_no", "pos", "neg")
    in_order = numbered.repartitionByRange(parts, *keys, "_score", "group_no").sortWithinPartitions(*keys, "_score", "group_no")
    packed = saved(_packed(in_order.withColumn("part", F.spark_partition_id()), keys, chunk_rows))
    read = [
        packed.where(F.col("part").between(parts * slot // slots, parts * (slot + 1) // slots - 1)).coalesce(1).withColumn("block", F.lit(block))
        for slot in range(slots) for block in range(blocks)
    ]
    with set_for(spark, APART):
        return saved(_by_cells(_swept_packed(reduce(DataFrame.unionByName, read), keys, size, resamples, seed, draw_block), keys))


#: A union of parts of one task each is otherwise taken for one task; packed rows take tens of kilobytes each.
APART = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.parquet.columnarReaderBatchSize": "256", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def _by_cells(pieces: DataFrame, keys: list[str]) -> DataFrame:
    return pieces.groupBy("resample", *keys, F.struct("_at", "kind").alias(CELL)).agg(
        F.sum("twice_area").alias("_area"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )


def _pieces_by_join(
    rows: DataFrame, groups: DataFrame, group: str, keys: list[str], size: int, resamples: int, seed: int, draw_block: int, chunk_rows: int
) -> DataFrame:
    """Each count meets its group's draws, and a group that holds much of the data is split over many tasks for that."""
    times = _multiplicities(_draws(rows.sparkSession, size, resamples, seed), groups, group, resamples, draw_block)
    drawn = salted_join(rows, times, [group], F.col("_score")).repartitionByRange(*keys, "_score", F.xxhash64(group))
    # Spark drops a sort below a join, so it stands behind it
    in_order = drawn.select(*keys, "block", "_score", "pos", "neg", "times").sortWithinPartitions(*keys, "_score")
    return _by_cells(_swept(in_order, keys, resamples, draw_block, chunk_rows), keys)


def group_counts(df: DataFrame, group: str, keys: list[str], y: str, score: str) -> DataFrame:
    """Outcome counts per (group, keys, score), written once.

    The bootstrap looks at them several times; the rows they come from are read once.
    """
    scored = df.withColumn(score, F.col(score).cast("double") + F.lit(0.0))
    return saved(
        scored.groupBy(group, *keys, score).agg(
            F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
        )
    )


def resampled_auroc(
    counts: DataFrame,
    group: str,
    keys: list[str],
    score: str,
    resamples: int,
    seed: int,
    draw_block: int = DRAW_BLOCK,
    chunk_rows: int | None = None,
) -> DataFrame:
    """AUROC per (resample, keys) under the group draws, from ``group_counts``.

    Counts are dealt by ranges of (keys, score), a score that very many groups share over
    several tasks, and swept in order. What tasks send on are at most three rows per keys and
    resample, whatever they read.
    """
    ship_package(counts.sparkSession)
    groups = saved(numbered_groups(counts, group, seed))
    size, cores = max(1, groups.count()), counts.sparkSession.sparkContext.defaultParallelism
    collapsed = counts.select(*keys, group, F.col(score).cast("double").alias("_score"), "pos", "neg")
    if size <= BROADCAST_BYTES:
        # blocks of one size, as few as the table of draws allows and all cores have one of
        blocks = max(-(-resamples // min(draw_block, BROADCAST_BYTES // size)), min(resamples, cores))
        draw_block = -(-resamples // blocks)
        chunk_rows = chunk_rows or max(CHUNK_ROWS, CHUNK_PRODUCTS // draw_block)
        cells = _pieces_by_tables(collapsed, groups, group, keys, size, resamples, seed, draw_block, chunk_rows)
    else:
        cells = _pieces_by_join(collapsed, groups, group, keys, size, resamples, seed, draw_block, chunk_rows or CHUNK_ROWS)
    tied = F.when(F.col(CELL)["kind"] == 0, F.col("pos").cast("double") * F.col("neg")).otherwise(F.col("_area"))
    return auroc_of_cells(cells.withColumn("twice_area", tied).drop("_area"), ["resample", *keys])


def cluster_bootstrap(
    df: DataFrame,
    group: str,
    model: str,
    y: str,
    score: str,
    resamples: int,
    seed: int,
    repeat: str | None = "repeat",
    baseline: str = "B",
    extended: str = "D",
    **options,
) -> DataFrame:
    """One ``delta`` per resample: AUROC(extended) - AUROC(baseline), averaged over repeats.

    A repeat whose draw has one outcome class is skipped; a resample with no repeat
    left gives no row.
    """
    keys = [model] + ([repeat] if repeat else [])
    counts = group_counts(df.where(F.col(model).isin(baseline, extended)), group, keys, y, score)
    return bootstrap_of_counts(counts, group, model, score, resamples, seed, repeat, baseline, extended, **options)


def bootstrap_of_counts(
    counts: DataFrame,
    group: str,
    model: str,
    score: str,
    resamples: int,
    seed: int,
    repeat: str | None = "repeat",
    baseline: str = "B",
    extended: str = "D",
    **options,
) -> DataFrame:
    """The same from ``group_counts`` of the two models."""
    repeats = [repeat] if repeat else []
    scored = resampled_auroc(counts, group, [*repeats, model], score, resamples, seed, **options)
    sides = scored.groupBy("resample", *repeats).agg(
        F.max(F.when(F.col(model) == extended, F.col("auroc"))).alias("_e"),
        F.max(F.when(F.col(model) == baseline, F.col("auroc"))).alias("_b"),
    )
    return (
        sides.where(F.col("_e").isNotNull() & F.col("_b").isNotNull())
        .groupBy("resample")
        .agg(F.avg(F.col("_e") - F.col("_b")).alias("delta"))
    )


def percentile_interval(
    draws: DataFrame, keys: list[str], value: str = "delta", lower: float = 0.025, upper: float = 0.975
) -> DataFrame:
    """Interval with linear interpolation over the draws of each key, and how many there were.

    The draws of a key are as many as there are resamples, a number the caller sets.
    """
    return draws.groupBy(*keys).agg(
        F.percentile(value, F.lit(lower)).alias("ci_lower"),
        F.percentile(value, F.lit(upper)).alias("ci_upper"),
        F.count(value).alias("successful"),
    )


def interval_diagnostics(
    intervals: DataFrame, keys: list[str], lower: str, upper: str, truth: str
) -> DataFrame:
    """Share of intervals that hold the truth, and their mean width."""
    return intervals.groupBy(*keys).agg(
        F.avg(F.col(upper) - F.col(lower)).alias("mean_width"),
        F.avg(((F.col(lower) <= F.col(truth)) & (F.col(truth) <= F.col(upper))).cast("double")).alias("coverage"),
        F.count(F.lit(1)).alias("intervals"),
    )


def endpoint_shift(draws: DataFrame, keys: list[str], prefix: int, value: str = "delta") -> DataFrame:
    """Largest move of either interval end between the first ``prefix`` resamples and all of them."""
    early = F.when(F.col("resample") < prefix, F.col(value))
    ends = [0.025, 0.975]
    return draws.groupBy(*keys).agg(
        F.greatest(
            *[
                F.abs(F.percentile(value, F.lit(q)) - F.percentile(early, F.lit(q)))
                for q in ends
            ]
        ).alias("max_endpoint_shift")
    )
