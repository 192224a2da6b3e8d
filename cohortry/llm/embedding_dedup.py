"""Near-duplicate embeddings: a cover tree and its dual traversal.

The tree is built on a bounded sample: nested levels of centres whose radii halve. Every
vector goes to its nearest leaf centre, and the distances found give each node the radius
it really covers. The dual traversal drops pairs of nodes that are too far apart for any
pair of their vectors; what is left is compared exactly in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.components import components
from cohortry.llm.shared import in_tasks, local_roots, runs, written

MARGIN = 1e-4
STRIP = 512
EXACT_AT_ONCE = 100_000


@dataclass(frozen=True)
class CoverSpec:
    """``sample`` bounds the vectors that the tree is built on; all vectors are compared.

    ``block`` vectors are compared with as many at a time.
    """

    threshold: float = 0.95
    sample: int = 1_024
    block: int = 4_096
    finest: float = 1 / 16
    seed: int = 3


@dataclass
class CoverTree:
    """Centres of all levels (each level holds those of the level above), and who covers whom."""

    points: np.ndarray
    levels: list[np.ndarray]
    parents: list[np.ndarray]

    def covering(self, radius: np.ndarray) -> list[np.ndarray]:
        """Per level, a bound on the distance from a centre to any vector below it, from the leaves' radii."""
        found = [radius]
        for level in range(len(self.levels) - 1, 0, -1):
            up = self.parents[level]
            apart = np.linalg.norm(self.points[self.levels[level]] - self.points[self.levels[level - 1]][up], axis=1)
            reach = np.full(len(self.levels[level - 1]), -1.0)
            below = found[0]
            np.maximum.at(reach, up[below >= 0], (apart + below)[below >= 0])
            found.insert(0, reach)
        return found

    def traverse(self, radius: np.ndarray, epsilon: float) -> np.ndarray:
        """Pairs of leaves that may hold vectors within ``epsilon``, by descending pairs of nodes level by level."""
        covering = self.covering(radius)
        near = np.ones((len(self.levels[0]),) * 2, bool)
        for level, centres in enumerate(self.levels):
            if level:
                up = self.parents[level]
                near = near[np.ix_(up, up)]
            points, reach = self.points[centres], covering[level]
            apart = np.sqrt(np.maximum(0, 2 - 2 * points @ points.T))
            near &= (reach[:, None] >= 0) & (reach[None, :] >= 0) & (apart <= reach[:, None] + reach[None, :] + epsilon)
        return near

    def order(self) -> np.ndarray:
        """Leaves in depth-first order, so that neighbours in it share ancestors."""
        place = np.zeros(len(self.levels[0]), np.int64)
        for level in range(1, len(self.levels)):
            keys = np.lexsort((np.arange(len(self.levels[level])), place[self.parents[level]]))
            place = np.empty(len(keys), np.int64)
            place[keys] = np.arange(len(keys))
        return np.argsort(place, kind="stable")


def build_tree(points: np.ndarray, finest: float) -> CoverTree:
    """Levels of radius 2, 1, 1/2 ... down to ``finest``; centres of a level are more than its radius apart."""
    centres, levels, parents, radius = [0], [np.asarray([0])], [np.zeros(1, np.int64)], 1.0
    gap = np.linalg.norm(points - points[0], axis=1)
    while len(centres) < len(points) and radius >= finest and gap.max() > 1e-9:
        while gap.max() > radius:
            centres.append(int(gap.argmax()))
            gap = np.minimum(gap, np.linalg.norm(points - points[centres[-1]], axis=1))
        above = levels[-1]
        levels.append(np.asarray(centres))
        parents.append((points[centres] @ points[above].T).argmax(axis=1))
        radius /= 2
    return CoverTree(points, levels, parents)


def _usable(vectors: DataFrame) -> DataFrame:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vectors.where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)
    )


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten()
    return np.asarray(values, dtype=np.float64).reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _links(classes: DataFrame, size: int, spec: CoverSpec) -> DataFrame:
    """(node, root, links) for classes of distinct vectors of one length."""
    spark = classes.sparkSession
    picked = classes.select("node", "embedding").orderBy(F.xxhash64("node", F.lit(spec.seed)), "node").limit(spec.sample).collect()
    tree = build_tree(_unit(np.asarray([r["embedding"] for r in picked], np.float64)), spec.finest)
    leaves = tree.points[tree.levels[-1]]
    sent = spark.sparkContext.broadcast(leaves)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, STRIP):
                batch = whole.slice(start, STRIP)
                unit = _unit(_matrix(batch.column(2), size))
                close = unit @ centres.T
                cell = close.argmax(axis=1)
                apart = np.linalg.norm(unit - centres[cell], axis=1)
                vector = _matrix(batch.column(2), size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([v.tobytes() for v in vector], pa.binary()), pa.array(cell, pa.int32()), pa.array(apart, pa.float64())],
                    names=["node", "copies", "vector", "cell", "apart"],
                )

    placed = written(in_tasks(classes.select("node", "copies", "embedding"), place, "node bigint, copies bigint, vector binary, cell int, apart double"))
    # at most ``sample`` rows
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("radius")).collect()
    n, radius = np.zeros(len(leaves), np.int64), np.full(len(leaves), -1.0)
    for row in stats:
        n[row["cell"]], radius[row["cell"]] = row["n"], row["radius"]
    epsilon = float(np.sqrt(2 - 2 * spec.threshold)) + 1e-6
    near = tree.traverse(radius, epsilon)

    first, parts, block, held = np.zeros(len(n), np.int64), np.ones(len(n), np.int64), 0, 0
    for cell in tree.order():
        if held and held + n[cell] > spec.block:
            block, held = block + 1, 0
        first[cell], parts[cell] = block, max(1, -(-int(n[cell]) // spec.block))
        held += int(n[cell])
        if parts[cell] > 1:
            block, held = block + int(parts[cell]), 0
    layout = spark.sparkContext.broadcast((first, parts, near))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, near = layout.value
        together = _block_partners(first, parts, near)
        for whole in batches:
            for start in range(0, whole.num_rows, STRIP):
                batch = whole.slice(start, STRIP)
                node, cell = np.asarray(batch.column(0)), np.asarray(batch.column(3))
                own = first[cell] + (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[cell]
                other = [together[b] for b in own.tolist()]
                counts = [len(o) for o in other]
                rows = np.repeat(np.arange(len(node)), counts)
                other, own = np.concatenate(other), own[rows]
                pair = (np.minimum(own, other) << 31) | np.maximum(own, other)
                side = (own > other).astype(np.int32)
                taken = batch.select(["node", "copies", "vector", "cell"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(side), *taken.columns], names=["pair", "side", *taken.schema.names])

    dealt = in_tasks(placed, deal, "pair bigint, side int, node bigint, copies bigint, vector binary, cell int")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = layout.value[2]
        for group in runs(batches):
            found = _compare(group, near, size, spec.threshold)
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "root", "links"])

    return in_tasks(dealt.repartition("pair").sortWithinPartitions("pair", "side", "cell"), compare, "node bigint, root bigint, links bigint")


def _block_partners(first: np.ndarray, parts: np.ndarray, near: np.ndarray) -> dict[int, np.ndarray]:
    """For each block, the blocks that hold a cell near to one of its own."""
    found: dict[int, set[int]] = {}
    for cell in range(len(first)):
        others = np.flatnonzero(near[cell])
        blocks = {int(b) for c in others for b in range(first[c], first[c] + parts[c])}
        for own in range(int(first[cell]), int(first[cell] + parts[cell])):
            found.setdefault(own, set()).update(blocks)
    return {b: np.asarray(sorted(o | {b}), np.int64) for b, o in found.items()}


def _compare(group: pa.Table, near: np.ndarray, size: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact links between the two sides of a group, or within its one side, cell by cell."""
    side, node, copies, cell = (np.asarray(group.column(c)) for c in ("side", "node", "copies", "cell"))
    vectors = np.frombuffer(b"".join(group.column("vector").to_pylist()), np.float64).reshape(-1, size)
    unit = _unit(vectors).astype(np.float32)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1)
    same = not len(right)
    right = left if same else right
    norms = np.linalg.norm(vectors, axis=1)
    links, a, b = np.zeros(len(node), np.int64), [], []
    for c in np.unique(cell[left]):
        own = left[cell[left] == c]
        others = right[near[c][cell[right]]]
        if not len(others):
            continue
        across = unit[others].T
        for start in range(0, len(own), STRIP):
            rows = own[start : start + STRIP]
            i, j = np.nonzero(unit[rows] @ across >= threshold - MARGIN)
            i, j = rows[i], others[j]
            if same:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), EXACT_AT_ONCE):
                p, q = i[at : at + EXACT_AT_ONCE], j[at : at + EXACT_AT_ONCE]
                cosine = np.einsum("ij,ij->i", vectors[p], vectors[q]) / (norms[p] * norms[q])
                ok = cosine >= threshold
                a.append(p[ok])
                b.append(q[ok])
    if not a:
        return (np.empty(0, np.int64),) * 3
    a, b = np.concatenate(a), np.concatenate(b)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    root = local_roots(len(node), a, b)
    linked = np.flatnonzero(links)
    return node[linked], node[root[linked]], links[linked]


def near_duplicates(vectors: DataFrame, spec: CoverSpec = CoverSpec()) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    ``n_links``: other vectors with cosine at or over the threshold, in double precision.
    ``component_id``: smallest id reachable by links. Equal vectors are one class before
    anything is compared. Blocks hold whole small cells or a part of a large one; a vector
    is sent once to each block near its own, and a pair of blocks gives back sums and a
    spanning forest, never its pairs.

    Null, zero or non-finite vectors, and rows without an id, link with nothing. Vectors of
    different lengths never link; each length has a tree of its own. Rows with one id are
    one vector, whose links are those of all its rows.
    """
    usable = _usable(vectors).select(
        "vec_id", "embedding", F.size("embedding").alias("size"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(17), "embedding").alias("h2")
    )
    known = usable.select("vec_id", "size", "h1", "h2").distinct()
    key = ["size", "h1", "h2"]
    classes = known.groupBy(*key).agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes)
    whole = written(
        usable.join(classes, key).where("vec_id = node").dropDuplicates(["size", "node", "h1", "h2"]).select("node", "copies", "size", "embedding")
    )
    sizes = sorted(r["size"] for r in whole.select("size").distinct().collect())
    none = whole.sparkSession.createDataFrame([], "node bigint, root bigint, links bigint")
    found = [_links(whole.where(F.col("size") == size), size, spec) for size in sizes]
    linked = written(reduce(DataFrame.unionByName, found, none))
    sums = linked.groupBy("node").agg(F.sum("links").alias("links"))
    member = written(known.join(classes, key).select("vec_id", "node", "copies"))
    joined = components(
        linked.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(member.select(F.col("vec_id").alias("u"), F.col("node").alias("v")))
    )
    per_vector = member.join(sums, "node", "left").groupBy("vec_id").agg(
        F.sum(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links")
    )
    component = F.coalesce("component", "vec_id")
    compared = per_vector.join(joined.withColumnRenamed("node", "vec_id"), "vec_id", "left").select(
        "vec_id", "n_links", component.alias("component_id"), (component == F.col("vec_id")).alias("kept")
    )
    ids = vectors.where("vec_id is not null").select("vec_id").distinct().join(per_vector.select("vec_id"), "vec_id", "left_anti")
    alone = ids.unionByName(vectors.where("vec_id is null").select("vec_id"))
    return compared.unionByName(alone.select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    ))


SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95
), reach as (select a as x, b as y from links union select reach.x, links.b from reach join links on reach.y = links.a),
comp as (select x, min(y) as y from reach group by x)
select vec_id, (select count(*) from links where a = vec_id)::bigint as n_links,
       least(vec_id, coalesce(comp.y, vec_id)) as component_id, least(vec_id, coalesce(comp.y, vec_id)) = vec_id as kept
from embeddings left join comp on comp.x = vec_id
"""
