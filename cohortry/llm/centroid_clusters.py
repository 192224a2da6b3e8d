"""Clusters of vectors around centroids, with a LAESA table of distances to fixed pivots.

Every vector's distances to a few fixed pivots are written once. In each round the pivots
also measure the centroids, and the largest difference of two such distances is a lower
bound on the distance from vector to centroid. The centroid with the smallest bound is
measured first; of the others only those whose bound does not exceed that distance get an
exact integer distance. Tasks send sums per centroid; only centroids return to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.shared import in_tasks, spread_rows, written

#: Components beyond it count as it, so that squared distances stay within a long.
LARGEST = 2**26
ROWS = 4_096


@dataclass(frozen=True)
class ClusterSpec:
    """``pivots`` are chosen from ``sample`` vectors; both only decide how much is measured, never a result."""

    width: int = 64
    centroids: int = 40
    rounds: int = 5
    grain: int = 256
    seed: int = 2
    pivots: int = 16
    sample: int = 512


def quantised(vectors: DataFrame, spec: ClusterSpec) -> DataFrame:
    """(vec_id, q): floor(grain * x) of vectors with exactly ``width`` components, none null or non-finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    whole = lambda x: F.floor(F.greatest(F.least(x.cast("double") * spec.grain, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    kept = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == spec.width) & F.forall("embedding", fine))
    return kept.select("vec_id", F.transform("embedding", whole).alias("q"))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to one vector."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` of the points, each the farthest from those before it."""
    picked, gap = [0], squared(points, points[0])
    while len(picked) < n and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(points, points[picked[-1]]))
    return points[picked]


def nearest(q: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every row (ties: the smaller number), its squared distance, and how many were measured.

    The bounds are floating-point numbers, so they are lowered by more than their rounding
    before anything is dropped; what decides is integers.
    """
    of_pivots = np.sqrt(np.stack([squared(centroids, p) for p in pivots], axis=1).astype(np.float64))
    bound = np.zeros((len(q), len(centroids)))
    for k in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, k, None] - of_pivots[None, :, k]), out=bound)
    bound -= 1e-9 * (to_pivots.max(axis=1, initial=0.0)[:, None] + of_pivots.max(axis=1, initial=0.0)[None, :]) + 1e-9
    first = bound.argmin(axis=1)
    best = np.empty(len(q), np.int64)
    for c in np.unique(first):
        rows = first == c
        best[rows] = squared(q[rows], centroids[c])
    reach = np.sqrt(best.astype(np.float64)) * (1 + 1e-12)
    measured, chosen = len(q), first.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= reach) & (first != c))
        if not len(rows):
            continue
        measured += len(rows)
        found = squared(q[rows], centroids[c])
        better = (found < best[rows]) | ((found == best[rows]) & (c < chosen[rows]))
        best[rows[better]], chosen[rows[better]] = found[better], c
    return chosen, best, measured


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind).reshape(-1, width)


class Clusters:
    """The pivot table of a set of vectors, and passes over it."""

    def __init__(self, vectors: DataFrame, spec: ClusterSpec):
        self.spec = spec
        self.whole = written(quantised(spread_rows(vectors.select("vec_id", "embedding"), "vec_id"), spec))
        by_hash = [F.sha2(F.concat(F.lit(f"{spec.seed}:"), F.col("vec_id").cast("string")), 256), F.to_json("q")]
        named = self.whole.where("vec_id is not null")
        # centroids and the sample for pivots: as many rows as the settings say
        self.start = np.asarray([r["q"] for r in named.orderBy(*by_hash).limit(spec.centroids).collect()], np.int64).reshape(-1, spec.width)
        sample = [r["q"] for r in self.whole.orderBy(F.xxhash64("q"), F.to_json("q")).limit(spec.sample).collect()]
        self.pivots = far_apart(np.asarray(sample, np.int64), spec.pivots) if sample else np.zeros((1, spec.width), np.int64)
        self.table = written(self._with_pivots())

    def _with_pivots(self) -> DataFrame:
        pivots, width = self.pivots, self.spec.width

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = _matrix(batch.column(1), width, np.int64)
                far = np.sqrt(np.stack([squared(q, p) for p in pivots], axis=1).astype(np.float64)).reshape(-1)
                cuts = pa.array(np.arange(batch.num_rows + 1) * len(pivots), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(cuts, pa.array(far))], names=["vec_id", "q", "to_pivots"])

        return in_tasks(self.whole, task, "vec_id bigint, q array<int>, to_pivots array<double>")

    def _assigned(self, batches: Iterator[pa.RecordBatch], centroids: np.ndarray):
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                q = _matrix(batch.column(1), centroids.shape[1], np.int64)
                yield batch, q, *nearest(q, _matrix(batch.column(2), len(self.pivots), np.float64), centroids, self.pivots)

    def _in_tasks(self, centroids: np.ndarray, rows_of, schema: str) -> DataFrame:
        """Run ``rows_of`` on assigned batches; the tasks get arrays only, never this object's tables."""
        light = object.__new__(Clusters)
        light.pivots = self.pivots
        return in_tasks(self.table, lambda batches: rows_of(light._assigned(batches, centroids)), schema)

    def moved(self, centroids: np.ndarray) -> tuple[np.ndarray, int]:
        """Centroids after one round, and how many exact distances it took."""

        def sums(parts) -> Iterator[pa.RecordBatch]:
            count = np.zeros(len(centroids), np.int64)
            total = np.zeros(centroids.shape, np.int64)
            looked = 0
            for _, q, chosen, _, measured in parts:
                count += np.bincount(chosen, minlength=len(centroids))
                # sums of ROWS components are exact in double precision
                member = (chosen[None, :] == np.arange(len(centroids))[:, None]).astype(np.float64)
                total += (member @ q.astype(np.float64)).astype(np.int64)
                looked += measured
            c, i = np.nonzero(np.repeat(count[:, None] > 0, centroids.shape[1], axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([*c, -1], pa.int32()), pa.array([*i, 0], pa.int32()), pa.array([*total[c, i], looked], pa.int64()), pa.array([*count[c], 0], pa.int64())],
                names=["c", "i", "total", "n"],
            )

        exact = [F.sum(F.col(k).cast("decimal(20,0)")).alias(k) for k in ("total", "n")]
        found = self._in_tasks(centroids, sums, "c int, i int, total bigint, n bigint").groupBy("c", "i").agg(*exact).collect()
        after, looked = centroids.copy(), 0
        for r in found:  # a row per centroid and component
            if r["c"] < 0:
                looked = int(r["total"])
            else:
                after[r["c"], r["i"]] = int(r["total"]) // int(r["n"])
        return after, looked

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        """(vec_id, cluster, distance) of every vector."""

        def rows(parts) -> Iterator[pa.RecordBatch]:
            for batch, _, chosen, best, _ in parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chosen, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

        return self._in_tasks(centroids, rows, "vec_id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, spec: ClusterSpec = ClusterSpec()) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Vectors with their clusters, the final centroids, and the exact distances measured in each round.

    Rows: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, one per row of
    ``vectors`` that has exactly ``spec.width`` components, none null or non-finite; the others
    are left out. Centroids start as the vectors with the smallest hashes of their ids; where
    an id repeats, its vectors follow each other by their components. Fewer vectors than
    centroids give fewer centroids, an empty table none and no rows. A null id is clustered but
    never starts a centroid. Equal distances go to the smaller number, and repeated rows stay
    repeated. A component x beyond +-2**26 / grain counts as that bound. Other columns are ignored.
    """
    clusters = Clusters(vectors, spec)
    centroids, measured = clusters.start, []
    if not len(centroids):
        schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema), centroids, measured
    for _ in range(spec.rounds):
        centroids, looked = clusters.moved(centroids)
        measured.append(looked)
    found = written(clusters.assigned(centroids))
    # a row per centroid
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    most = 2**63 - 1
    known = [(k, min(s, most), min(sum(sums.values()), most), names[k]) for k, s in sums.items()]
    about = found.sparkSession.createDataFrame(known, "k int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    joined = found.join(F.broadcast(about), F.col("cluster") == F.col("k"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids, measured


def sql(spec: ClusterSpec = ClusterSpec()) -> str:
    """The same result in DuckDB, with every distance measured."""
    parts = [
        f"""v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor({spec.grain} * x::double)::bigint) as q from embeddings
  where embedding is not null and len(embedding) = {spec.width} and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
)""",
        f"x as (select r, unnest(q) as x, unnest(range({spec.width})) as i from v)",
        f"s as (select r, row_number() over (order by sha256('{spec.seed}:' || vec_id)) - 1 as c from v order by c limit {spec.centroids})",
        "c0 as (select c, i, x from s join x using (r))",
    ]
    for k in range(spec.rounds + 1):
        parts.append(f"d{k} as (select r, c, sum((x.x - c{k}.x) * (x.x - c{k}.x))::bigint as d from x join c{k} using (i) group by r, c)")
        parts.append(f"a{k} as (select r, min(d * 64 + c) % 64 as c, min(d * 64 + c) // 64 as d from d{k} group by r)")
        if k < spec.rounds:
            parts.append(f"m{k} as (select c, i, sum(x)::bigint as t, count(*) as n from a{k} join x using (r) group by c, i)")
            parts.append(
                f"c{k + 1} as (select c, i, case when n is null then x else (t - ((t % n + n) % n)) // n end as x from c{k} left join m{k} using (c, i))"
            )
    last = spec.rounds
    return "with " + ",\n".join(parts) + f"""
select vec_id, a{last}.c::int as cluster, d::bigint as distance, (sum(d) over (partition by a{last}.c))::bigint as cluster_inertia,
       (sum(d) over ())::bigint as inertia, h as centroid_sha256
from a{last} join v using (r) join (select c, sha256(string_agg(x::varchar, ',' order by i)) as h from c{last} group by c) names on names.c = a{last}.c
"""


SQL = sql()
