import hashlib

import numpy as np
import pytest

from cohortry.llm.centroid_clusters import LARGEST, ClusterSpec, cluster, far_apart, nearest, squared

SCHEMA = "vec_id bigint, embedding array<double>"


def brute(rows, spec):
    """Every distance of every round, in Python integers."""
    kept = [(i, [int(np.floor(spec.grain * x)) for x in v]) for i, v in rows]
    order = sorted((hashlib.sha256(f"{spec.seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[: spec.centroids]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((distance(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]
    for _ in range(spec.rounds):
        found = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == k]
            if own:
                centroids[k] = [sum(column) // len(own) for column in zip(*own)]
    found = assign()
    inertia = sum(d for d, _ in found)
    return sorted(
        (-1 if i is None else i, c, d, sum(e for e, k in found if k == c), inertia, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for (i, _), (d, c) in zip(kept, found)
    )


@pytest.mark.parametrize("width,clusters", [(3, 6), (16, 0)])
def test_same_as_every_distance_measured(spark, width, clusters):
    rng = np.random.default_rng(width)
    spec = ClusterSpec(width=width, centroids=7, rounds=4, pivots=4, sample=50)
    x = rng.normal(size=(240, width))
    if clusters:
        x = 10 * rng.normal(size=(clusters, width))[rng.integers(0, clusters, 240)] + 0.1 * x
    x[30:60] = x[30]  # copies, so that ties and empty clusters occur
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found, _, measured = cluster(spark.createDataFrame(rows, SCHEMA).repartition(5), spec)
    assert sorted(map(tuple, found.collect())) == brute(rows, spec)
    assert len(measured) == spec.rounds
    if clusters:
        assert max(measured) < 0.7 * len(rows) * spec.centroids  # the pivots leave some centroids unmeasured


def test_bounds_never_drop_the_nearest():
    rng = np.random.default_rng(1)
    for scale in (3, 1000, LARGEST // 2):
        q = rng.integers(-scale, scale, (300, 5))
        centroids, pivots = q[:20].copy(), far_apart(q[:80], 6)
        centroids[7] = centroids[3]
        to_pivots = np.sqrt(np.stack([squared(q, p) for p in pivots], axis=1).astype(float))
        chosen, best, _ = nearest(q, to_pivots, centroids, pivots)
        every = np.stack([squared(q, c) for c in centroids], axis=1)
        assert (chosen == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    spec = ClusterSpec(width=2, centroids=3, rounds=2)
    bad = [(1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0])]
    good = [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [1.1, 0.0]), (8, [-5.0, 0.25])]
    df = spark.createDataFrame([(*r, 0, "q") for r in bad + good], SCHEMA + ", cluster int, q string")
    found, centroids, _ = cluster(df, spec)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, found.collect())) == brute(good, spec)
    assert len(centroids) == 3
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert cluster(df.limit(0), spec)[0].count() == 0
    assert cluster(spark.createDataFrame(bad, SCHEMA), spec)[0].count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])], SCHEMA)
    assert sorted(r["distance"] for r in cluster(huge, ClusterSpec(width=2, centroids=1, rounds=1))[0].collect())[-1] <= (2 * LARGEST) ** 2
