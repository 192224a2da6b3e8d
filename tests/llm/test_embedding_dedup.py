import numpy as np
import pytest

from cohortry.llm.embedding_dedup import CoverSpec, build_tree, near_duplicates

SCHEMA = "vec_id bigint, embedding array<float>"


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(width, clusters, n=300):
    rng = np.random.default_rng(width)
    if not clusters:
        base = rng.normal(size=(n, width))
    else:
        base = rng.normal(size=(clusters, width))[rng.integers(0, clusters, n)] + 0.15 * rng.normal(size=(n, width))
    base[20:40] = base[20]
    base[50] = 3 * base[51]
    return base.astype(np.float32)


def brute(x, threshold):
    y = unit(x.astype(np.float64))
    near = y @ y.T >= threshold
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        after = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
        if (after == label).all():
            return near.sum(axis=1), label
        label = after


@pytest.mark.parametrize("width,clusters,spec", [(32, 0, CoverSpec()), (8, 20, CoverSpec(sample=64, block=32)), (3, 10, CoverSpec(sample=16, block=50))])
def test_links_and_components(spark, width, clusters, spec):
    x = vectors(width, clusters)
    got = {r["vec_id"]: r for r in near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(3), spec).collect()}
    links, label = brute(x, spec.threshold)
    assert [got[i]["n_links"] for i in range(len(x))] == links.tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_tree_levels_are_nested_cover_and_never_lose_a_pair():
    points = unit(vectors(4, 12).astype(np.float64))
    tree = build_tree(points, 1 / 16)
    radius = 1.0
    for above, level, up in zip(tree.levels, tree.levels[1:], tree.parents[1:]):
        assert set(above) <= set(level) and len(up) == len(level)
        gap = np.linalg.norm(points[:, None] - points[level][None], axis=2).min(axis=1)
        assert gap.max() <= radius + 1e-9
        radius /= 2
    leaves = points[tree.levels[-1]]
    cell = (points @ leaves.T).argmax(axis=1)
    reach = np.full(len(leaves), -1.0)
    np.maximum.at(reach, cell, np.linalg.norm(points - leaves[cell], axis=1))
    epsilon = np.sqrt(0.1)
    near = tree.traverse(reach, epsilon)
    a, b = np.nonzero(np.linalg.norm(points[:, None] - points[None], axis=2) <= epsilon)
    assert near[cell[a], cell[b]].all()
    assert not near.all()


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [2.0, 0.1]), (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (7, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA + ", label int, node string")
    found = near_duplicates(df).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found}
    assert len(found) == 12
    assert got == {**{i: (0, i) for i in (1, 2, 3, 4, 5, 6, 10, 11)}, 7: (2, 7), 8: (2, 7), 9: (2, 7), None: (0, None)}
    assert near_duplicates(df.limit(0)).count() == 0
