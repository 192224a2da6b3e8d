import numpy as np

from cohortry.llm.components import components


def test_random_graphs_paths_and_stars(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))]
    edges += [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(4000, 4050)] + [(7, 7), (1, 1000), (1, 1000)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: root(x) for x in linked}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
