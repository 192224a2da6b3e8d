from itertools import combinations

import numpy as np
import pytest

from cohortry.llm.jaccard_join import ForestSpec, dedup, shingles, similar

SCHEMA = "doc_id bigint, text string"


def texts(seed, groups=12, each=8, change=2):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"w{x}" for x in rng.integers(0, 5_000, 90)]
        for e in range(each):
            words = list(base)
            for _ in range(e % 4 * change):
                words[int(rng.integers(len(words)))] = f"x{rng.integers(5_000)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def brute(rows, spec):
    sets = {d: set(shingles((t or "").encode(), spec.words).tolist()) for d, t in rows}
    links = {d: set() for d in sets}
    for a, b in combinations(sets, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= spec.threshold:
            links[a].add(b)
            links[b].add(a)
    component = {}
    for d in sorted(sets):
        todo = [d] if d not in component else []
        while todo:
            x = todo.pop()
            if x not in component:
                component[x] = d
                todo += links[x]
    return {d: (len(links[d]), component[d]) for d in sets}


def found_in(df, spec):
    return {r["doc_id"]: (r["n_links"], r["component_id"]) for r in similar(df, spec).where("doc_id is not null").collect()}


@pytest.mark.parametrize("spec", [ForestSpec(), ForestSpec(block=4), ForestSpec(block_shingles=200), ForestSpec(threshold=0.6)])
def test_all_links_of_random_texts(spark, spec):
    rows = texts(3)
    assert found_in(spark.createDataFrame(rows, SCHEMA).repartition(5), spec) == brute(rows, spec)


def test_prefixes_are_shortened_until_the_target_is_met():
    for threshold in (0.5, 0.8, 0.9):
        spec = ForestSpec(threshold=threshold, missed=1e-2)
        missed = lambda k: (1 - threshold**k) ** spec.trees  # noqa: B023, E731
        assert missed(spec.depth) <= spec.missed
        assert spec.depth == spec.deepest or missed(spec.depth + 1) > spec.missed
    with pytest.raises(ValueError):
        ForestSpec(threshold=0.1, trees=2).depth  # noqa: B018


def test_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(5, base), (3, base), (3, base), (9, base.upper()), (None, base), (None, base), (1, None), (2, ""), (4, "..."), (6, "two words"), (7, "two words"), (8, "w " * 60_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", _id string, _kept int")
    got = {r["doc_id"]: r for r in similar(df).where("doc_id is not null").collect()}
    assert {d: r["n_links"] for d, r in got.items()} == {1: 0, 2: 0, 3: 2, 4: 0, 5: 2, 6: 1, 7: 1, 8: 0, 9: 2}
    assert {d: r["component_id"] for d, r in got.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 3, 6: 6, 7: 6, 8: 8, 9: 3}
    kept = dedup(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda d: (d is None, d)) == [1, 2, 3, 4, 6, 8, None, None]
    assert similar(df.limit(0)).count() == 0


def test_every_copy_has_a_row(spark):
    rows = [(i, "one text that many documents share word for word " * 3) for i in range(300)] + [(1000, "something else entirely here now")]
    got = found_in(spark.createDataFrame(rows, SCHEMA), ForestSpec())
    assert len(got) == 301
    assert {got[i] for i in range(300)} == {(299, 0)}
