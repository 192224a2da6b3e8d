import hashlib
import zlib
from itertools import groupby

import pytest

from cohortry.llm import merkle_manifest
from cohortry.llm.merkle_manifest import FANOUT, Paths, fold, hashed, inner, level_sizes, lowered, missing, proofs, sha

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def way(nodes, at):
    """(siblings by level, root), one leaf at a time."""
    found = []
    while len(nodes) > 1:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        found.append((run[: at % 8], run[at % 8 + 1 :]))
        nodes = [digest(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        at //= 8
    return found, nodes[0]


def brute(rows):
    leaves = []
    for doc_id, text, lang, source, n_chars in rows:
        head = field(doc_id) + field(source) + field(lang) + field(n_chars)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if hit else text
        leaves.append((b"" if lang is None else b"=" + lang.encode(), doc_id is not None, doc_id or 0, digest(head + field(text)), digest(head + field(low)), doc_id))
    groups = [list(g) for _, g in groupby(sorted(leaves, key=lambda r: r[:5]), key=lambda r: r[0])]
    subroots = [way([r[3] for r in g], 0)[1] for g in groups]
    out = []
    for place, group in enumerate(groups):
        beside_top, root = way(subroots, place)
        for at, row in enumerate(group):
            beside = way([r[3] for r in group], at)[0] + beside_top
            node = row[4]
            for before, after in beside:
                node = digest(*before, node, *after)
            proof = digest(*[h for before, after in beside for h in [*before, *after]])
            out.append((row[5], row[3], subroots[place], root, proof, node, node == root))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return proofs(hashed(docs, lowered(docs)), **options)


def rows_of(n, langs, **more):
    return [(i, f"Text {i} Of {i % 7}", langs[i % len(langs)], f"s{i % 3}" if i % 5 else None, i) for i in range(n)]


@pytest.mark.parametrize("n,langs", [(300, ["en", "de", None, "en", "en"]), (90, [f"l{k:02d}é" for k in range(17)]), (65, ["en"]), (1, [None])])
def test_same_as_one_leaf_at_a_time(spark, n, langs):
    rows = rows_of(n, langs)
    got = sorted([tuple(r) for r in run(spark, rows).collect()], key=repr)
    assert got == brute(rows)
    assert any(not r[-1] for r in got) or n == 1


def test_edge_cases(spark):
    rows = rows_of(40, ["en", "de"]) + [(3, "Text 3 Of 3", "de", "s0", 3)] * 30 + [(3, "other", "de", "s0", 3), (None, None, None, None, None), (None, "A", "en", None, 1), (77, "", "en", "", 0), (78, "Ä" * 300_000, "en", "s", 5)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", g int, leaf string").repartition(3)
    found = proofs(hashed(docs, lowered(docs)))
    assert sorted([tuple(r) for r in found.collect()], key=repr) == brute(rows)
    assert found.columns == ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert run(spark, []).count() == 0


def test_siblings_are_the_proof(spark):
    for r in run(spark, rows_of(100, ["en", "de"]), siblings=True).collect():
        assert digest(*r["siblings"]) == r["proof_sha256"]
        pairs = list(zip(r["siblings"][::2], r["siblings"][1::2]))
        assert fold(r["leaf"].encode(), tuple((b.encode(), a.encode()) for b, a in pairs)).decode() == r["root"]


@pytest.mark.parametrize("total", [1, 2, 8, 9, 64, 65, 100, 513])
def test_any_cut_gives_the_same_paths(total):
    """Leaves cut anywhere: frontiers complete the tree, and what is missing is all that is fetched."""
    leaves = [sha(str(i).encode()) for i in range(total)]
    sizes = level_sizes(total)
    whole, _ = inner(leaves, 0, total)
    nodes = {(level, low + k): h for level, (low, hs) in enumerate(whole) for k, h in enumerate(hs)}
    assert [len(hs) for _, hs in whole] == sizes
    cuts = sorted({0, total, *(c for c in (1, 3, 8, 17, 40, 63, 64, 99, 300) if c < total)})
    border = {}
    for a, b in zip(cuts, cuts[1:]):
        border |= {(level, k): h for level, k, h in inner(leaves[a:b], a, total)[1]}
    for level in range(1, len(sizes)):  # as _completed does
        for j in range(sizes[level]):
            run = [border.get((level - 1, k)) for k in range(FANOUT * j, min(FANOUT * j + FANOUT, sizes[level - 1]))]
            if any(run):
                assert all(run)
                border[(level, j)] = sha(b"".join(run))
    assert all(nodes[c] == h for c, h in border.items()) and (len(sizes) - 1, 0) in border
    for a, b in zip(cuts, cuts[1:]):
        asked = missing(a, b - a, total)
        assert len(set(asked)) == len(asked) <= 14 * len(sizes)
        paths = Paths(leaves[a:b], a, total, {c: border[c] for c in asked})
        for k in range(a, b):
            assert fold(leaves[k], paths.beside(0, k)) == nodes[(len(sizes) - 1, 0)] == paths.top


def test_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "PART_ROWS", 20)
    rows = rows_of(400, ["en", "en", "en", "fr"])
    assert sorted([tuple(r) for r in run(spark, rows).collect()], key=repr) == brute(rows)
