import re
import tracemalloc
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from cohortry.llm import decontaminate, queries
from cohortry.llm.decontaminate import match

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, size):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(size, len(v))
            for i in range(len(v) - n + 1 if v else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(item_id)
        out.append((doc_id, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def test_random_texts_against_brute_force(spark):
    rng = np.random.default_rng(4)
    text = lambda n: " ".join(rng.choice(list("aBcé7"), n))
    docs = [(int(i), text(int(rng.integers(0, 40)))) for i in range(40)]
    items = [(int(i), text(int(n))) for i, n in enumerate([0, 1, 2, 3, 4, 5, 6, 9])]
    found = match(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), window=4)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.collect()), key=repr)
    assert got == brute(docs, items, 4)


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "p q r s t u v"), (2, "r s t u")], DOCS)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["p q r", "q r s", "s t u", "t u v", "x y z"])], ITEMS)
    columns = ["doc_id", "n_hit", "items", "spans"]
    whole = sorted(map(str, match(docs, items, window=3).select("doc_id", "n_hit", "items").collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 2)
    parted = match(docs, items, window=3).select(*columns)
    assert sorted(map(str, parted.select("doc_id", "n_hit", "items").collect())) == whole


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x one y two z three"), (2, "three two one"), (3, "one " + "x " * 30 + "two three"), (4, "one two"), (5, "three")], DOCS)
    found = {r["doc_id"]: r for r in match(docs, spark.createDataFrame([(7, "one two three")], ITEMS), near=5).collect()}
    assert [i for i, r in found.items() if r["near_items"] == [7]] == [1, 2]
    assert all(r["items"] == [] for r in found.values())


def brute_near(docs, items, size, near):
    out = []
    for doc_id, text in docs:
        w, found = words(text), set()
        for item_id, item in items:
            v = words(item)
            n = min(size, len(v))
            for i in range(len(v) - n + 1 if v else 0):
                need = Counter(v[i : i + n])
                if any(not need - Counter(w[j : j + near]) for j in range(len(w))):
                    found.add(item_id)
        out.append((doc_id, tuple(sorted(found))))
    return sorted(out)


def test_proximity_is_the_same_however_documents_are_packed(spark, monkeypatch):
    rng = np.random.default_rng(7)
    text = lambda n: " ".join(rng.choice(list("aBcdefgé7"), n))
    docs = [(int(i), text(int(rng.integers(0, 40)))) for i in range(60)]
    items = [(int(i), text(int(n))) for i, n in enumerate([0, 1, 2, 3, 4, 4, 5, 5, 6, 9])] + [(20, "a a a b"), (21, "7 7 7 7")]
    for near, parts, size in ((4, 1, 1_000_000), (6, 1, 1_000_000), (6, 3, 60), (6, 7, 1), (11, 5, 100)):
        monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", size)
        found = match(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS), window=4, near=near).collect()
        assert sorted((r["doc_id"], tuple(r["near_items"])) for r in found) == brute_near(docs, items, 4, near)
        assert all(set(r["items"]) <= set(r["near_items"]) for r in found)


def test_a_registered_query_finds_proximity_matches(spark):
    found = queries.QUERIES["decontaminate_near"](spark, "/root/testdata/sf0.001").collect()
    plain = {r["doc_id"]: r for r in queries.QUERIES["op4_decontaminate"](spark, "/root/testdata/sf0.001").collect()}
    assert all(r[:-1] == tuple(plain[r["doc_id"]]) and len(r["near_items"]) >= r["n_items"] for r in found)
    assert sum(len(r["near_items"]) for r in found) > 0


def test_edge_cases(spark):
    long = "long " * 40_000 + "alpha beta gamma"
    rows = [(1, None), (2, ""), (3, long), (4, "ALPHA, beta-gamma!"), (4, "ALPHA, beta-gamma!"), (None, "alpha beta gamma"), (4, "clean")]
    items = spark.createDataFrame([(1, "alpha beta gamma"), (1, "alpha beta gamma"), (2, None), (3, ""), (None, "clean")], ITEMS)
    docs = spark.createDataFrame(rows, DOCS).withColumn("_bad_id", F.lit(1)).withColumn("items", F.lit(2))
    found = match(docs, items).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: r["n_hit"] for r in found if r["n_hit"]} == {3: 3, 4: 3, None: 3}
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.select("doc_id", "text").fillna({"text": "-"}).collect()) == [(1, "-"), (2, ""), (4, "clean")]
    assert match(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert match(docs.limit(0), items).count() == 0


def test_union_of_spans(spark):
    spans = lambda *x: F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in x])
    cases = [([(0, 3), (2, 5), (9, 10)], 6), ([(4, 6), (0, 10)], 10), ([(1, 1)], 0)]
    row = spark.range(1).select(*[decontaminate.covered(spans(*c)).alias(str(i)) for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [n for _, n in cases]
    assert reduce(lambda a, b: a + b, row) == 16


def test_a_batch_of_many_segments_is_searched_in_the_memory_of_one(spark, monkeypatch):
    """Arrow hands a task many segments at once; only one of them may be unfolded."""
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 2_000)
    rng = np.random.default_rng(3)
    docs = [(i, "p q r " + " ".join(f"w{n}" for n in rng.integers(0, 50_000, 2_000))) for i in range(61)]
    index = decontaminate.build_index(spark.createDataFrame(docs, DOCS).coalesce(1))
    rows = index.toArrow().combine_chunks().to_batches()[0]
    assert rows.num_rows == 61 and len(index.inputFiles()) >= 16
    vocabulary, windows, owners = [b"p", b"q", b"r"], np.array([[0, 1, 2]]), [{5: None}]
    peaks = []
    for n in (1, rows.num_rows):
        tracemalloc.start()
        found = [b.num_rows for b in decontaminate._found(iter([rows.slice(0, n)]), vocabulary, windows, owners, decontaminate.NEAR)]
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert sum(found) == n
    assert peaks[1] < 2 * peaks[0], peaks
