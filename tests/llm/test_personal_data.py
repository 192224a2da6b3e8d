import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import personal_data
from cohortry.llm.labelled_spans import KINDS, example, luhn
from cohortry.llm.personal_data import TAGS, Tagger, TaggerSpec, added, base, find, fit, joined, laid_out, reconciled, spans_of, tagged, train, windows

SCHEMA = "doc_id bigint, text string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            fine = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append((kind, *m.span()))
    return found


def test_base_is_what_the_patterns_say():
    rng = random.Random(4)
    pieces = ["4111111111111111", "5500-0055-5555-5559", "1.2.3.4", "256.1.1.1", "a.b@c.d", "x@y", "@", "+1 (319) 555-5132", "+", "1", "22", ".", "-", " ", "(", "é", "a", "@b.co", "00.0.0.0", "\n", "+49 30 1234567"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert base(text) == brute(text), text


@pytest.mark.parametrize("piece", ["1", "a", "1.", "1 ", "+1 ", "a@", "@", "a@b.", "+1.", "(at)"])
def test_long_texts_take_linear_time(piece):
    started = time.time()
    base(piece * 500_000)
    windows(piece * 20_000)
    assert time.time() - started < 20


def test_gradients(monkeypatch):
    monkeypatch.setattr(personal_data, "WINDOW", 7)
    rng, tagger = np.random.default_rng(0), Tagger(TaggerSpec(embedding=3, hidden=4))
    tagger.p = {k: (v + 0.3 * rng.normal(size=v.shape)).astype(np.float64) for k, v in tagger.p.items()}
    ids, tags = rng.integers(0, 9, (4, 7)), rng.integers(0, len(TAGS), (4, 7))
    _, grads = tagger.loss(ids, tags)
    for name, values in tagger.p.items():
        flat = values.reshape(-1)
        for at in rng.integers(0, min(20, flat.size), 3):
            keep, step = flat[at], 1e-4
            flat[at] = keep + step
            high = tagger.loss(ids, tags)[0]
            flat[at] = keep - step
            low = tagger.loss(ids, tags)[0]
            flat[at] = keep
            assert abs((high - low) / (2 * step) - grads[name].reshape(-1)[at]) < 2e-3, name


def test_decoding_is_the_best_of_all_ways(monkeypatch):
    monkeypatch.setattr(personal_data, "WINDOW", 4)
    from itertools import product

    rng, tagger = np.random.default_rng(1), Tagger(TaggerSpec(embedding=3, hidden=4))
    tagger.p["move"] = rng.normal(size=tagger.p["move"].shape).astype(np.float32)
    ids = rng.integers(0, 30, (3, 4))
    scores, _, _ = tagger.emissions(ids)
    score = lambda row, way: tagger.p["start"][way[0]] + sum(scores[t, row, k] for t, k in enumerate(way)) + sum(tagger.p["move"][a, b] for a, b in zip(way, way[1:]))
    for row, tags in enumerate(tagger.decode(ids)):
        assert tuple(tags) == max(product(range(len(TAGS)), repeat=4), key=lambda w: score(row, w))


def test_tags_and_spans():
    spans = [("card", 2, 5), ("phone", 5, 7), ("phone", 7, 9)]
    assert spans_of(np.asarray(tagged(12, spans))) == spans
    text = "x " * 40 + "4111 1111 1111 1111 +1 (319) 555-5132" + " y" * 60
    cut = windows(text)
    assert all(text[s : s + len(w)] == w for s, w in cut) and all(any(s <= k < s + len(w) for s, w in cut) for k in range(60, 117))
    whole = ("card", 80, 99)
    assert reconciled(text, [("card", 80, 90), ("card", 85, 99), ("ip", 81, 85), ("phone", 100, 117)], []) == [whole, ("phone", 100, 117)]
    assert reconciled(text, [whole, ("phone", 100, 117)], [("phone", 90, 101)]) == []


@pytest.fixture(scope="module")
def tagger():
    rng = np.random.default_rng(8)
    return train([example(rng, []) for _ in range(TaggerSpec().examples)], TaggerSpec())


def test_held_out_examples(tagger):
    rng = np.random.default_rng(99)
    texts = [(t, s) for t, s in (example(rng, []) for _ in range(400)) if len(t) <= personal_data.WINDOW]
    bases = [base(t) for t, _ in texts]
    every = [set(b) | set(more) for b, more in zip(bases, added(tagger, [t for t, _ in texts], bases))]
    gold = [set(s) for _, s in texts]
    hits = sum(len(a & b) for a, b in zip(every, gold))
    assert hits / sum(map(len, gold)) > 0.85
    assert hits / sum(map(len, every)) > 0.9
    # beyond the patterns: of the spans they miss, most are found
    lost = [g - set(b) for g, b in zip(gold, bases)]
    assert sum(len(g & e) for g, e in zip(lost, every)) > 0.6 * sum(map(len, lost))


def test_adds_what_the_patterns_miss_and_leaves_the_rest(tagger):
    texts = [
        "call her on +1 (569) 555-6633 4111111111111111 for the rest", "one two three four five", 'token = "87e15d78b9d8ef29b6c10061e3551a60fa07e990"',
        "licensed under CC BY-NC 4.0. of the year 2021-03-04", "",
    ]
    bases = [base(t) for t in texts]
    assert bases[0] == []
    found = added(tagger, texts, bases)
    assert ("card", 30, 46) in found[0] and ("phone", 12, 29) in found[0]
    assert found[1:] == [[]] * 4


def test_edge_cases_of_the_job(spark, tagger):
    mail = "mail a.b@c.example.com or 10.0.0.1 now"
    rows = [(1, None), (2, ""), (3, mail), (3, mail), (None, mail), (4, "é" * 50 + " +1 (319) 555-5132"), (5, ("word " * 400 + "4111111111111111 ") * 300), (6, "\n\t ")]
    df = spark.createDataFrame([(*r, "s", 7) for r in rows], SCHEMA + ", spans string, kind int").repartition(3)
    found = find(df, tagger, redact=True)
    assert found.columns == ["doc_id", "text", "kind", "spans", "redacted"] and found.count() == len(rows)
    got = found.withColumn("s", joined(F.col("spans"))).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["s"] == by_id[2]["s"] == by_id[6]["s"] == "" and by_id[1]["redacted"] is None
    assert by_id[3]["s"] == by_id[None]["s"] == "email:5:22,ip:26:34"
    assert by_id[3]["redacted"] == "mail [EMAIL] or [IP] now"
    assert by_id[4]["s"] == "phone:51:68"
    assert len(by_id[5]["spans"]) == 300 and all(r["base"] for r in by_id[5]["spans"])
    assert find(df.limit(0), tagger).count() == 0


def test_fit_on_tables(spark):
    spec = TaggerSpec(examples=200, epochs=1)
    docs = spark.createDataFrame([(i, f"mail anna.{i}@mail.example.com and words of text") for i in range(30)] + [(99, None)], SCHEMA)
    assert isinstance(fit(docs, spec), Tagger)
    assert isinstance(fit(docs.limit(0), spec), Tagger)


def test_query_against_the_patterns(spark):
    from cohortry.llm import queries

    sf_dir = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    import hashlib

    for r in queries.QUERIES["op12_personal_data"](spark, sf_dir).collect():
        spans = brute(texts[r["doc_id"]] or "")
        names = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(s[0] == k for s in spans) for k in KINDS]
        assert set(names) <= set(r["spans"].split(",")) | {""}
