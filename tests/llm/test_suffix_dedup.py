import hashlib

import numpy as np
import pytest

from cohortry.llm.suffix_dedup import SpanSpec, remove_repeats, repeated_windows

SCHEMA = "doc_id bigint, text string"


def brute(rows, length):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            window = raw[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        runs = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]) == 1)
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[doc_id] = (len(raw), int(gone.sum()), len(runs), hashlib.sha256(kept).hexdigest())
    return out


def rows_of(df, spec):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(df, spec).collect()}


@pytest.mark.parametrize("spec", [SpanSpec(20, 6), SpanSpec(30, 10, piece=150, chunk=500), SpanSpec(8, 3)])
def test_random_texts_against_brute_force(spark, spec):
    rng = np.random.default_rng(spec.length)
    base = ["".join(rng.choice(list("abcé \n"), size=n)) for n in rng.integers(5, 300, 30)]
    rows = []
    for i in range(120):
        text = list(base[int(rng.integers(30))])
        if i % 5 == 1:
            for _ in range(3):
                text[int(rng.integers(len(text)))] = "x"
        elif i % 5 == 2:
            text = "".join(base[int(rng.integers(30))][a : a + 60] for a in rng.integers(0, 100, 4))
        elif i % 5 == 3:
            text = "ab" * int(rng.integers(1, 200))
        rows.append((i * 7 % 127, "".join(text)))
    assert rows_of(spark.createDataFrame(rows, SCHEMA).repartition(4), spec) == brute(rows, spec.length)


def test_backward_extension_marks_all_but_the_first():
    texts = [b"abcabcabc", b"xxabcabx", b"abc"]
    length, windows = 3, []
    for i, t in enumerate(texts):
        windows += [(t[a : a + length], i, a) for a in range(len(t) - length + 1)]
    count = np.asarray([len(t) - length + 1 for t in texts])
    found = repeated_windows(texts, length, np.arange(len(windows)), np.cumsum(count) - count)
    first = {}
    for place, (w, *_) in enumerate(windows):
        first.setdefault(w, place)
    assert found.tolist() == [first[w] != place for place, (w, *_) in enumerate(windows)]


def test_edge_cases(spark):
    passage = "a passage of more than one hundred bytes that stands in several documents, so that all but the first lose it. "
    long = "".join(chr(97 + i * i % 23) for i in range(5_000)) * 40
    rows = [(1, None), (2, ""), (3, "before " + passage), (4, passage + "after"), (None, passage), (5, long), (6, "short"), (7, "short"), (8, "own text " * 2), (9, passage), (9, passage)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", spans int").repartition(4)
    found = remove_repeats(df, with_text=True).collect()
    assert len(found) == len(rows)
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in found}
    assert kept[1] == kept[2] == "" and kept[3] == "before " + passage and kept[4] == "after"
    assert kept[None] == "" and kept[9] == "" and kept[6] == kept[7] == "short"
    assert kept[5] == long[: len(kept[5])] and len(kept[5]) < 6_000
    assert remove_repeats(df.limit(0)).count() == 0
