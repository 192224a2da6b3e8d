import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortry.llm.token_output import ENTRY_BYTES, Encoder, canonical, code_lengths, pack, read_tokens, tokenise, unpack, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = Encoder(open(PATH).read(), "<u2")
SCHEMA = "doc_id bigint, text string"


def ids_of(text, end=2):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, end]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab Zé.,'s1\n\t\x1c  日ª²_", max_size=30) | st.text(max_size=20), min_size=1, max_size=6))
def test_cuts_change_no_id(texts):
    import pyarrow as pa

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    found = ENCODER(pa.array(texts, pa.string()), b"\2\0").to_pylist()
    assert [np.frombuffer(f, "<u2").tolist() for f in found] == [ids_of(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=40), st.integers(6, 12))
def test_code_lengths_are_limited_and_full(counts, limit):
    bits = code_lengths(np.asarray(counts), limit)
    assert bits.max() <= limit and bits.min() >= 1
    if len(counts) > 1:
        assert sum(2.0**-b for b in bits) == 1
        order = np.argsort(counts, kind="stable")
        assert all(bits[a] >= bits[b] for a, b in zip(order, order[1:]) if counts[a] < counts[b])


def test_lengths_are_optimal_without_a_tight_limit():
    import heapq

    counts = np.random.default_rng(0).integers(1, 1000, 60)
    heap, total = list(counts.astype(int)), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        total += both
        heapq.heappush(heap, both)
    assert int((code_lengths(counts, 30) * counts).sum()) == total


@pytest.mark.parametrize("n", [1, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n) - 1, 99)
    used = np.unique(ids)
    lengths = code_lengths(np.bincount(ids)[used], 12)
    names, bits, codes = canonical(used, lengths)
    code, wide = np.zeros(100, np.int64), np.zeros(100, np.int64)
    code[names], wide[names] = codes, bits
    widest = int(bits[-1])
    table = np.repeat((names << 5) | bits, np.left_shift(1, widest - bits))
    table = np.pad(table, (0, 2**widest - len(table)))
    stream, offsets = pack(ids, code, wide)
    for found in unpack([stream, stream], [offsets, offsets], [n, n], table, widest, "<u2"):
        assert found.tolist() == ids.tolist()


def test_files_hold_every_id_in_order(spark):
    long = "word and words, " * 30_000
    rows = [(5, "b"), (5, None), (5, None), (-3, long), (None, "first"), (7, "a\n \n b  c <|endoftext|> x"), (6, ""), (9, " lead")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", ids int")
    path = write_tokens(df, PATH, 2, shard_ids=1_000)
    got = sorted(read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, -3, 5, 5, 5, 6, 7, 9]
    assert sorted(r["ids"] for r in got) == sorted(ids_of(t) for _, t in rows)
    place = 0
    for r in got:
        assert r["start"] == place and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes())
        place += r["n_tokens"]
    assert read_tokens(spark, write_tokens(df.limit(0), PATH, 2)).count() == 0


def test_memory_bounds_of_a_worker_change_no_id(spark):
    rows = [(i, f"word{i % 90} and, marks{i}! {'tail ' * (i % 7)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    small = tokenise(df, PATH, 2, encoded=500, known=20 * ENTRY_BYTES)
    assert small.orderBy("doc_id").collect() == tokenise(df, PATH, 2).orderBy("doc_id").collect()
