"""Benchmark decontamination with a positional inverted index.

The index is a table of segments. A segment holds some whole documents, their terms, and
for each term the sorted positions at which it stands. A search takes the terms of every
benchmark window from the rarest on and intersects their position lists, shifted by each
term's offset in the window; what is left are the exact occurrences. For proximity
it looks around each position of the rarest term for a span that holds all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.shared import in_tasks, portions, spread_rows, written

WINDOW = 10
NEAR = 2 * WINDOW
SEGMENT_WORDS = 1_000_000
FILE_SEGMENTS = 4
BLOCK_WINDOWS = 200_000
CANDIDATES = 500_000
PAD = -1

# Bytes of a word: digits, a-z (A-Z lower-cased) and all of UTF-8 beyond ASCII; others part words.
_APART = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

INDEX = (
    "part int, seq int, doc_ids array<bigint>, hashes array<bigint>, n_words array<int>, "
    "terms array<binary>, n array<int>, positions binary"
)
INDEX_KINDS = [
    pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()),
    pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(),
]
INDEX_NAMES = ["part", "seq", "doc_ids", "hashes", "n_words", "terms", "n", "positions"]
HITS = "part int, seq int, place int, items array<bigint>, near array<bigint>, spans array<struct<a:int,b:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_APART).split()


class _Numbers(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = found = len(self)
        return found


def build_index(docs: DataFrame) -> DataFrame:
    """Segments of about SEGMENT_WORDS words with the postings of all their terms, written once.

    Positions count the words of the segment's documents one after the other, with a gap of
    one between documents, so that no window runs from one into the next. A longer document
    has a segment of its own. Null text has no words.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        numbers, ids, doc_ids, hashes, sizes, total = _Numbers(), [], [], [], [], 0

        def close() -> pa.RecordBatch:
            each = np.concatenate(ids) if ids else np.empty(0, np.int32)
            kind = np.uint16 if len(numbers) < 65_536 else np.int32
            place = np.arange(len(each)) + np.repeat(np.arange(len(sizes)), sizes)
            by_term = np.argsort(each.astype(kind), kind="stable")
            positions = place[by_term].astype("<u4").tobytes()
            values = (part, seq, doc_ids, hashes, sizes, list(numbers), np.bincount(each, minlength=len(numbers)).tolist(), positions)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, INDEX_KINDS)], names=INDEX_NAMES)

        for batch in portions(batches, 1, 8_000_000):
            for doc_id, text, code in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                words = words_of(text or b"")
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                doc_ids.append(doc_id)
                hashes.append(code)
                sizes.append(len(words))
                total += len(words)
                if total >= SEGMENT_WORDS:
                    yield close()
                    seq, total, numbers, ids, doc_ids, hashes, sizes = seq + 1, 0, _Numbers(), [], [], [], []
        if doc_ids:
            yield close()

    rows = spread_rows(docs.select("doc_id", "text"), "doc_id").select("doc_id", "text", F.xxhash64("text"))
    return written(in_tasks(rows, task, INDEX), rows=FILE_SEGMENTS)


def _windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def _blocks(items: DataFrame, size: int) -> Iterator[dict[tuple[bytes, ...], dict[int, None]]]:
    """Distinct windows with the items that have them, in order, at most about BLOCK_WINDOWS at a time."""
    held: dict[tuple[bytes, ...], dict[int, None]] = {}
    for row in items.select("item_id", "text").toLocalIterator():
        if row["item_id"] is None:
            continue
        for window in _windows(words_of((row["text"] or "").encode()), size):
            held.setdefault(window, {})[row["item_id"]] = None
            if len(held) >= BLOCK_WINDOWS:
                yield held
                held = {}
    if held:
        yield held


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and the places first..first+count of each row, one after the other."""
    rows = np.repeat(np.arange(len(count)), count)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


class Segment:
    """Postings of one segment, as sorted keys (term, position)."""

    def __init__(self, terms: pa.Array, n: pa.Array, positions: pa.Buffer, n_words: pa.Array):
        self.terms = terms
        self.n = n.to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.positions = np.frombuffer(positions, "<u4").astype(np.int64)
        sizes = n_words.to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes
        self.stride = int(self.ends[-1]) + 2 if len(sizes) else 1
        self.keys = np.repeat(np.arange(len(self.n)), self.n) * self.stride + self.positions

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, side="right") - 1

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = term * self.stride + position
        at = np.searchsorted(self.keys, key)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == key

    def has_between(self, term: np.ndarray, low: np.ndarray, high: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Does ``term`` stand at ``times`` or more of the positions low..high?"""
        at = np.searchsorted(self.keys, term * self.stride + low) + times - 1
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= term * self.stride + high)

    def all_between(self, rows: np.ndarray, terms: np.ndarray, times: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Places in ``rows`` whose window has all its terms, as often as it has them, in low..high."""
        left = np.arange(len(rows))
        for k in range(terms.shape[1]):
            term = terms[rows[left], k]
            ok = term < 0
            some = left[~ok]
            ok[~ok] = self.has_between(term[~ok], low[some], high[some], times[rows[some], k])
            left = left[ok]
        return left

    def search(self, vocabulary: pa.Array, windows: np.ndarray, near: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(window, start) of exact occurrences, and (window, position) in spans of ``near`` words that hold all its words."""
        empty = np.empty(0, np.int64)
        if not len(self.keys):
            return empty, empty, empty, empty
        local = np.append(pc.fill_null(pc.index_in(vocabulary, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64), -1)
        count = np.append(np.where(local[:-1] >= 0, self.n[local[:-1]], 0), np.iinfo(np.int64).max)
        each = count[windows]
        alive = np.flatnonzero((each > 0).all(axis=1))
        rank = np.argsort(each[alive], axis=1, kind="stable")
        terms = local[np.take_along_axis(windows[alive], rank, axis=1)]
        sizes = self.n[terms[:, 0]] if len(alive) else empty
        times = (terms[:, :, None] == terms[:, None, :]).sum(axis=2) if near is not None else empty
        exact, close, start = [(empty, empty)], [(empty, empty)], 0
        cuts = np.cumsum(sizes)
        while start < len(alive):
            stop = max(start + 1, int(np.searchsorted(cuts, (cuts[start - 1] if start else 0) + CANDIDATES, side="right")))
            rows, at = _expand(self.first[terms[start:stop, 0]], sizes[start:stop])
            rows += start
            where = self.positions[at]
            begin, kept = where - rank[rows, 0], rows
            begin, kept = begin[begin >= 0], kept[begin >= 0]
            for k in range(1, windows.shape[1]):
                term = terms[kept, k]
                ok = term < 0
                ok[~ok] = self.has(term[~ok], begin[~ok] + rank[kept[~ok], k])
                begin, kept = begin[ok], kept[ok]
            exact.append((alive[kept], begin))
            if near is not None:
                doc = self.doc_of(where)
                first, last = self.starts[doc], self.ends[doc] - 1
                around = self.all_between(rows, terms, times, np.maximum(where - near + 1, first), np.minimum(where + near - 1, last))
                rows, where, first, last = rows[around], where[around], first[around], last[around]
                for back in range(near):
                    low = np.maximum(where - back, first)
                    found = self.all_between(rows, terms, times, low, np.minimum(where - back + near - 1, last))
                    close.append((alive[rows[found]], where[found]))
                    left = np.ones(len(rows), bool)
                    left[found] = False
                    rows, where, first, last = rows[left], where[left], first[left], last[left]
            start = stop
        return tuple(np.concatenate(parts) for parts in (*zip(*exact), *zip(*close)))


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] > reach[:-1]])
    return list(zip(starts[new].tolist(), reach[np.r_[new[1:] - 1, len(starts) - 1]].tolist()))


def _found(batches: Iterator[pa.RecordBatch], vocabulary: list[bytes], windows: np.ndarray, owners: list[dict[int, None]], near: int | None) -> Iterator[pa.RecordBatch]:
    """Matches in the segments of ``batches``. One segment at a time is unfolded, from where Arrow holds it, however many a batch has."""
    known, lengths = pa.array(vocabulary, pa.binary()), (windows != PAD).sum(axis=1)
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))]
    for row in (batch.slice(n, 1) for batch in batches for n in range(batch.num_rows)):
        part, seq = row.column("part")[0].as_py(), row.column("seq")[0].as_py()
        segment = Segment(row.column("terms").flatten(), row.column("n").flatten(), row.column("positions")[0].as_buffer(), row.column("n_words").flatten())
        window, start, near_window, near_at = segment.search(known, windows, near)
        doc, near_doc = segment.doc_of(start), segment.doc_of(near_at)
        out: list[list] = [[], [], [], [], [], []]
        by_doc, by_near = np.argsort(doc, kind="stable"), np.argsort(near_doc, kind="stable")
        places = np.union1d(doc, near_doc)
        cuts, near_cuts = ([np.searchsorted(d[o], places, side=side) for side in ("left", "right")] for d, o in ((doc, by_doc), (near_doc, by_near)))
        for place, a, b, c, d in zip(places.tolist(), *cuts, *near_cuts):
            here, close = by_doc[a:b], by_near[c:d]
            found = sorted({i for w in np.unique(window[here]).tolist() for i in owners[w]})
            nearby = sorted({i for w in np.unique(near_window[close]).tolist() for i in owners[w]})
            begin = start[here] - segment.starts[place]
            spans = [{"a": a, "b": b} for a, b in _merged(begin, begin + lengths[window[here]])] if len(here) else []
            for column, value in zip(out, (part, seq, place, found, nearby, spans)):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["part", "seq", "place", "items", "near", "spans"])


def _search_block(index: DataFrame, block: dict[tuple[bytes, ...], dict[int, None]], near: int | None) -> DataFrame:
    numbers = _Numbers()
    width = max(map(len, block))
    windows = np.full((len(block), width), PAD, np.int64)
    for row, window in enumerate(block):
        windows[row, : len(window)] = [numbers[w] for w in window]
    sent = index.sparkSession.sparkContext.broadcast((list(numbers), windows, list(block.values())))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _found(batches, *sent.value, near)

    return in_tasks(index.select("part", "seq", "n_words", "terms", "n", "positions"), task, HITS)


def covered(spans: Column) -> Column:
    """Words inside any of the spans."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["reach"]))).alias("n"),
        F.greatest(acc["reach"], s["b"]).alias("reach"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"].cast("bigint"))


def match(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, hash, n_words, and the matches of ``items`` in it.

    ``items`` are the ids of items of which a window of ``window`` words occurs (an item of
    fewer words is one window), ``spans`` the word ranges [a, b) the occurrences cover and
    ``n_hit`` the number of words in them. With ``near``, ``near_items`` are items of which
    all words of a window, repeated ones as often as in it, stand in some ``near`` words of
    the row one after the other, in any order.
    ``hash`` is xxhash64 of the text, so that (doc_id, hash) names a row for joins.

    The benchmark is read in blocks of at most BLOCK_WINDOWS windows, each sent to all
    segments; the index is built once. Null texts have no words; items without an id are
    left out; items with one id are one. Repeated documents have a row each.
    """
    index = build_index(docs)
    found = [_search_block(index, block, near) for block in _blocks(items, window)]
    base = index.select("part", "seq", F.posexplode(F.arrays_zip("doc_ids", "hashes", "n_words")).alias("place", "d")).select(
        "part", "seq", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.hashes").alias("hash"), F.col("d.n_words").cast("bigint").alias("n_words")
    )
    if not found:
        none = F.array().cast("array<bigint>")
        return base.select("doc_id", "hash", "n_words", F.lit(0).cast("bigint").alias("n_hit"), none.alias("items"), none.alias("near_items"),
                           F.array().cast("array<struct<a:int,b:int>>").alias("spans"))
    hits = reduce(DataFrame.unionByName, found).groupBy("part", "seq", "place").agg(
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("items", "near", "spans")]
    )
    joined = base.join(hits, ["part", "seq", "place"], "left")
    listed = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<bigint>"))))
    spans = F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>"))
    return joined.select(
        "doc_id", "hash", "n_words", covered(spans).alias("n_hit"), listed("items").alias("items"),
        listed("near").alias("near_items"), F.array_sort(spans).alias("spans"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs. Rows without an id are judged by their text."""
    bad = match(docs, items, window).where("n_hit > 0").select(F.col("doc_id").alias("_bad_id"), F.col("hash").alias("_bad_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & F.xxhash64(docs["text"]).eqNullSafe(bad["_bad_hash"])
    return docs.join(bad, same, "left_anti")


SQL = """
with words as (
  select 'd' as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') from benchmark
), iw as (
  select distinct id as item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as win
  from (select id, w, unnest(range(1, greatest(len(w) - 8, 2))) as i from words where kind = 'b' and len(w) > 0)
), sizes as (select distinct n from iw),
dw as (
  select id as doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as win
  from (select id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, sizes where kind = 'd' and len(w) >= n)
), m as (select doc_id, i, dw.n, item_id from dw join iw on dw.win = iw.win and dw.n = iw.n),
hit as (select doc_id, count(*)::bigint as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as p from m) group by doc_id),
it as (select doc_id, count(*)::bigint as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids
       from (select distinct doc_id, item_id from m) group by doc_id)
select id as doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit on hit.doc_id = words.id left join it on it.doc_id = words.id where kind = 'd'
"""
