"""Exact removal of repeated byte strings, by backward extension on a Burrows-Wheeler transform.

Strings of the wanted length are first brought together: each window of a text belongs to
the smallest hash among its k-grams, so equal windows share that anchor and their place
around it. Segments around an anchor that are equal as a whole are settled by counting.
The others are searched by interval expansion: all windows start as one interval, and the
transform's column, the byte before each row, splits the intervals by one byte a level,
breadth first, until they agree on the whole length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.shared import in_tasks, portions, spread_rows, written

NO_ID = 2**63 - 1
_P, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class SpanSpec:
    """Strings of ``length`` bytes, met by anchors of ``gram`` bytes.

    ``piece`` bytes of texts are hashed at a time, and whole anchors of about ``chunk``
    bytes of segments searched; neither changes a result.
    """

    length: int = 100
    gram: int = 24
    piece: int = 2_000_000
    chunk: int = 3_000_000


_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers[:] = []
        for base in (_P, pow(_P, -1, 2**64)):
            table = np.ones(size, np.uint64)
            filled, factor = 1, base
            while filled < size:
                table[filled : 2 * filled] = table[:filled] * np.uint64(factor)
                filled, factor = 2 * filled, factor * factor % 2**64
            _powers.append(table)
    return _powers[0], _powers[1]


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` over every run of ``width`` values, by doubling."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def segments(pieces: list[bytes], spec: SpanSpec) -> tuple[np.ndarray, ...]:
    """(piece, anchor, segment, start, size) of all segments, a window belonging to one or, in a tie, more.

    ``anchor`` is the hash of the k-gram; ``segment`` hashes the bytes of all its windows and
    the anchor's place in them; ``start`` is the place in the piece.
    """
    sizes = np.asarray([len(p) for p in pieces], np.int64)
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    width = spec.length - spec.gram + 1
    if len(raw) < spec.length:
        return (np.empty(0, np.int64),) * 5
    power, inverse = _tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    h = (total[spec.gram :] - total[: -spec.gram]) * inverse[: len(raw) - spec.gram + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    v = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)
    least = _slide(v, width, np.minimum)
    starts = np.cumsum(sizes) - sizes
    long = sizes >= spec.length
    inside = np.zeros(len(raw) + 1, np.int32)
    inside[starts[long]] += 1
    np.add.at(inside, starts[long] + sizes[long] - spec.length + 1, -1)
    least[np.cumsum(inside)[: len(least)] == 0] = 0
    edge = np.zeros(width - 1, np.uint32)
    anchors = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum)[: len(v)] == v)
    run = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    end = np.r_[run[1:], len(least)] - 1
    at = np.searchsorted(run, np.minimum(anchors, len(least) - 1), side="right") - 1
    todo = np.arange(len(anchors))
    while len(todo):
        todo = todo[least[run[at[todo]]] != v[anchors[todo]]]
        at[todo] -= 1
    first = np.maximum(run[at], anchors - width + 1)
    last = np.minimum(end[at], anchors) + spec.length
    code = (total[last] - total[first]) * inverse[first]
    code ^= code >> np.uint64(29)
    code = code * _MIX + (anchors - first).astype(np.uint64) * np.uint64(_P) + (last - first).astype(np.uint64)
    piece = np.searchsorted(starts, first, side="right") - 1
    return piece, h[anchors].view(np.int64), code.view(np.int64), first - starts[piece], last - first


FOUND = "kind int, anchor bigint, segment bigint, doc bigint, tie int, a int, n int"
FOUND_NAMES = ["kind", "anchor", "segment", "doc", "tie", "a", "n"]
FOUND_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
SEGMENT, SPAN = 0, 1


def _rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    values = [np.full(len(columns[0]), kind), *columns]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, FOUND_KINDS)], names=FOUND_NAMES)


def merged(doc: np.ndarray, tie: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping or touching spans of a document as one."""
    if not len(a):
        return doc, tie, a, b
    order = np.lexsort((a, tie, doc))
    doc, tie, a, b = doc[order], tie[order], a[order], b[order]
    other = np.r_[True, (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])]
    shift = np.cumsum(other) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + shift)
    new = np.flatnonzero(other | np.r_[True, (a + shift)[1:] > reach[:-1]])
    return doc[new], tie[new], a[new], (reach - shift)[np.r_[new[1:] - 1, len(a) - 1]]


def _settle(anchor, segment, doc, tie, a, n) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of (anchor, segment, doc, tie, a), and which of them repeat an equal segment before them."""
    order = np.lexsort((a, tie, doc, segment, anchor))
    anchor, segment, doc, tie, a = anchor[order], segment[order], doc[order], tie[order], a[order]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (segment[1:] != segment[:-1])] if len(anchor) else np.empty(0, bool)
    return order, ~new


def _anchored(docs: DataFrame, spec: SpanSpec) -> DataFrame:
    """Segments of all texts, those that repeat inside a portion of a task replaced by their spans."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
            piece, anchor, segment, start, n = segments([h[3] for h in held], spec)
            if not len(piece):
                return
            doc, tie, offset = (np.asarray([h[i] for h in held], np.int64)[piece] for i in range(3))
            a = offset + start
            order, again = _settle(anchor, segment, doc, tie, a, n)
            kept, gone = order[~again], order[again]
            yield _rows(SEGMENT, anchor[kept], segment[kept], doc[kept], tie[kept], a[kept], n[kept])
            if len(gone):
                same = _leaders(order, again)
                gone = gone[(doc[gone] != doc[same]) | (tie[gone] != tie[same]) | (a[gone] != a[same])]
                d, t, x, y = merged(doc[gone], tie[gone], a[gone], a[gone] + n[gone])
                yield _rows(SPAN, d * np.int64(31) + x, np.zeros(len(d), np.int64), d, t, x, y - x)

        held, size = [], 0
        for batch in batches:
            for doc, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                for start in range(0, max(1, len(text or b"") - spec.length + 1), spec.piece):
                    part = (text or b"")[start : start + spec.piece + spec.length - 1]
                    held.append((doc, tie, start, part))
                    size += len(part)
                    if size >= spec.piece:
                        yield from flush(held)
                        held, size = [], 0
        if held:
            yield from flush(held)

    return in_tasks(spread_rows(docs, "text"), task, FOUND)


def _leaders(order: np.ndarray, again: np.ndarray) -> np.ndarray:
    """For every repeating row, the first row of its run."""
    place = np.where(again, 0, np.arange(len(order)))
    return order[np.maximum.accumulate(place)[again]]


def _settled(found: DataFrame) -> DataFrame:
    """From segments sorted by anchor: spans of those that repeat one before them, and the distinct ones of anchors with several."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [np.empty(0, np.int64)] * 6
        sent = np.empty(0, bool)
        for batch in batches:
            kind = np.asarray(batch.column(0))
            spans = batch.filter(pa.array(kind == SPAN))
            if spans.num_rows:
                yield spans
            columns = [np.concatenate([c, np.asarray(batch.column(i + 1), np.int64)[kind == SEGMENT]]) for i, c in enumerate(carried)]
            anchor, segment, doc, tie, a, n = columns
            if not len(anchor):
                continue
            old = np.arange(len(anchor)) < len(sent)
            sent = np.concatenate([sent, np.zeros(len(anchor) - len(sent), bool)])
            new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
            new = new_anchor | np.r_[True, segment[1:] != segment[:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(anchor)), 0))
            gone = ~new & ~old & ((doc != doc[first]) | (tie != tie[first]) | (a != a[first]))
            run = np.cumsum(new_anchor) - 1
            several = np.bincount(run, weights=new)[run] > 1
            wanted = new & several & ~sent
            if wanted.any():
                yield _rows(SEGMENT, *(c[wanted] for c in columns))
            if gone.any():
                d, t, x, y = merged(doc[gone], tie[gone], a[gone], a[gone] + n[gone])
                yield _rows(SPAN, d, np.zeros(len(d), np.int64), d, t, x, y - x)
            keep = sorted({int(np.flatnonzero(new_anchor)[-1]), int(first[-1])})
            carried, sent = [c[keep] for c in columns], (sent | wanted)[keep]

    order = ["kind", "anchor", "segment", "doc", "tie", "a"]
    return in_tasks(found.repartition("anchor").sortWithinPartitions(*order), task, FOUND)


def repeated_windows(texts: list[bytes], length: int, rank: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which windows of ``texts`` have an equal one of a smaller rank.

    ``starts`` numbers each text's first window; ``rank`` orders all windows. A row is a
    window, at first at its end. At each level the rows are in order of the bytes behind
    them; the bytes before them are the transform's column, and its stable sort is the
    step to the rows one byte longer, which splits intervals. Intervals of one row end.
    """
    column = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.asarray([len(t) for t in texts], np.int64)
    count = sizes - length + 1
    row = np.arange(int(count.sum()), dtype=np.int64)
    at = (row + np.repeat(np.cumsum(sizes) - sizes - starts, count) + length).astype(np.int32)
    interval = np.zeros(len(row), np.int32)
    for _ in range(length):
        if not len(row):
            break
        at = at - 1
        byte = column[at]
        step = np.argsort(byte, kind="stable")
        byte, interval = byte[step], interval[step]
        new = np.empty(len(step) + 1, bool)
        new[0] = new[-1] = True
        np.not_equal(byte[1:], byte[:-1], out=new[1:-1])
        new[1:-1] |= interval[1:] != interval[:-1]
        live = ~(new[:-1] & new[1:])
        interval = np.cumsum(new[:-1], dtype=np.int32)[live]
        step = step[live]
        at, row = at[step], row[step]
    found = np.zeros(int(count.sum()), bool)
    if len(row):
        first = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
        least = np.repeat(np.minimum.reduceat(rank[row], first), np.diff(np.r_[first, len(row)]))
        found[row[rank[row] > least]] = True
    return found


def _searched(cut: DataFrame, spec: SpanSpec) -> DataFrame:
    """Spans of windows that have an equal one before them, among the distinct segments of each anchor."""
    length = spec.length

    def search(doc, tie, a, texts) -> Iterator[pa.RecordBatch]:
        sizes = np.asarray([len(t) for t in texts], np.int64)
        count = sizes - length + 1
        starts = np.cumsum(count) - count
        piece = np.repeat(np.arange(len(texts)), count)
        place = a[piece] + np.arange(len(piece)) - starts[piece]
        order = np.lexsort((place, tie[piece], doc[piece]))
        other = np.r_[True, (np.diff(place[order]) != 0) | (np.diff(doc[piece][order]) != 0) | (np.diff(tie[piece][order]) != 0)]
        rank = np.empty(len(piece), np.int64)
        rank[order] = np.cumsum(other)
        again = np.flatnonzero(repeated_windows(texts, length, rank, starts))
        if len(again):
            d, t, x, y = merged(doc[piece[again]], tie[piece[again]], place[again], place[again] + length)
            yield _rows(SPAN, d, np.zeros(len(d), np.int64), d, t, x, y - x)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, held, size = [], [[], [], [], []], 0
        for batch in batches:
            for anchor, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= spec.chunk and anchor != anchors[-1]:
                    yield from search(*(np.asarray(c, np.int64) for c in held[:3]), held[3])
                    anchors, held, size = [], [[], [], [], []], 0
                anchors.append(anchor)
                for c, v in zip(held, row):
                    c.append(v)
                size += len(row[3])
        if anchors:
            yield from search(*(np.asarray(c, np.int64) for c in held[:3]), held[3])

    return in_tasks(cut.repartition("anchor").sortWithinPartitions("anchor"), task, FOUND)


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    return [F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), F.hash(text).alias("tie")]


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the joins that move them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in portions(batches, 2, 8_000_000):
            packed = [squeeze(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc", "tie", "packed"])

    return in_tasks(docs, task, "doc bigint, tie int, packed binary")


def _cut(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the wanted segments."""
    lists = wanted.select("anchor", "doc", "tie", "a", "n").groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "a", "n")).alias("cuts"))
    rows = _packed(docs).join(lists.withColumnsRenamed({"doc": "d", "tie": "t"}), (F.col("doc") == F.col("d")) & (F.col("tie") == F.col("t"))).select("doc", "tie", "packed", "cuts")
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in portions(batches, 2, 1_000_000):
            out: list[list] = [[], [], [], [], []]
            for doc, tie, packed, cuts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text = unpack(packed)
                for cut in cuts:
                    for column, value in zip(out, (cut["anchor"], doc, tie, cut["a"], text[cut["a"] : cut["a"] + cut["n"]])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=["anchor", "doc", "tie", "a", "bytes"])

    return in_tasks(rows, task, "anchor bigint, doc bigint, tie int, a int, bytes binary")


def repeated_spans(docs: DataFrame, spec: SpanSpec = SpanSpec()) -> DataFrame:
    """(doc, tie, spans): byte ranges of a row that equal strings starting earlier cover.

    ``doc`` is the id, or the largest number for null, and ``tie`` Spark's hash of the text,
    which together name a row; earlier means by (doc, tie, start).
    """
    keyed = docs.select(*_row_key(F.col("doc_id"), F.col("text")), "text")
    settled = written(_settled(_anchored(keyed, spec)))
    wanted = settled.where(F.col("kind") == SEGMENT)
    searched = written(_searched(_cut(keyed, wanted), spec).select("doc", "tie", "a", "n"))
    spans = settled.where(F.col("kind") == SPAN).select("doc", "tie", "a", "n").unionByName(searched)
    return spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("a", "n")).alias("spans"))


def remove_repeats(docs: DataFrame, spec: SpanSpec = SpanSpec(), with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes.

    A byte goes if a string of ``spec.length`` bytes covers it that also starts earlier, in
    a document with a smaller id or before it in the same document. Strings are judged on
    the texts as given and never cross documents. Null and empty texts have no bytes.

    Rows without an id come after all others. Rows with one id and different texts are in
    order of a hash of their texts; rows repeated whole are one document, with a row each.
    """
    spans = repeated_spans(docs, spec).withColumnsRenamed({"doc": "d", "tie": "t"})
    keyed = docs.select(*_row_key(F.col("doc_id"), F.col("text")), "text")
    joined = _packed(keyed).join(spans, (F.col("doc") == F.col("d")) & (F.col("tie") == F.col("t")), "left").select("doc", "packed", "spans")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for batch in portions(batches, 1, 4_000_000):
            out: list[list] = [[], [], [], [], [], []]
            for doc, packed, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = unpack(packed)
                kept, gone, n = text, 0, 0
                if spans:
                    a = np.asarray([s["a"] for s in spans], np.int64)
                    zero = np.zeros(len(a), np.int64)
                    _, _, x, y = merged(zero, zero, a, a + np.asarray([s["n"] for s in spans], np.int64))
                    kept = b"".join(text[i:j] for i, j in zip([0, *y.tolist()], [*x.tolist(), len(text)]))
                    gone, n = int((y - x).sum()), len(x)
                for column, value in zip(out, (None if doc == NO_ID else doc, len(text), gone, n, hashlib.sha256(kept).hexdigest(), kept)):
                    column.append(value)
            columns = 6 if with_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out[:columns], kinds)], names=names[:columns])

    return in_tasks(joined, task, schema)
