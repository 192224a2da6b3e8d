"""Token ids in binary files: canonical length-limited Huffman codes in independent blocks.

A written set of files has two parts below its folder. ``header`` holds (id, bits), from
which the canonical code follows. ``blocks`` holds one row per block: its shard and number,
its documents with their token counts, the bit stream, and the bit offset of every
``CHECKPOINT``-th id, from which decoding can start. Parquet is the container, since only
Spark's writers reach every store.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.shared import in_tasks, portions, shared_folder, spread_rows, worker_state, written

CHECKPOINT = 256
BLOCK_IDS = 65_536
SHARD_IDS = 4_000_000
MAX_BITS = 18
PORTION = 2_000_000
ENCODED = 16_000_000
KNOWN = 260_000_000
ENTRY_BYTES = 288
LAID_OUT = 100_000
JOINED = 4_000
MARKS = ".,;:!?"
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: visible ones as themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 0x100 + i for i, b in enumerate(rest)}


class Pieces(dict):
    """Ids of text pieces as bytes, encoded once and kept up to about ``limit`` bytes."""

    def __init__(self, encode, prefix: str, limit: int):
        super().__init__()
        self.encode, self.prefix, self.most = encode, prefix, limit // ENTRY_BYTES

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        found = self[piece] = self.encode(self.prefix + piece)
        return found

    def room(self, new: int, used) -> None:
        """Before ``new`` pieces go in: beyond the limit, only what ``used`` gives stays."""
        if len(self) + new > self.most:
            kept = used()
            self.clear()
            self.update(kept)


class Encoder:
    """Texts to ids as little-endian bytes, with the tokenizers library.

    A byte-level tokenizer with the usual pattern never lets a piece run on into white
    space, so a text can be cut before every run of white space and equal cuts encoded
    once, also across batches. New cuts of a batch are encoded together, a few thousand in one string: each
    starts with a blank, which only the first of its ids stands for. Other tokenizers, and
    texts that hold an added token, are encoded whole.
    """

    def __init__(self, spec: str, kind: str, known: int = KNOWN):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.kind = kind
        plain = json.loads(spec)
        before = plain.get("pre_tokenizer") or {}
        self.cuts = (
            plain.get("normalizer") is None and before.get("type") == "ByteLevel"
            and not before.get("add_prefix_space") and before.get("use_regex", True)
        )
        self.added = [t["content"] for t in plain.get("added_tokens", [])]
        self.model = self.tokenizer.model
        self.first, self.later, self.runs = Pieces(self.head, "", 8_000_000), Pieces(self.whole, " ", known), Pieces(self.whole, "", 8_000_000)
        blank = "\u0120"  # how byte-level vocabularies write the blank
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.starts[[i for t, i in vocabulary.items() if t.startswith(blank)]] = True
        self.each = [np.asarray([i], dtype=kind).tobytes() for i in range(len(self.starts))]
        self.letters = byte_letters()
        self.touching = f"[{SPACES}] |^ "
        self.before_run = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")

    def whole(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def head(self, piece: str) -> bytes:
        return self._letters("", piece) if piece.isalpha() else self.whole(piece)

    def _letters(self, blank: str, piece: str) -> bytes:
        """Letters alone, after a blank or not, are one piece, which the model takes as it is."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.each[t.id] for t in self.model.tokenize(blank + piece)])

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)

    def learn(self, pieces: list[str]) -> None:
        """Encode new cuts together and keep them.

        A mark after a letter is a piece of its own, so a cut with one is its stem and the mark.
        """
        marked = [p for p in pieces if p[-1] in MARKS and p[-2:-1].isalpha()]
        stems = {p[:-1] for p in marked} - self.later.keys()
        self._learn([p for p in pieces if not (p[-1] in MARKS and p[-2:-1].isalpha())] + list(stems))
        later, alone = self.later, self.runs
        self.later.update([(p, later[p[:-1]] + alone[p[-1]]) for p in marked])

    def _learn(self, pieces: list[str]) -> None:
        """A cut of letters alone is one piece, which the model can take at once; others are joined."""
        self.later.update([(p, self._letters("\u0120", p)) for p in pieces if p.isalpha()])
        width, pieces = np.dtype(self.kind).itemsize, [p for p in pieces if not p.isalpha()]
        for a in range(0, len(pieces), JOINED):
            part = pieces[a : a + JOINED]
            ids = self._ids(" " + " ".join(part))
            cuts = np.flatnonzero(self.starts[ids])
            if len(cuts) != len(part) or cuts[0] != 0:
                continue  # encoded one by one when they are looked up
            raw, cuts = ids.tobytes(), [*(cuts * width).tolist(), len(ids) * width]
            self.later.update(zip(part, [raw[x:y] for x, y in zip(cuts, cuts[1:])]))

    def __call__(self, texts: pa.Array, end: bytes) -> pa.Array:
        """Ids of every text and ``end``, as bytes. Equal cuts of the batch are looked up once."""
        hard = np.ones(len(texts), bool)
        if self.cuts:
            tests = [pc.match_substring_regex(texts, self.touching), *(pc.match_substring(texts, t) for t in self.added)]
            hard = np.any([np.asarray(t) for t in tests], axis=0)
        whole = [self._by_runs(t) + end for t in texts.filter(pa.array(hard)).to_pylist()]
        easy = self._by_words(texts.filter(pa.array(~hard)), end) if not hard.all() else pa.array([], pa.binary())
        places = np.argsort(np.concatenate([np.flatnonzero(~hard), np.flatnonzero(hard)]), kind="stable")
        return pa.concat_arrays([easy, pa.array(whole, pa.binary())]).take(pa.array(places))

    def _by_runs(self, text: str) -> bytes:
        if not self.cuts or any(t in text for t in self.added):
            return self.whole(text)
        return b"".join(map(self.runs.__getitem__, self.before_run.split(text)))

    def _by_words(self, texts: pa.Array, end: bytes) -> pa.Array:
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        codes, words = np.asarray(coded.indices), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.later.get, words))
        missing = [k for k, v in enumerate(found) if v is None]
        if missing:
            new = [words[k] for k in missing if words[k]]
            self.later.room(len(new), lambda: [(w, v) for w, v in zip(words, found) if v is not None])
            self.learn(new)
            for k in missing:
                found[k] = self.later[words[k]]
        starts = np.asarray(parts.offsets)[:-1] - parts.offsets[0].as_py()
        counts = np.diff(np.asarray(parts.offsets))
        found += [self.first[words[c]] for c in codes[starts].tolist()] + [end]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // len(end)
        at, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), self.kind)
        # ids are laid out for some documents at a time: these arrays are far larger than the text
        ids, lengths, x = [], [], 0
        while x < len(texts):
            y = max(x + 1, int(np.searchsorted(starts, starts[x] + LAID_OUT)))
            doc, own = np.arange(y - x), starts[x:y] - starts[x]
            count = counts[x:y]
            words_at = codes[starts[x] : starts[x] + int(count.sum())]
            piece = np.empty(len(words_at) + len(doc), np.int64)
            piece[np.arange(len(words_at)) + np.repeat(doc, count)] = words_at
            piece[own + doc] = len(words) + x + doc
            piece[own + count + doc] = len(found) - 1
            length = sizes[piece]
            reach = np.cumsum(length)
            ids.append(flat[np.repeat(at[piece] - reach + length, length) + np.arange(reach[-1])])
            lengths.append(np.diff(reach[own + count + doc], prepend=0))
            x = y
        cuts = np.cumsum([0, *np.concatenate(lengths)]) * len(end)
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.concatenate(ids).tobytes())])


def encoder(spec: str, kind: str, known: int) -> Encoder:
    """One encoder, with the cuts it knows, for all tasks of a worker."""
    return worker_state(("token_output", zlib.crc32(spec.encode()), kind, known), lambda: Encoder(spec, kind, known))


def tokenise(
    docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", encoded: int = ENCODED, known: int = KNOWN
) -> DataFrame:
    """(doc_id, ids): token ids of every whole text and the end id, as little-endian bytes.

    A worker encodes about ``encoded`` bytes of text at once and keeps encoded cuts up to
    about ``known`` bytes. Both trade memory for time; the ids do not depend on them.

    Two bytes an id where the vocabulary allows, else four. The vocabulary file is read
    here and sent to the tasks; null text has the end id only.
    """
    from tokenizers import Tokenizer

    spec = Path(tokenizer).read_text()
    kind = id_kind(max(Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True) - 1, end_id))
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    end = np.asarray([end_id], dtype=kind).tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value, kind, known)
        for batch in portions(batches, 1, encoded):
            ids = encode(batch.column(1).fill_null(""), end)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return in_tasks(spread_rows(docs.select("doc_id", text), "doc_id"), task, "doc_id bigint, ids binary")


def id_kind(largest: int) -> str:
    return "<u2" if largest < 65_536 else "<u4"


def global_counts(tokens: DataFrame, kind: str) -> DataFrame:
    """(id, n) over all documents; a task sends each of its ids once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1, dtype=np.int64)
        for batch in portions(batches, 0, PORTION):
            found = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=kind))
            if len(found) > len(held):
                held, found = found.astype(np.int64), held
            held[: len(found)] += found
        ids = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held[ids], pa.int64())], names=["id", "n"])

    return in_tasks(tokens.select("ids"), task, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits, by merging packages.

    At each of ``limit`` levels, pairs of the cheapest items of the level before become
    items beside the symbols. The symbols taken at a level are always the rarest ones, so
    a symbol's length is the number of levels that take it.
    """
    if len(counts) == 1:
        return np.ones(1, dtype=np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.empty(0)
    for _ in range(limit):
        items = np.concatenate([leaves, packages])
        by_cost = np.argsort(items, kind="stable")
        levels.append(by_cost < len(leaves))
        cost = items[by_cost]
        pairs = len(cost) // 2 * 2
        packages = cost[0:pairs:2] + cost[1:pairs:2]
    lengths, take = np.zeros(len(counts), dtype=np.int64), 2 * len(counts) - 2
    for is_leaf in reversed(levels):
        symbols = int(is_leaf[:take].sum())
        lengths[order[:symbols]] += 1
        take = 2 * (take - symbols)
    return lengths


def canonical(ids: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids by (bits, id), their lengths, and their codes counted up from zero."""
    order = np.lexsort((ids, bits))
    ids, bits = ids[order], bits[order]
    widest = int(bits[-1])
    steps = np.left_shift(1, widest - bits)
    return ids, bits, (np.cumsum(steps) - steps) >> (widest - bits)


def pack(ids: np.ndarray, code: np.ndarray, bits: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``ids`` and the offset of every checkpoint."""
    width = bits[ids]
    ends = np.cumsum(width)
    starts = ends - width
    word = starts >> 5
    value = code[ids].astype(np.uint64) << (64 - width - (starts & 31)).astype(np.uint64)
    stream = np.zeros(int(ends[-1] >> 5) + 3, dtype=np.uint64)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    stream[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
    stream[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return stream.astype(">u4").tobytes(), starts[::CHECKPOINT]


def unpack(payloads: list[bytes], offsets: list[np.ndarray], sizes: list[int], table: np.ndarray, widest: int, kind: str) -> list[np.ndarray]:
    """Ids of several blocks. Every checkpoint is a lane, and all lanes read one id a step."""
    base = np.cumsum([0, *[len(p) for p in payloads]])
    raw = np.frombuffer(b"".join(payloads) + b"\0\0\0\0", dtype=np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.concatenate([o + 8 * b for o, b in zip(offsets, base)])
    left = np.concatenate([np.minimum(CHECKPOINT, n - CHECKPOINT * np.arange(len(o))) for o, n in zip(offsets, sizes)])
    out = np.zeros((len(at), CHECKPOINT), dtype=kind)
    lanes = np.argsort(-left, kind="stable")
    at, left = at[lanes], left[lanes]
    shift, mask = 32 - widest, (1 << widest) - 1
    for step in range(int(left[0])):
        live = int(np.searchsorted(-left, -step, side="left"))
        entry = table[(window[at[:live] >> 3] >> (shift - (at[:live] & 7))) & mask]
        out[:live, step] = entry >> 5
        at[:live] += entry & 31
    back = np.empty_like(lanes)
    back[lanes] = np.arange(len(lanes))
    out = out[back]
    found, lane = [], 0
    for o, n in zip(offsets, sizes):
        found.append(out[lane : lane + len(o)].reshape(-1)[:n])
        lane += len(o)
    return found


BLOCKS = (
    "shard int, block int, first bigint, doc_ids array<bigint>, counts array<int>, n_ids int, "
    "checkpoints array<int>, stream binary"
)
BLOCK_KINDS = {
    "shard": pa.int32(), "block": pa.int32(), "first": pa.int64(), "doc_ids": pa.list_(pa.int64()),
    "counts": pa.list_(pa.int32()), "n_ids": pa.int32(), "checkpoints": pa.list_(pa.int32()), "stream": pa.binary(),
}


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, max_bits: int = MAX_BITS, shard_ids: int = SHARD_IDS,
    encoded: int = ENCODED, known: int = KNOWN,
) -> str:
    """Tokenise ``docs`` and write their ids by ascending ``doc_id``; returns the folder.

    Ids are counted over all documents, and one canonical code of at most ``max_bits`` bits
    (more if the ids in use need it) is made from the counts; they number at most the
    vocabulary. Documents are dealt by ranges of (doc_id, ids) into shards of about
    ``shard_ids`` ids. A block holds whole documents, closed once it has ``BLOCK_IDS`` ids.
    Null ids come first; rows with one id follow each other by their ids, and repeated rows
    are written as often as they come. Null text is an empty text; other columns are ignored.
    ``encoded`` and ``known`` bound a worker's memory, as in ``tokenise``.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark)
    tokens = written(tokenise(docs, tokenizer, end_id, encoded=encoded, known=known))
    from tokenizers import Tokenizer

    kind = id_kind(max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id))
    counted = global_counts(tokens, kind).orderBy("id").collect()
    ids = np.asarray([r["id"] for r in counted], dtype=np.int64)
    counts = np.asarray([r["n"] for r in counted], dtype=np.int64)
    limit = min(24, max(max_bits, int(np.ceil(np.log2(max(2, len(ids)))))))
    lengths = code_lengths(counts, limit) if len(ids) else np.empty(0, dtype=np.int64)
    rows = [(int(i), int(b)) for i, b in zip(ids, lengths)]
    spark.createDataFrame(rows, "id bigint, bits int").coalesce(1).write.parquet(f"{path}/header")

    code, bits = np.zeros(int(ids.max(initial=0)) + 1, dtype=np.int64), np.zeros(int(ids.max(initial=0)) + 1, dtype=np.int64)
    if len(ids):
        in_order, wide, codes = canonical(ids, lengths)
        code[in_order], bits[in_order] = codes, wide
    sent = spark.sparkContext.broadcast((code, bits))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, bits = sent.value
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            found = np.frombuffer(b"".join(held), dtype=kind)
            stream, offsets = pack(found, code, bits)
            lengths = [len(x) // np.dtype(kind).itemsize for x in held]
            values = (shard, block, first, doc_ids, lengths, len(found), offsets.tolist(), stream)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, BLOCK_KINDS.values())], names=list(BLOCK_KINDS))

        for batch in portions(batches, 1, PORTION):
            for doc_id, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                held.append(one)
                size += len(one) // np.dtype(kind).itemsize
                if size >= BLOCK_IDS:
                    yield close()
                    block, first, size, doc_ids, held = block + 1, first + size, 0, [], []
        if held:
            yield close()

    shards = max(1, -(-int(counts.sum()) // shard_ids))
    order = ["doc_id", "_tie"]
    ranged = tokens.withColumn("_tie", F.xxhash64("ids")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    in_tasks(ranged.select("doc_id", "ids"), task, BLOCKS).write.parquet(f"{path}/blocks")
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files at ``path``: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    Blocks are decoded independently by one table of ``2**bits`` entries. ``start`` is the
    number of ids before the document: those of earlier shards, of earlier blocks of its
    shard, and of earlier documents of its block.
    """
    header = spark.read.parquet(f"{path}/header").collect()
    ids = np.asarray([r["id"] for r in header], dtype=np.int64)
    bits = np.asarray([r["bits"] for r in header], dtype=np.int64)
    widest, table, kind = 1, np.zeros(2, dtype=np.int64), id_kind(int(ids.max(initial=0)))
    if len(ids):
        ids, bits, _ = canonical(ids, bits)
        widest = int(bits[-1])
        filled = np.repeat((ids << 5) | bits, np.left_shift(1, widest - bits))
        table = np.pad(filled, (0, 2**widest - len(filled)))
    sent = spark.sparkContext.broadcast(table)
    schema = "shard int, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 5, 1_000_000):
            shard, first, doc_ids, counts, offsets, stream = (batch.column(i).to_pylist() for i in range(6))
            sizes = [sum(c) for c in counts]
            blocks = unpack(stream, [np.asarray(o, dtype=np.int64) for o in offsets], sizes, sent.value, widest, kind)
            rows: list[list] = [[], [], [], [], [], []]
            for s, f, names, each, found in zip(shard, first, doc_ids, counts, blocks):
                ends = np.cumsum(each)
                full = found.astype("<u4")
                parts = np.split(full, ends[:-1])
                for column, values in zip(rows, ([s] * len(names), names, f + ends - each, each, [zlib.crc32(p.tobytes()) for p in parts], parts)):
                    column.extend(values)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["shard", "doc_id", "inner", "n_tokens", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows[:n], kinds)], names=names[:n])

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")
    )
    found = in_tasks(blocks.select("shard", "first", "doc_ids", "counts", "checkpoints", "stream"), task, schema)
    joined = found.join(shards, found["shard"] == shards["_shard"])
    return joined.select(
        "doc_id", (F.col("_before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])
    )
