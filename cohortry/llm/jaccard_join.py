"""Similarity join on word shingles with a MinHash LSH forest.

Every text has a signature per tree, a string of minima. The trees are tries over these
strings; texts that share a prefix meet in a trie node. Prefixes are shortened from the
deepest level until the chance to miss a pair at the threshold is below the target, and
all pairs that meet there are verified on their whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.components import components
from cohortry.llm.decontaminate import words_of
from cohortry.llm.shared import Bounded, in_tasks, local_roots, portions, runs, spread_rows, worker_state, written

ROWS_AT_ONCE = 2_048
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class ForestSpec:
    """Shingles of ``words`` words, pairs of Jaccard similarity ``threshold`` or more.

    ``missed``: the largest chance to miss a pair at the threshold. ``block`` documents, or
    ``block_shingles`` shingles, are compared with as many at a time.
    """

    words: int = 5
    threshold: float = 0.8
    trees: int = 40
    deepest: int = 8
    missed: float = 1e-6
    block: int = 256
    block_shingles: int = 500_000
    seed: int = 5

    @property
    def depth(self) -> int:
        """The longest prefix at which pairs at the threshold meet in some tree often enough."""
        for depth in range(self.deepest, 0, -1):
            if (1 - self.threshold**depth) ** self.trees <= self.missed:
                return depth
        raise ValueError("more trees are needed for this target")


class _Hashes(Bounded):
    def __missing__(self, word: bytes) -> int:
        return self.keep(word, xxhash.xxh64_intdigest(word))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; a shorter text with words is one run."""
    found = words_of(text)
    each = np.fromiter(map(worker_state("jaccard_join", _Hashes).__getitem__, found), np.uint64, len(found))
    if not len(each):
        return each
    size = min(words, len(each))
    n = len(each) - size + 1
    mixed = np.full(n, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ each[k : k + n]) * _STEP
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed * _MIX)


def prefixes(found: np.ndarray, factors: np.ndarray, trees: int) -> np.ndarray:
    """The trie node of a shingle set in every tree, as a hash of its minima."""
    values = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(values), ROWS_AT_ONCE):
        np.minimum(least, (values[a : a + ROWS_AT_ONCE, None] * factors).min(axis=0), out=least)
    node = np.arange(1, trees + 1, dtype=np.uint64) * _MIX
    for level in least.reshape(trees, -1).T:
        node = (node ^ level) * _STEP
        node ^= node >> np.uint64(31)
    return node.view(np.int64)


def _signed(docs: DataFrame, spec: ForestSpec) -> DataFrame:
    """(doc_id, class, n, nodes): the shingle set as a 16-byte digest, its size, and its trie nodes."""
    factors = np.random.default_rng(spec.seed).integers(0, 2**31, spec.trees * spec.depth).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    words, trees = spec.words, spec.trees

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1, 8_000_000):
            names, sizes, nodes = [], [], []
            seen: dict[bytes, np.ndarray] = {}
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = shingles(text or b"", words)
                name = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None
                if name is not None and name not in seen:
                    seen[name] = prefixes(found, factors, trees)
                names.append(name)
                sizes.append(len(found))
                nodes.append(seen[name] if name is not None else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(nodes, pa.list_(pa.int64()))],
                names=["doc_id", "class", "n", "nodes"],
            )

    rows = spread_rows(docs.select("doc_id", "text"), "doc_id")
    return in_tasks(rows, task, "doc_id bigint, class binary, n int, nodes array<bigint>")


def _verified(sets: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links) from rows grouped by ``pair``: documents linked to a class there, and a class it is connected to."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches):
            node, root, links = _compare(group, threshold)
            if len(node):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node, root, links)], names=["node", "root", "links"])

    return in_tasks(sets, task, "node bigint, root bigint, links bigint")


def _compare(group: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links between the two sides of a group, or within its one side."""
    side, node, copies, names = (group.column(c).to_pylist() for c in ("side", "node", "copies", "class"))
    first = {}
    for i, key in enumerate(zip(side, names)):
        first.setdefault(key, i)
    rows = list(first.values())
    sets = [np.frombuffer(group.column("set")[i].as_py(), np.uint64) for i in rows]
    nodes = np.stack([np.frombuffer(group.column("nodes")[i].as_py(), np.int64) for i in rows])
    node, copies, side = (np.asarray([x[i] for i in rows], np.int64) for x in (node, copies, side))
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    sizes = np.asarray([len(s) for s in sets], np.int64)
    met = np.zeros((len(left), len(right)), bool)
    for tree in range(nodes.shape[1]):
        met |= nodes[left, tree][:, None] == nodes[right, tree][None, :]
    small, large = np.minimum(sizes[left][:, None], sizes[right][None, :]), np.maximum(sizes[left][:, None], sizes[right][None, :])
    met &= small >= threshold * large * (1 - 1e-9)
    if right is left:
        met &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
    if not met.any():
        return (np.empty(0, np.int64),) * 3
    local = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    ids = [local[s : s + n] for s, n in zip(starts, sizes)]
    mark = np.zeros(int(local.max()) + 1, bool)
    a, b = [], []
    for i in np.flatnonzero(met.any(axis=1)):
        here, partners = left[i], right[np.flatnonzero(met[i])]
        mark[ids[here]] = True
        cuts = np.cumsum(sizes[partners]) - sizes[partners]
        common = np.add.reduceat(mark[np.concatenate([ids[p] for p in partners])].astype(np.int64), cuts)
        mark[ids[here]] = False
        ok = partners[common / (sizes[here] + sizes[partners] - common) >= threshold]
        a.append(np.full(len(ok), here))
        b.append(ok)
    a, b = np.concatenate(a), np.concatenate(b)
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    root = local_roots(len(rows), a, b)
    linked = np.flatnonzero(links)
    return node[linked], node[root[linked]], links[linked]


def similar(docs: DataFrame, spec: ForestSpec = ForestSpec()) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, component_id, kept and n_rows.

    ``class_id`` is the smallest id with the same shingle set, ``n_links`` the number of
    other documents at or over the threshold, ``component_id`` the smallest id reachable
    by links, and ``kept`` whether that is the document itself.

    Copies are one class before anything is compared. Classes that meet in a trie node are
    put into blocks around the smallest class they meet; pairs of blocks with a common node
    are compared whole, each once, so hot groups split into many tasks, every set is sent
    as often as its block has partners, and only sums and a spanning forest come out.

    Rows with one id are one document, with ``n_rows`` rows, whose links are those of all
    its texts. Rows without an id, and texts without words, are not compared: a row each
    without links, which is kept.
    """
    signed = written(_signed(docs, spec))
    known = signed.where("class is not null and doc_id is not null")
    classes = written(known.select("class", "doc_id", "n").distinct().groupBy("class").agg(
        F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")
    ))
    rep = known.join(classes.select("class", "node"), "class").where("doc_id = node")
    met = rep.select("class", F.explode("nodes").alias("at")).distinct()
    shared = met.groupBy("at").agg(F.min(F.xxhash64("class")).alias("lead"), F.count(F.lit(1)).alias("m")).where("m > 1").select("at", "lead")
    meetings = written(met.join(shared, "at"))
    active = meetings.groupBy("class").agg(F.min("lead").alias("lead")).join(classes, "class")
    sizes = active.groupBy("lead").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / spec.block, F.sum("n") / spec.block_shingles)).alias("parts")
    )
    part = F.pmod(F.xxhash64("class", F.lit(spec.seed)), F.col("parts"))
    blocks = written(active.join(sizes, "lead").select("class", "node", "copies", F.xxhash64("lead", part).alias("block")))

    at = meetings.select("class", "at").join(blocks.select("class", "block"), "class").select("at", "block").distinct()
    other = at.withColumnRenamed("block", "other")
    pairs = at.join(other, "at").where("block <= other").select("block", "other").distinct()
    pairs = written(pairs.withColumn("pair", F.xxhash64("block", "other")))
    sides = pairs.select("block", "pair", F.lit(0).alias("side")).unionByName(
        pairs.where("block <> other").select(F.col("other").alias("block"), "pair", F.lit(1).alias("side"))
    )
    wanted = (
        blocks.join(sides, "block").groupBy("class", "node", "copies").agg(F.collect_list(F.struct("pair", "side")).alias("pairs"))
        .withColumnRenamed("class", "want")
    )
    linked = written(_verified(_sets(docs, wanted, spec).repartition("pair").sortWithinPartitions("pair", "side"), spec.threshold))
    sums = linked.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(linked.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(
        known.join(classes, "class").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    ))
    per_text = (
        known.groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("rows"))
        .join(classes.select("class", "node", "copies"), "class").join(sums, "node", "left")
    )
    found = per_text.groupBy("doc_id").agg(
        F.min("node").alias("class_id"),
        F.sum(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"),
        F.sum("rows").alias("n_rows"),
    )
    named = found.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    compared = named.select("doc_id", "class_id", "n_links", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"), "n_rows")
    wordless = signed.where("class is null and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows")).join(found.select("doc_id"), "doc_id", "left_anti")
    nameless = signed.where("doc_id is null").select("doc_id", F.lit(1).cast("bigint").alias("n_rows"))
    alone = wordless.unionByName(nameless).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "n_rows"
    )
    return compared.unionByName(alone)


def _sets(docs: DataFrame, wanted: DataFrame, spec: ForestSpec) -> DataFrame:
    """Shingle sets of the wanted classes, once for every pair of blocks that compares them."""
    factors = np.random.default_rng(spec.seed).integers(0, 2**31, spec.trees * spec.depth).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    words, trees = spec.words, spec.trees
    rows = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("node")).select("text", "want", "node", "copies", "pairs")
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = ["pair", "side", "node", "copies", "class", "nodes", "set"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 0, 1_000_000):
            columns = [batch.column(0).cast(pa.binary()).to_pylist(), *(batch.column(i).to_pylist() for i in range(1, 5))]
            out: list[list] = [[] for _ in kinds]
            for text, want, node, copies, pairs in zip(*columns):
                found = shingles(text or b"", words)
                if not len(found) or hashlib.blake2b(found.tobytes(), digest_size=16).digest() != want:
                    continue
                at, whole = prefixes(found, factors, trees).tobytes(), found.tobytes()
                for pair in pairs:
                    for column, value in zip(out, (pair["pair"], pair["side"], node, copies, want, at, whole)):
                        column.append(value)
                    if len(out[0]) >= 2_000:
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)
                        out = [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    return in_tasks(rows, task, "pair bigint, side int, node bigint, copies bigint, class binary, nodes binary, set binary")


def dedup(docs: DataFrame, spec: ForestSpec = ForestSpec()) -> DataFrame:
    """``docs`` with one document of each group of linked ones: the smallest id, once.

    Rows repeated whole are one document. Rows without an id stay as they are, repeated or not.
    """
    found = similar(docs, spec)
    marks = found.where("doc_id is not null and (not kept or n_rows > 1)").select(
        F.col("doc_id").alias("_id"), F.col("kept").alias("_kept")
    )
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text")
    marked = rows.join(marks, F.col("doc_id") == F.col("_id"), "left").where("_kept is null or _kept")
    once = marked.where("_kept is null").select("_row.*")
    repeated = marked.where("_kept").dropDuplicates(["doc_id", "text"]).select("_row.*")
    return once.unionByName(repeated)


SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w from documents
), sh as (
  select distinct doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)
), n as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b, c = na.n and c = nb.n as same from common join n na on na.doc_id = a join n nb on nb.doc_id = b where c / (na.n + nb.n - c) >= 0.8),
reach as (select a as x, b as y from links union select reach.x, links.b from reach join links on reach.y = links.a),
comp as (select x, min(y) as y from reach group by x)
select d.doc_id, least(d.doc_id, coalesce((select min(b) from links where a = d.doc_id and same), d.doc_id)) as class_id,
       (select count(*) from links where a = d.doc_id)::bigint as n_links,
       least(d.doc_id, coalesce(comp.y, d.doc_id)) as component_id, least(d.doc_id, coalesce(comp.y, d.doc_id)) = d.doc_id as kept
from documents d left join comp on comp.x = d.doc_id
"""
