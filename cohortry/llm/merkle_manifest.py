"""A Merkle manifest of a dataset, with proofs for every row by octopus multiproofs.

Leaves are dealt by ranges of (group, key) and numbered within their group. A partition
holds a run of consecutive leaves, so it knows all nodes that lie inside it; only those whose
parent crosses its border are sent on, a few per level, and the levels above are completed
from them. For the proofs a partition lists the coordinates of the nodes its leaves need and
cannot derive, the minimal union over all its leaves, and fetches each once. Interiors that
leaves share are derived once, and each leaf's own proof is expanded in place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.shared import in_tasks, written
from cohortry.session import ship_package

FANOUT = 8
PART_ROWS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def level_sizes(leaves: int) -> list[int]:
    """Nodes per level of a tree, leaves first, down to its one root."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FANOUT))
    return sizes


def leaf_hash(fields: list[Column]) -> Column:
    """H over the fields: ``-`` for null, else byte count, ``:`` and the value."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def inner(hashes: list[bytes], first: int, total: int) -> tuple[list[tuple[int, list[bytes]]], list[tuple[int, int, bytes]]]:
    """What leaves ``first`` ... of a tree of ``total`` decide by themselves.

    Per level, the first known node and the known ones; and the frontier: known nodes
    (level, index, hash) whose parent is not known, or the root.
    """
    known, frontier = [(first, hashes)], []
    sizes = level_sizes(total)
    for level, size in enumerate(sizes):
        low, nodes = known[-1]
        high = low + len(nodes)
        up_low = -(-low // FANOUT)
        up_high = sizes[level + 1] if high == size and size > 1 else high // FANOUT
        if size == 1 or up_low >= up_high:
            frontier += [(level, low + k, h) for k, h in enumerate(nodes)]
            break
        frontier += [(level, k, nodes[k - low]) for k in [*range(low, min(high, FANOUT * up_low)), *range(min(high, FANOUT * up_high), high)]]
        known.append((up_low, [sha(b"".join(nodes[max(0, FANOUT * j - low) : FANOUT * (j + 1) - low])) for j in range(up_low, up_high)]))
    return known, frontier


def missing(first: int, n: int, total: int) -> list[tuple[int, int]]:
    """Coordinates (level, index) beside the paths of leaves ``first`` ... ``first + n - 1`` that do not follow from them."""
    found, low, high = [], first, first + n
    for level, size in enumerate(level_sizes(total)[:-1]):
        a, b = low // FANOUT * FANOUT, min(size, -(-high // FANOUT) * FANOUT)
        found += [(level, k) for k in [*range(a, low), *range(high, b)]]
        low, high = low // FANOUT, -(-high // FANOUT)
    return found


class Paths:
    """Siblings of consecutive leaves, from the leaves and the fetched nodes; interiors are derived once."""

    def __init__(self, hashes: list[bytes], first: int, total: int, fetched: dict[tuple[int, int], bytes], above: tuple[tuple[bytes, bytes], ...] = ()):
        self.sizes = level_sizes(total)
        self.levels: list[tuple[int, list[bytes]]] = []
        low, nodes = first, hashes
        for level, size in enumerate(self.sizes):
            if size == 1:
                self.levels.append((low, nodes))
                break
            a, b = low // FANOUT * FANOUT, min(size, -(-(low + len(nodes)) // FANOUT) * FANOUT)
            whole = [fetched[(level, k)] for k in range(a, low)] + nodes + [fetched[(level, k)] for k in range(low + len(nodes), b)]
            self.levels.append((a, whole))
            low, nodes = a // FANOUT, [sha(b"".join(whole[k : k + FANOUT])) for k in range(0, len(whole), FANOUT)]
        self.top = self.levels[-1][1][0]
        self.above = above
        self._known: dict[tuple[int, int], tuple[tuple[bytes, bytes], ...]] = {}

    def beside(self, level: int, k: int) -> tuple[tuple[bytes, bytes], ...]:
        """What stands left and right of node ``k`` in its run, and of its ancestors, up to the root of all."""
        if level == len(self.sizes) - 1:
            return self.above
        if (level, k) not in self._known:
            low, nodes = self.levels[level]
            at = k // FANOUT * FANOUT - low
            run = nodes[at : at + FANOUT]
            own = (b"".join(run[: k % FANOUT]), b"".join(run[k % FANOUT + 1 :]))
            found = (own, *self.beside(level + 1, k // FANOUT))
            if level == 0:
                return found
            self._known[(level, k)] = found
        return self._known[(level, k)]


def fold(node: bytes, beside: tuple[tuple[bytes, bytes], ...]) -> bytes:
    for before, after in beside:
        node = sha(before + node + after)
    return node


@dataclass
class Tree:
    """Numbered leaves (part, g, at, key..., leaf), their partitions (part, g, n, first, total), and border nodes (g, level, k, size, hash)."""

    leaves: DataFrame
    parts: DataFrame
    border: DataFrame

    def subroots(self) -> DataFrame:
        return self.border.where("size = 1").select("g", F.col("hash").alias("subroot"))


def build(leaves: DataFrame, order: list[str]) -> Tree:
    """Trees over ``leaves`` (g, leaf and the columns of ``order``), one per ``g``, leaves ascending by ``order``.

    ``order`` must decide every tie between different rows. ``leaves`` is read from files,
    so the numbers that deal equal rows over partitions are the same on every attempt.
    """
    spark = leaves.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, leaves.count() // PART_ROWS + 1)
    keys = ["g", *order, "_row"]
    ranged = leaves.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_row")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for g in batch.column("g").to_pylist():
                last, at = g, at + 1 if g == last else 0
                places.append(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64()), *batch.columns], names=["part", "at", *batch.schema.names]
            )

    rows = written(in_tasks(ranged, number, f"part int, at bigint, {kinds}"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row per partition and group
    parts = written(rows.groupBy("part", "g").agg(F.count(F.lit(1)).alias("n")).select(
        "part", "g", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy("g")).alias("total")
    ))
    return Tree(rows, parts, _completed(_frontier(rows, parts)))


def _frontier(rows: DataFrame, parts: DataFrame) -> DataFrame:
    def task(leaves: pa.Table, parts: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], [], []]
        for r, hashes in _segments(leaves, parts):
            _, frontier = inner([h.encode() for h in hashes["leaf"]], r["first"], r["total"])
            sizes = level_sizes(r["total"])
            for level, k, node in frontier:
                for column, value in zip(found, (r["g"], level, k, sizes[level], node.decode())):
                    column.append(value)
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(found, kinds)], names=["g", "level", "k", "size", "hash"])

    ship_package(rows.sparkSession)
    return written(rows.select("part", "g", "at", "leaf").groupBy("part").cogroup(parts.groupBy("part")).applyInArrow(
        task, "g string, level int, k bigint, size bigint, hash string"
    ))


def _segments(leaves: pa.Table, about: pa.Table) -> Iterator[tuple[dict, dict[str, list]]]:
    """The rows of ``about`` of one partition, each with the columns of its leaves in order."""
    leaves = leaves.sort_by([("g", "ascending"), ("at", "ascending")])
    start = 0
    for r in sorted(about.to_pylist(), key=lambda r: r["g"].encode()):
        yield r, {name: leaves.column(name).slice(start, r["n"]).to_pylist() for name in leaves.column_names if name not in ("part", "g", "at")}
        start += r["n"]


def _completed(frontier: DataFrame) -> DataFrame:
    """The frontier and all nodes above it. A level takes one grouping of the few border nodes below it."""
    deepest = frontier.agg(F.max("size")).first()[0] or 1
    now = frontier.where("level = 0")
    found = [now]
    for level in range(1, len(level_sizes(deepest))):
        run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "hash"))), lambda x: x["hash"]), "")
        above = now.where("size > 1").groupBy("g", F.expr(f"k div {FANOUT}").alias("k"), F.expr(f"(size + {FANOUT - 1}) div {FANOUT}").alias("size")).agg(F.sha2(run, 256).alias("hash"))
        now = written(frontier.where(F.col("level") == level).unionByName(above.withColumn("level", F.lit(level))))
        found.append(now)
    return reduce(DataFrame.unionByName, found)


def _needed(tree: Tree) -> DataFrame:
    """(part, g, n, first, total, nodes): what a partition fetches for each of its groups."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["part"], r["g"], level, k) for r in batch.to_pylist() for level, k in missing(r["first"], r["n"], r["total"])]
            kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["part", "g", "level", "k"])

    asked = in_tasks(tree.parts, task, "part int, g string, level int, k bigint")
    fetched = asked.join(tree.border, ["g", "level", "k"]).groupBy("part", "g").agg(F.collect_list(F.struct("level", "k", "hash")).alias("nodes"))
    return tree.parts.join(fetched, ["part", "g"], "left")


def _paths(r: dict, hashes: list[str], above: tuple = ()) -> Paths:
    fetched = {(x["level"], x["k"]): x["hash"].encode() for x in r["nodes"] or []}
    return Paths([h.encode() for h in hashes], r["first"], r["total"], fetched, above)


def _tops(tree: Tree) -> DataFrame:
    """(g, subroot, root, above): for every group what stands beside its subroot, and the root of all."""
    roots = build(written(tree.subroots().select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("subroot").alias("leaf"))), ["name"])

    def task(leaves: pa.Table, about: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        for r, columns in _segments(leaves, about):
            paths = _paths(r, columns["leaf"])
            for i, (name, leaf) in enumerate(zip(columns["name"], columns["leaf"])):
                beside = paths.beside(0, r["first"] + i)
                for column, value in zip(found, (name, leaf, paths.top.decode(), [{"b": b.decode(), "a": a.decode()} for b, a in beside])):
                    column.append(value)
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("b", pa.string()), ("a", pa.string())]))]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(found, kinds)], names=["g", "subroot", "root", "above"])

    return written(roots.leaves.groupBy("part").cogroup(_needed(roots).groupBy("part")).applyInArrow(
        task, "g string, subroot string, root string, above array<struct<b: string, a: string>>"
    ))


def hashed(docs: DataFrame, altered: Column | None = None, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """(g, key, leaf, shown): leaf hashes, and those of the rows as they are shown to be verified.

    ``altered`` is the last field as it is shown; without it, rows are shown as they are.
    """
    plain = [docs[f] for f in fields]
    leaf = leaf_hash(plain)
    return docs.select(
        # null sorts before every name
        F.when(docs[group].isNull(), "").otherwise(F.concat(F.lit("="), docs[group].cast("string"))).alias("g"), docs[key].alias("key"), leaf.alias("leaf"),
        (leaf if altered is None else leaf_hash([*plain[:-1], altered])).alias("shown"),
    )


def lowered(docs: DataFrame, one_in: int = 3) -> Column:
    """``text`` with A-Z in lower case where ``one_in`` divides the crc32 of the id; a null id has none."""
    hit = F.crc32(docs["doc_id"].cast("string").cast("binary")) % one_in == 0
    return F.when(hit, F.translate(docs["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(docs["text"])


def proofs(leaves: DataFrame, siblings: bool = False) -> DataFrame:
    """One row per leaf of ``hashed``: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``folded_root`` is folded from ``shown`` and the leaf's siblings. With ``siblings`` the
    proof itself follows as ``siblings``: an array of the digests left and right of each
    node on the path, from the leaf up.

    Null in any field is hashed as ``-``, and a null group is a group before all others. Null
    keys come first. Rows that repeat a key follow each other by their leaves; equal rows are
    leaves of their own and only differ in their siblings. Very long texts are hashed where
    they are read and never move. An empty table has no rows; a group of one leaf is its own
    subroot, and where there is only one group its subroot is the root. A path without any
    sibling has the proof of no bytes. Columns other than the fields are ignored.
    """
    leaves = written(leaves)
    tree = build(leaves, ["key", "leaf", "shown"])
    about = _needed(tree).join(_tops(tree), "g")
    kind = leaves.schema["key"].dataType.simpleString()

    def task(leaves: pa.Table, about: pa.Table) -> pa.Table:
        found: list[list] = [[] for _ in range(7)]
        shown_paths: list = []
        for r, columns in _segments(leaves, about):
            above = tuple((x["b"].encode(), x["a"].encode()) for x in r["above"])
            paths, root = _paths(r, columns["leaf"], above), r["root"].encode()
            folded: dict[tuple[int, bytes], bytes] = {}
            suffix: dict[int, bytes] = {}
            for i, (key, leaf, shown) in enumerate(zip(columns["key"], columns["leaf"], columns["shown"])):
                k = r["first"] + i
                beside = paths.beside(0, k)
                if k // FANOUT not in suffix:
                    suffix = {k // FANOUT: b"".join(b + a for b, a in beside[1:])}
                    folded = {}
                proof = sha((beside[0][0] + beside[0][1] if beside else b"") + suffix[k // FANOUT])
                node = fold(shown.encode(), beside[:1])
                if (k // FANOUT, node) not in folded:  # leaves of one run share the rest of their way
                    folded[(k // FANOUT, node)] = fold(node, beside[1:])
                end = folded[(k // FANOUT, node)]
                for column, value in zip(found, (key, leaf, r["subroot"], r["root"], proof.decode(), end.decode(), end == root)):
                    column.append(value)
                if siblings:
                    shown_paths.append([x.decode() for pair in beside for x in pair])
        kinds = [leaves.schema.field("key").type, *[pa.string()] * 5, pa.bool_()]
        arrays = [pa.array(v, k) for v, k in zip(found, kinds)]
        return pa.Table.from_arrays([*arrays, *([pa.array(shown_paths, pa.list_(pa.string()))] if siblings else [])], names=names)

    names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["siblings"] if siblings else [])]
    schema = f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", siblings array<string>" if siblings else "")
    return tree.leaves.groupBy("part").cogroup(about.groupBy("part")).applyInArrow(task, schema)


def sql(levels: int = 9, group_levels: int = 3) -> str:
    """The same in DuckDB for up to 8**levels rows a language and 8**group_levels languages."""
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    shown = "case when crc % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end"
    head = " || ".join(field(c) for c in FIELDS[:-1])
    step = "xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1))"
    parts = [
        f"""d as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(len(doc_id::varchar)),
    lambda i: [ascii((doc_id::varchar)[i + 1])::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda x, y: {step}), 4294967295) as crc from documents
)""",
        f"l as (select doc_id, lang, sha256({head} || {field('text')}) as leaf, sha256({head} || {field('(' + shown + ')')}) as f0 from d)",
        "t0 as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf, f0) - 1 as p, count(*) over (partition by lang) as n, leaf as h from l)",
        "x0 as (select lang, p, n, h from t0)",
        "p0 as (select lang, doc_id, leaf, f0 as f, p, n, '' as proof, p as w from t0)",
    ]

    def climb(tag: str, levels: int, keep: str) -> None:
        for k in range(levels):
            parts.append(f"{tag}r{k} as materialized (select lang, p // 8 as q, any_value(n) as n, list(h order by p) as run from {tag}x{k} group by lang, p // 8)")
            parts.append(f"{tag}x{k + 1} as (select lang, q as p, case when n > 1 then (n + 7) // 8 else n end as n, case when n > 1 then sha256(array_to_string(run, '')) else run[1] end as h from {tag}r{k})")
            own = "list_concat(run[1 : (w % 8)], run[(w % 8) + 2 : 8])"
            parts.append(
                f"""{tag}p{k + 1} as materialized (select {keep}, case when r.n > 1 then proof || array_to_string({own}, '') else proof end as proof, w // 8 as w,
  case when r.n > 1 then sha256(array_to_string(list_concat(run[1 : (w % 8)], [f], run[(w % 8) + 2 : 8]), '')) else f end as f
  from {tag}p{k} a join {tag}r{k} r on a.w // 8 = r.q and {'a.lang is not distinct from r.lang' if not tag else 'true'})"""
            )

    climb("", levels, "a.lang, doc_id, leaf")
    parts.append(f"s as (select lang, h, row_number() over (order by lang nulls first) - 1 as p, count(*) over () as n from x{levels})")
    parts.append("gx0 as (select 0 as lang, p, n, h from s)")
    parts.append(f"gp0 as (select doc_id, leaf, s.h as subroot, f, proof, s.p as w from p{levels} a join s on a.lang is not distinct from s.lang)")
    climb("g", group_levels, "doc_id, leaf, subroot")
    return "with " + ",\n".join(parts) + f"""
select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, f as folded_root, f = h as verified from gp{group_levels} cross join gx{group_levels}
"""


SQL = sql()
