"""Line deduplication across documents.

Lines are normalised, hashed and counted by distinct document; a line whose key is in too
many documents stays in the first of them only, and each text is put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"
NO_ID = 2**63 - 1


def line_key(line: Column) -> Column:
    """ASCII blanks off both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(docs: DataFrame, least: int) -> DataFrame:
    key = line_key(F.col("line"))
    return (
        docs.select(
            F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_id"),
            F.xxhash64("text").alias("_hash"),
            F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"),
        )
        .select("_id", "_hash", "pos", key.alias("key"))
        .where(F.length("key") >= least)
        .select("_id", "_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(17), "key").alias("h2"))
    )


def shared_lines(docs: DataFrame, documents: int = 2, least: int = 10) -> DataFrame:
    """(h1, h2, first): hashes of keys in at least ``documents`` documents, and the smallest id among them.

    For two documents the smallest and the largest id decide, which sums up before the
    shuffle and holds no set; a higher threshold counts distinct (key, document) pairs.
    """
    lines = _lines(docs, least)
    if documents == 2:
        found = lines.groupBy("h1", "h2").agg(F.min("_id").alias("first"), F.max("_id").alias("last"))
        return found.where("first < last").select("h1", "h2", "first")
    pairs = lines.select("h1", "h2", "_id").distinct()
    found = pairs.groupBy("h1", "h2").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= documents).select("h1", "h2", "first")


def dedup_lines(docs: DataFrame, documents: int = 2, least: int = 10) -> DataFrame:
    """``docs`` with ``kept`` (the text without its dropped lines), ``n_lines`` and ``n_dropped``.

    A key is identified by 128 bits of hash. All lines of a key that is in ``documents`` or
    more documents go, except in the smallest ``doc_id`` that holds it. Keys of fewer than
    ``least`` code points always stay.

    Null or empty text is one empty line. Rows without an id count as one document whose
    id is larger than any other. Rows with one id are one document; rows repeated whole
    are treated alike and stay as many. Columns ``kept``, ``n_lines`` and ``n_dropped`` of
    the input are replaced, all others kept.
    """
    shared = written(shared_lines(docs, documents, least))
    lines = _lines(docs, least)
    drops = (
        lines.join(shared, ["h1", "h2"])
        .where(F.col("_id") != F.col("first"))
        .groupBy("_id", "_hash")
        .agg(F.collect_set("pos").alias("_drop"))
        .withColumnRenamed("_id", "_did").withColumnRenamed("_hash", "_dhash")
    )
    others = [c for c in docs.columns if c not in ("kept", "n_lines", "n_dropped")]
    rows = docs.select(
        F.struct(*others).alias("_row"), F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_hash"),
        F.split(F.coalesce("text", F.lit("")), "\n").alias("_split"),
    )
    joined = rows.join(drops, (rows["_id"] == drops["_did"]) & (rows["_hash"] == drops["_dhash"]), "left")
    keep = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), "_drop")
    text = F.array_join(F.transform(keep, lambda i: F.get(F.col("_split"), i)), "\n")
    found = joined.select(
        "_row",
        F.when(F.col("_drop").isNull(), F.coalesce("_row.text", F.lit(""))).otherwise(text).alias("kept"),
        F.size("_split").cast("bigint").alias("n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("bigint").alias("n_dropped"),
    )
    return found.select("_row.*", "kept", "n_lines", "n_dropped")


SQL = """
with d as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents
), k as (
  select doc_id, line, pos, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from d
), s as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select k.*, (s.key is not null and k.doc_id <> s.first) as gone from k left join s on k.key = s.key)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""
