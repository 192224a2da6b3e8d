"""Evaluation views over the shared test tables, in Spark and as SQL text.

Each view has a DataFrame function and a CTE of the same name and meaning, so that a
query and its SQL check start from identical rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.functions.hashing import HEX_DIGITS, stable_hash
from cohortry.session import ship_package, spread

C_GRID = [0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0]
REPEATS = 5
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def h(*parts: str) -> str:
    """SQL text of ``stable_hash``; every part is SQL already."""
    joined = "||':'||".join(f"cast({part} as varchar)" for part in parts)
    return f"cast('0x'||left(md5({joined}),15) as bigint)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order: category, release and a binary outcome that may be missing."""
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("group_id"),
        F.col("o_orderstatus").alias("category"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("outcome"),
        F.when(F.col("o_orderpriority") == "5-LOW", "added").otherwise("original").alias("release"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
    )


RECORDS = """records as (
  select o_orderkey as id, o_custkey as group_id, o_orderstatus as category,
    case o_orderstatus when 'F' then 1 when 'O' then 0 end as outcome,
    case when o_orderpriority = '5-LOW' then 'added' else 'original' end as release,
    o_orderpriority as priority, o_totalprice as price
  from orders)"""


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where(F.col("outcome").isNotNull())


COHORT = RECORDS + """, cohort as (select * from records where outcome is not null)"""


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold of each record and repeat; whole groups share a fold."""
    repeats = F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))
    return (
        cohort(spark, sf_dir)
        .select("id", "group_id", repeats.alias("repeat"))
        .withColumn("fold", (stable_hash(23, "repeat", "group_id") % FOLDS).cast("int"))
    )


FOLD_ROWS = COHORT + f""", fold_rows as (
  select id, group_id, cast(repeat as integer) as repeat,
    cast({h('23', 'repeat', 'group_id')} % {FOLDS} as integer) as fold
  from cohort cross join range({REPEATS}) as r(repeat))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long prediction table: one row per record, model and repeat, with many tied scores."""
    models = F.explode(F.array(F.lit("B"), F.lit("D"))).alias("model")
    repeats = F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("repeat")
    shift = F.when(F.col("model") == "B", 1500).otherwise(1200)
    base = cohort(spark, sf_dir).select("*", models).select("*", repeats)
    return (
        base.withColumn("draw", stable_hash(17, "model", "repeat", "id") % 10000)
        .withColumn("probability", (F.col("draw") + shift * F.col("outcome")) / F.lit(12000.0))
        .withColumn("outer_fold", (stable_hash(23, "repeat", "group_id") % FOLDS).cast("int"))
        .withColumn("youden_threshold", F.lit(0.45) + F.lit(0.02) * F.col("outer_fold"))
        .withColumn("sensitivity_threshold", F.col("youden_threshold") - F.lit(0.1))
        .withColumn(
            "selected_c",
            F.element_at(
                F.array(*[F.lit(c) for c in C_GRID]),
                (stable_hash(29, "model", "repeat", "outer_fold") % len(C_GRID) + 1).cast("int"),
            ),
        )
        .withColumn("convergence_warnings", (stable_hash(31, "model", "repeat", "outer_fold") % 3).cast("int"))
        .drop("draw")
    )


PREDICTIONS = COHORT + f""", scored as (
  select c.*, model, cast(repeat as integer) as repeat,
    {h('17', 'model', 'repeat', 'id')} % 10000 as draw,
    cast({h('23', 'repeat', 'group_id')} % {FOLDS} as integer) as outer_fold
  from cohort c cross join (values ('B'), ('D')) m(model) cross join range({REPEATS}) r(repeat)),
predictions as (
  select id, group_id, category, outcome, release, priority, price, model, repeat, outer_fold,
    (draw + (case when model = 'B' then 1500 else 1200 end) * outcome) / 12000.0::double as probability,
    0.45::double + 0.02::double * outer_fold as youden_threshold,
    0.45::double + 0.02::double * outer_fold - 0.1::double as sensitivity_threshold,
    ({'[' + ','.join(f'{c}::double' for c in C_GRID) + ']'})[1 + {h('29', 'model', 'repeat', 'outer_fold')} % {len(C_GRID)}] as selected_c,
    cast({h('31', 'model', 'repeat', 'outer_fold')} % 3 as integer) as convergence_warnings
  from scored)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dense vector per id, with an outcome and a group."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("vec"),
        F.when(F.col("label") < 5, 1).otherwise(0).alias("outcome"),
        (F.col("vec_id") % 40).alias("group_id"),
    )


VECTORS = """vectors as (
  select vec_id as id, embedding as vec, case when label < 5 then 1 else 0 end as outcome,
    vec_id % 40 as group_id
  from embeddings)"""

BIT_CUT = 0.1


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions whose value exceeds a cut; every third id has no key."""
    on = F.filter(
        F.transform(F.col("embedding"), lambda x, i: F.when(x > F.lit(BIT_CUT), i)), lambda i: i.isNotNull()
    )
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") % 3 == 0, "").otherwise(F.concat(F.lit("L"), F.col("label"))).alias("key"),
        on.alias("bits"),
    )


BITS = f"""bits as (
  select vec_id as id, case when vec_id % 3 = 0 then '' else 'L'||label end as key,
    [i::integer for i in range(len(embedding)) if embedding[i+1] > {BIT_CUT}::float] as bits
  from embeddings)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure facts per part: the input of the rule cascade."""
    part = table(spark, sf_dir, "part")
    roll = lambda seed, n: stable_hash(seed, "p_partkey") % n
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        (roll(41, 20) != 0).alias("source_present"),
        (roll(42, 20) != 0).alias("parse_ok"),
        (roll(43, 10) == 0).alias("has_metal"),
        (roll(44, 30) != 0).alias("standardise_ok"),
        (roll(45, 25) != 0).alias("has_carbon"),
        (roll(46, 4) == 0).alias("multi_component"),
        (roll(47, 3)).cast("int").alias("n_organic_fragments"),
        F.col("p_size").alias("n_heavy_atoms"),
        (roll(48, 9)).cast("int").alias("n_amide_bonds"),
        F.col("p_retailprice").alias("mol_weight"),
        F.concat_ws("/", "p_brand", "p_size").alias("parent_key"),
        F.when(roll(49, 5) < 2, 1).when(roll(49, 5) < 4, 0).alias("outcome"),
    )


def _roll(seed: int, n: int) -> str:
    return f"{h(str(seed), 'p_partkey')} % {n}"


FACTS = f"""facts as (
  select p_partkey as id, p_name as name,
    {_roll(41, 20)} <> 0 as source_present, {_roll(42, 20)} <> 0 as parse_ok,
    {_roll(43, 10)} = 0 as has_metal, {_roll(44, 30)} <> 0 as standardise_ok,
    {_roll(45, 25)} <> 0 as has_carbon, {_roll(46, 4)} = 0 as multi_component,
    cast({_roll(47, 3)} as integer) as n_organic_fragments, p_size as n_heavy_atoms,
    cast({_roll(48, 9)} as integer) as n_amide_bonds, p_retailprice as mol_weight,
    p_brand||'/'||p_size as parent_key,
    case when {_roll(49, 5)} < 2 then 1 when {_roll(49, 5)} < 4 then 0 end as outcome
  from part)"""


REMOVABLE = ["ring", "widget", "bolt", "gear"]


def _short_name():
    return F.concat_ws(" ", "p_size", "p_brand")


def _full_name():
    return F.concat_ws(" ", "p_size", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(2)))


PART_NAMES = """part_names as (select *, p_size||' '||p_brand as short_name,
  p_size||' '||p_brand||' '||split_part(p_name, ' ', 2) as full_name from part)"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names to resolve: size, brand and a last word that may be removable."""
    return table(spark, sf_dir, "part").select(_full_name().alias("name")).distinct()


NAMES = "names as (select distinct full_name as name from part_names)"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference entries: one type is listed under full names, the others under short ones."""
    query_name = F.when(F.col("p_type") == "ECONOMY", _full_name()).otherwise(_short_name())
    return table(spark, sf_dir, "part").select(
        query_name.alias("query_name"),
        F.when(F.col("p_size") % 2 == 0, F.upper(query_name)).otherwise(F.col("p_type")).alias("title"),
        F.col("p_partkey").alias("candidate_id"),
        F.col("p_brand").alias("payload"),
    )


CANDIDATES = """listed as (
  select *, case when p_type = 'ECONOMY' then full_name else short_name end as query_name from part_names),
candidates as (
  select query_name, case when p_size % 2 = 0 then upper(query_name) else p_type end as title,
    p_partkey as candidate_id, p_brand as payload
  from listed)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids per document: hashed words, 0 standing for an unknown word.

    A word is hashed once for many documents: tasks keep the ids of up to KNOWN_WORDS words.
    """
    ship_package(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _TokenIds()
        for rows in (batch.slice(at, 1_000) for batch in batches for at in range(0, batch.num_rows, 1_000)):
            found = []
            for text in rows.column("text").to_pylist():
                if len(known) > KNOWN_WORDS:
                    known.clear()
                words = [] if text is None else text.strip(" ").split(" ")
                found.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)), mask=rows.column("text").is_null())
            yield pa.RecordBatch.from_arrays([rows.column("id"), ids], names=["id", "token_ids"])

    documents = spread(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("id"), "text")
    return documents.mapInArrow(task, f"id {documents.schema['id'].dataType.simpleString()}, token_ids array<bigint>")


KNOWN_WORDS = 500_000


class _TokenIds(dict):
    """Token id of a word, from its stable hash with seed 59; about one word in fifty is unknown."""

    def __missing__(self, word: str) -> int:
        hashed = int(hashlib.md5(f"59:{word}".encode()).hexdigest()[:HEX_DIGITS], 16)
        self[word] = found = 0 if hashed % 50 == 0 else hashed % 30000 + 1
        return found


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tokens in rows (id, position, token)."""
    return tokens(spark, sf_dir).select("id", F.posexplode("token_ids").alias("position", "token"))


TOKENS = f"""tokens as (
  select doc_id as id, [case when {h('59', 'w')} % 50 = 0 then 0 else {h('59', 'w')} % 30000 + 1 end
    for w in string_split(trim(text, ' '), ' ')] as token_ids
  from documents)"""


def kept_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer ids with natural holes: orders that have line items."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("value"))


KEPT_IDS = "kept_ids as (select l_orderkey as value from lineitem)"
