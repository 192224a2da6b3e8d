"""Joins and counts that stay spread when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

SALTS = 64
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 256_000_000
HOT_ROWS = 10_000


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of every key, which Spark still runs as a hash or merge join."""
    return reduce(lambda a, b: a & b, [left[key].eqNullSafe(right[key]) for key in keys])


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on null-safe keys and keep the left copy of them."""
    if not keys:
        raise ValueError("join_on needs at least one key")
    renamed = right.select(
        *[right[key].alias(f"_r_{key}") for key in keys],
        *[right[name] for name in right.columns if name not in keys],
    )
    condition = reduce(lambda a, b: a & b, [left[key].eqNullSafe(renamed[f"_r_{key}"]) for key in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{key}" for key in keys])


def value_bytes(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes in memory; 8 for numbers, dates and nulls."""
    if isinstance(kind, (StringType, BinaryType)):
        own = F.octet_length(value)
    elif isinstance(kind, ArrayType):
        element = kind.elementType
        if isinstance(element, (StringType, BinaryType, ArrayType, MapType, StructType)):
            own = F.aggregate(value, F.lit(0).cast("bigint"), lambda held, x: held + value_bytes(x, element))
        else:
            own = F.array_size(value) * 8
    elif isinstance(kind, MapType):
        own = value_bytes(F.map_keys(value), ArrayType(kind.keyType)) + value_bytes(F.map_values(value), ArrayType(kind.valueType))
    elif isinstance(kind, StructType):
        own = reduce(lambda a, b: a + b, [value_bytes(value[f.name], f.dataType) for f in kind.fields], F.lit(0))
    else:
        return F.lit(8).cast("bigint")
    return F.coalesce(own, F.lit(0)).cast("bigint") + 8


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of ``df`` takes in memory."""
    return value_bytes(F.struct("*"), df.schema)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows of at most ``most`` bytes in all; counting stops beyond ``rows``.

    Only a length per row is gathered, whatever the width of the rows.
    """
    found = df.select(row_bytes(df).alias("_bytes")).limit(rows + 1).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes")
    ).first()
    return found["rows"] <= rows and found["bytes"] <= most


def broadcast_checked(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when its rows and bytes show it is small; otherwise leave the choice open."""
    return F.broadcast(df) if is_small(df, rows, most) else df


def hot_keys(rows: DataFrame, keys: list[str], shares: int = SALTS, least: int | None = None) -> list[Row]:
    """Keys that hold more than 1/shares of all rows, and at least ``least`` rows (HOT_ROWS).

    There can be fewer than ``shares`` of them, whatever the size of ``rows``. One job
    counts rows per key with map-side partials and brings back the largest counts.
    """
    total = Observation()
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).observe(total, F.sum("_n").alias("all"))
    least = HOT_ROWS if least is None else least
    largest = counted.orderBy(F.col("_n").desc()).limit(shares).collect()
    return [row for row in largest if row["_n"] * shares > total.get["all"] and row["_n"] >= least]


def whole_row(df: DataFrame) -> Column:
    """All columns as one value, to spread rows by."""
    return F.struct(*df.columns)


def _is_one_of(df: DataFrame, keys: list[str], found: list[Row]) -> Column:
    kinds = {f.name: f.dataType for f in df.schema}
    same = lambda row: reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(row[k]).cast(kinds[k])) for k in keys]
    )
    return reduce(lambda a, b: a | b, [same(row) for row in found])


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread: Column,
    how: str = "inner",
    salts: int = SALTS,
    least: int | None = None,
    hot: list[Row] | None = None,
) -> DataFrame:
    """Join rows to a lookup, splitting the keys that hold a large share of ``rows``.

    Rows of a hot key are dealt over ``salts`` tasks by ``spread``; the lookup rows of
    that key are repeated as often. Other keys, and tables without hot keys, are joined
    as usual. Give ``hot`` where the hot keys are known already.
    """
    hot = hot_keys(rows, keys, SALTS, least) if hot is None else hot
    if not hot:
        return join_on(rows, lookup, keys, how)
    dealt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    salted = rows.withColumn("_salt", F.when(_is_one_of(rows, keys, hot), dealt).otherwise(F.lit(0)))
    every = F.when(_is_one_of(lookup, keys, hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = lookup.withColumn("_salt", F.explode(every))
    return join_on(salted, repeated, [*keys, "_salt"], how).drop("_salt")
