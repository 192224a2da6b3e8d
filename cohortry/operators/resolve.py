"""From names to reference records: candidates, adjudication, fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.text import fold, same_name, trimmed, without_suffix
from cohortry.operators.skew import salted_join

# How a record was found and chosen.
EXACT = "exact-name"
FALLBACK = "salt-suffix-fallback"
BY_TITLE = "exact-title-among-candidates"
ONLY_ONE = "unique-pubchem-name-result"


def name_candidates(df: DataFrame, name: str, suffixes: list[str]) -> DataFrame:
    """Queries to try per row: the trimmed name, then the name less one suffix if that changes it."""
    exact = trimmed(F.col(name))
    stripped = without_suffix(F.col(name), suffixes)
    tries = F.array(
        F.struct(exact.alias("query"), F.lit(EXACT).alias("method")),
        F.when(fold(stripped) != fold(exact), F.struct(stripped.alias("query"), F.lit(FALLBACK).alias("method"))),
    )
    kept = F.filter(tries, lambda t: t.isNotNull())
    return df.select("*", F.posexplode(kept).alias("attempt", "_t")).select(
        *df.columns, "attempt", "_t.query", "_t.method"
    )


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct folded keys with no stored value. A stored NULL is a miss and is asked again."""
    stored = cache.where(F.col(value).isNotNull()).select(fold(F.col(key)).alias("key"))
    return wanted.select(fold(F.col(key)).alias("key")).distinct().join(stored, "key", "left_anti")


def candidate_rows(queries: DataFrame, candidates: DataFrame, query: str, candidate_query: str) -> DataFrame:
    """Every candidate of every distinct query, in rows; ``key`` is the folded query.

    A name with very many candidates only makes many rows here, never one long list. A NULL
    name asks for nothing and matches nothing.
    """
    asked = queries.select(trimmed(F.col(query)).alias("query")).withColumn("key", fold(F.col("query")))
    asked = asked.where("key is not null").groupBy("key").agg(F.min("query").alias("query"))
    offered = candidates.withColumn("key", fold(F.col(candidate_query))).where("key is not null")
    return salted_join(offered, asked, ["key"], F.struct(*candidates.columns))


def adjudicate_candidates(
    queries: DataFrame,
    candidates: DataFrame,
    query: str = "query",
    candidate_query: str = "query_name",
    title: str = "title",
    id: str = "candidate_id",
    payload: list[str] | None = None,
) -> DataFrame:
    """One row per query that has an accepted candidate.

    The one candidate whose title equals the query wins; failing that, the only
    candidate there is. Any other query gives no row. ``candidate_rows`` lists all ids.
    """
    carried = [id, title, *(payload or [])]
    exact = same_name(F.col(title), F.col("query"))
    whole = F.struct(*carried)
    grouped = candidate_rows(queries, candidates, query, candidate_query).groupBy("key", "query").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_if(F.coalesce(exact, F.lit(False))).alias("_exact"),
        F.max(F.when(exact, whole)).alias("_by_title"),
        F.max(whole).alias("_any"),
    )
    by_title, alone = F.col("_exact") == 1, F.col("candidate_count") == 1
    chosen = F.when(by_title, F.col("_by_title")).when(alone, F.col("_any"))
    return (
        grouped.where(by_title | alone)
        .withColumn("_c", chosen)
        .select(
            "key",
            "query",
            "candidate_count",
            F.when(by_title, BY_TITLE).otherwise(ONLY_ONE).alias("adjudication"),
            *[F.col(f"_c.{c}").alias(c) for c in carried],
        )
    )


def resolve_with_fallback(
    names: DataFrame, adjudicated: DataFrame, name: str, suffixes: list[str], id: str = "candidate_id", title: str = "title"
) -> DataFrame:
    """Resolve each name by its exact form, else by the stripped form.

    The stripped form's record stays beside it as the ``active`` alternative even when
    the exact form wins.
    """
    stripped = without_suffix(F.col(name), suffixes)
    exact_query = trimmed(F.col(name))
    asked = names.withColumns(
        {
            "_exact_key": fold(F.col(name)),
            "_fallback": F.when(fold(stripped) != fold(F.col(name)), stripped),
        }
    ).withColumn("_fallback_key", fold(F.col("_fallback")))

    def side(prefix: str) -> DataFrame:
        return adjudicated.select(
            F.col("key").alias(f"{prefix}_key"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in (id, title, "candidate_count", "adjudication")],
        )

    joined = salted_join(asked, side("_exact"), ["_exact_key"], F.col(name), "left")
    # names without a second form take no part in the second join
    second = salted_join(joined.where("_fallback_key is not null"), side("_fallback"), ["_fallback_key"], F.col(name), "left")
    joined = second.unionByName(joined.where("_fallback_key is null"), allowMissingColumns=True)
    has_exact, has_fallback = F.col(f"_exact_{id}").isNotNull(), F.col(f"_fallback_{id}").isNotNull()

    def pick(column: str) -> Column:
        return F.when(has_exact, F.col(f"_exact_{column}")).otherwise(F.col(f"_fallback_{column}"))

    return joined.select(
        *names.columns,
        F.when(has_exact | has_fallback, "resolved").otherwise("unresolved").alias("identity_status"),
        F.when(has_exact, EXACT).when(has_fallback, FALLBACK).otherwise("unresolved").alias("resolution_method"),
        F.when(has_exact, exact_query).when(has_fallback, F.col("_fallback")).otherwise(F.col(name)).alias("query"),
        pick(id).alias(id),
        pick(title).alias(title),
        pick("candidate_count").alias("candidate_count"),
        pick("adjudication").alias("adjudication"),
        F.when(has_fallback, F.col("_fallback")).alias("active_query"),
        F.col(f"_fallback_{id}").alias(f"active_{id}"),
        F.col(f"_fallback_{title}").alias(f"active_{title}"),
    )
