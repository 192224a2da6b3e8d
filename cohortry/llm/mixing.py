"""Temperature mixing of sources.

Token shares of the sources are raised to an exponent and normalised. The exponent is
bisected until a repetition limit or a target entropy is met; the weights become token
budgets, and each budget is spent on whole epochs plus the head of one block permutation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.shared import written
from cohortry.operators.skew import broadcast_checked, is_small, join_on, salted_join

WORD = r"[^\x09-\x0D\x20]+"
HALVINGS_PER_JOB = 5
SMALL_SOURCES = 10_000


@dataclass(frozen=True)
class MixSpec:
    """Exactly one of ``repetition_limit`` and ``target_entropy`` (nats) is met.

    ``budget`` is the number of tokens of the mix. Without one it is the smallest at which
    no source is cut: the source that repeats least is taken once. ``block_digits`` hex
    digits of a hash name the block of a document (3: 4,096 blocks a source).
    """

    repetition_limit: float | None = 2.0
    target_entropy: float | None = None
    budget: int | None = None
    block_digits: int = 3
    halvings: int = 30
    seed: str = "mix"


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def block_tokens(docs: DataFrame, spec: MixSpec) -> DataFrame:
    """Tokens per (source, block): one small row for each, summed before the shuffle."""
    return (
        docs.select(
            F.col("source").alias("_source"),
            _hash(F.lit(spec.seed), F.col("doc_id")).substr(1, spec.block_digits).alias("_block"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("_tokens"),
        )
        .groupBy("_source", "_block")
        .agg(F.sum("_tokens").alias("_tokens"))
    )


def bisect_exponent(sources: DataFrame, spec: MixSpec) -> float:
    """The exponent in [0, 1], by ``spec.halvings`` halvings.

    A job evaluates the 31 inner points of five halvings at once, so a bisection takes six
    jobs over a table with one row per source. Repetition falls and entropy falls as the
    exponent grows: the smallest exponent within the repetition limit is returned, or the
    largest whose entropy still reaches the target.
    """
    if (spec.repetition_limit is None) == (spec.target_entropy is None):
        raise ValueError("give either a repetition limit or a target entropy")
    held = sources.where("_n > 0").select(F.col("_n").cast("double").alias("n"))

    def met(points: list[float]) -> list[bool]:
        low, high = F.min("n"), F.max("n")
        if spec.repetition_limit is not None and spec.budget is None:
            wanted = [F.pow(high / low, F.lit(1 - a)) <= spec.repetition_limit for a in points]
        elif spec.repetition_limit is not None:
            wanted = [spec.budget * F.pow(low, F.lit(a - 1)) / F.sum(F.pow("n", F.lit(a))) <= spec.repetition_limit for a in points]
        else:
            mass = [F.sum(F.pow("n", F.lit(a))) for a in points]
            spread = [F.sum(F.pow("n", F.lit(a)) * a * F.log("n")) for a in points]
            wanted = [F.log(m) - s / m < spec.target_entropy for m, s in zip(mass, spread)]
        row = held.agg(*[w.alias(f"p{i}") for i, w in enumerate(wanted)]).first()
        return [bool(v) if v is not None else True for v in row]

    first, last = met([0.0, 1.0])
    if spec.repetition_limit is not None and not last:
        raise ValueError("the budget cannot be met within the repetition limit")
    if first:
        return 0.0
    if not last:
        return 1.0
    low, high, left = 0.0, 1.0, spec.halvings
    while left:
        steps = min(left, HALVINGS_PER_JOB)
        points = [low + (high - low) * i / 2**steps for i in range(2**steps + 1)]
        answers = [False, *met(points[1:-1]), True]
        at = answers.index(True)
        low, high, left = points[at - 1], points[at], left - steps
    return high if spec.repetition_limit is not None else low


def budgets(sources: DataFrame, exponent: float, spec: MixSpec) -> DataFrame:
    """Per source: weight, token budget, whole epochs and the tokens of the last, partial one.

    A source without tokens has weight 0 and is kept once.
    """
    n, a = F.col("_n").cast("double"), F.lit(exponent)
    sums = sources.where("_n > 0").agg(
        F.max("_n").cast("double").alias("_most"), F.sum(F.pow(n, a)).alias("_mass")
    )
    total = F.lit(float(spec.budget)) if spec.budget is not None else F.pow("_most", 1 - a) * F.col("_mass")
    exact = total * F.pow(n, a) / F.col("_mass") if spec.budget is not None else F.pow("_most", 1 - a) * F.pow(n, a)
    row = sums.first()
    found = sources.withColumns({"_most": F.lit(row["_most"]), "_mass": F.lit(row["_mass"])}).withColumn(
        "_budget", F.when(F.col("_n") > 0, F.floor(exact + 0.5)).otherwise(F.lit(0)).cast("bigint")
    )
    return found.select(
        "_source", "_n",
        F.when(F.col("_n") > 0, F.pow(n, a) / F.col("_mass")).otherwise(F.lit(0.0)).alias("_weight"),
        "_budget",
        F.when(F.col("_n") > 0, F.floor(F.col("_budget") / F.col("_n"))).otherwise(F.lit(1)).cast("int").alias("_full"),
        F.when(F.col("_n") > 0, F.col("_budget") % F.col("_n")).otherwise(F.lit(0)).cast("bigint").alias("_rest"),
    )


def _block_place(spec: MixSpec, epoch: Column) -> Column:
    return _hash(F.lit(spec.seed), epoch, F.col("_source"), F.col("_block"))


def _doc_place(spec: MixSpec, epoch: Column) -> Column:
    return _hash(F.lit(spec.seed), epoch, F.col("doc_id"))


def mix(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it, with ``epoch``, ``block`` and ``place``.

    In every epoch the blocks of a source are permuted by hash, and so are the documents
    of a block; ``place`` sorts the rows of a (source, epoch). The last epoch is cut where
    its budget is spent: a document is taken if the tokens before it are fewer than the
    rest. Sums per block show which block the cut is in, so only that block is ordered.

    Null text: no tokens. Null source: a source of its own. Null ids hash as an empty
    string. Rows with one id share a place and are taken or left together. Empty tables
    give no rows. Columns of ``docs`` are kept, whatever their names, but for ``epoch``,
    ``block`` and ``place``, which are replaced.
    """
    per_block = written(block_tokens(docs, spec))
    sources = written(per_block.groupBy("_source").agg(F.sum("_tokens").alias("_n")))
    exponent = bisect_exponent(sources, spec)
    plan = written(budgets(sources, exponent, spec))

    epoch = F.col("_full") + 1
    order = Window.partitionBy("_source").orderBy("_bplace", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        join_on(per_block, broadcast_checked(plan.where("_rest > 0"), SMALL_SOURCES), ["_source"])
        .withColumn("_bplace", _block_place(spec, epoch))
        .withColumn("_before", F.coalesce(F.sum("_tokens").over(order), F.lit(0)))
    )
    cut = written(
        blocks.where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_tokens") >= F.col("_rest")))
        .select("_source", "_block", "_bplace", "_full", (F.col("_rest") - F.col("_before")).alias("_need"))
    )
    inside = Window.partitionBy("_source", "_block").orderBy("_dplace").rowsBetween(Window.unboundedPreceding, -1)
    narrow = docs.select(
        F.col("source").alias("_source"), "doc_id",
        _hash(F.lit(spec.seed), F.col("doc_id")).substr(1, spec.block_digits).alias("_block"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("_tokens"),
    )
    in_cut = join_on(narrow, broadcast_checked(cut, SMALL_SOURCES), ["_source", "_block"])
    last = (
        in_cut.withColumn("_dplace", _doc_place(spec, epoch))
        .withColumn("_seen", F.coalesce(F.sum("_tokens").over(inside), F.lit(0)))
        .where("_seen < _need")
        .groupBy("_source", "_bplace")
        .agg(F.max("_dplace").alias("_dlast"))
        .select("_source", F.concat("_bplace", "_dlast").alias("_last"))
    )
    plan = written(join_on(plan, last, ["_source"], "left")).select("_source", "_full", "_last")

    kept = [c for c in docs.columns if c not in ("epoch", "block", "place")]
    rows = docs.select(
        F.struct(*kept).alias("_row"), "doc_id", F.col("source").alias("_source"),
        _hash(F.lit(spec.seed), F.col("doc_id")).substr(1, spec.block_digits).alias("_block"),
    )
    place = lambda e: F.concat(_block_place(spec, e), _doc_place(spec, e))
    planned = join_on(rows, F.broadcast(plan), ["_source"]) if is_small(plan, SMALL_SOURCES) else salted_join(
        rows, plan, ["_source"], F.col("doc_id")
    )
    taken = planned.withColumn("_copies", F.col("_full") + F.when(place(F.col("_full") + 1) <= F.col("_last"), 1).otherwise(0))
    copies = taken.where("_copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    found = copies.select("_row", "epoch", F.col("_block").alias("block"), place(F.col("epoch")).alias("place"))
    return found.select("_row.*", "epoch", "block", "place")


SQL = """
with recursive d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x09-\\x0D\\x20]+')), 0)::bigint as n_tokens,
         substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 3) as block
  from documents
), s as (select source, sum(n_tokens)::bigint as n from d group by source),
lim as (select max(n)::double as most, min(n)::double as least from s where n > 0),
b as (
  select 0 as step, 0.0::double as lo, 1.0::double as hi
  union all
  select step + 1,
         case when pow(most / least, 1 - (lo + hi) / 2) <= 2.0 then lo else (lo + hi) / 2 end,
         case when pow(most / least, 1 - (lo + hi) / 2) <= 2.0 then (lo + hi) / 2 else hi end
  from b, lim where step < 30
), e as (select case when most / least <= 2.0 then 0.0 else hi end as a, most from b, lim where step = 30),
plan as (
  select source, n, floor(pow(most, 1 - a) * pow(n, a) + 0.5)::bigint as budget from s, e where n > 0
  union all select source, n, 0 from s where n = 0
), p as (
  select source, case when n > 0 then budget // n else 1 end as whole, case when n > 0 then budget % n else 0 end as rest from plan
), placed as (
  select d.*, whole, rest, unnest(range(1, whole + 2)) as epoch from d join p on d.source is not distinct from p.source
), ordered as (
  select *, md5('mix:' || epoch || ':' || coalesce(source, '') || ':' || block)
            || md5('mix:' || epoch || ':' || coalesce(doc_id::varchar, '')) as place from placed
), run as (
  select *, coalesce(sum(n_tokens) over (partition by source, epoch order by place rows between unbounded preceding and 1 preceding), 0) as seen
  from ordered
)
select doc_id, source, n_tokens, epoch::int as epoch, block, place from run where epoch <= whole or seen < rest
"""
