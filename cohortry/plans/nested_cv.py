"""Nested cross-validation and transport as compositions of folds, shared fits and metrics."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.contracts import (
    ContractError, common_complete, enforce, grid_gaps, key_violations, modal_choice, pairing_violations, set_diff, split_groups,
    validated_join,
)
from cohortry.operators.curate import population as keep_population
from cohortry.operators.fit import (
    FitOptions, FitTask, Fitted, fit_logistic_tasks, predict_tasks, split_scalings,
)
from cohortry.operators.folds import deal_groups
from cohortry.operators.metrics import auroc_of_counts, operating_thresholds, thresholds_of_collapsed
from cohortry.operators.prefix import score_splits, with_score_cells
from cohortry.operators.skew import join_on, salted_join
from cohortry.operators.vectors import Block, assemble_blocks, continuous_positions
from cohortry.session import cut_lineage, saved

# The designs, weightings and grid an analysis may use.
DESIGNS = ("scaffold_grouped", "stratified_random")
WEIGHTS = ("primary", "balanced")
C_GRID = (0.0001, 0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
SEEDS = (120812, 120813, 120814, 120815, 120816)
INNER_SEED = 120850


@dataclass(frozen=True)
class AnalysisSpec:
    """Settings of one analysis; unknown names are errors."""

    outer_folds: int = 5
    inner_folds: int = 5
    repeats: int = len(SEEDS)
    grid: tuple[float, ...] = C_GRID
    sensitivity_target: float = 0.8
    inner_seed: int = INNER_SEED
    population: str = "primary"
    design: str = "scaffold_grouped"
    weights: str = "primary"
    populations: dict[str, list[str]] | None = None
    fit: FitOptions = field(default_factory=FitOptions)

    def __post_init__(self) -> None:
        if self.design not in DESIGNS:
            raise ValueError(f"design must be one of {DESIGNS}, not {self.design!r}")
        if self.weights not in WEIGHTS:
            raise ValueError(f"weights must be one of {WEIGHTS}, not {self.weights!r}")
        if sorted(set(self.grid)) != sorted(self.grid):
            raise ValueError("the grid repeats a value")

    def options(self) -> FitOptions:
        balanced = self.weights == "balanced"
        return FitOptions(
            self.fit.penalise_intercept, balanced, self.fit.max_iterations, self.fit.tolerance, self.fit.method
        )

    def outers(self) -> int:
        return self.repeats * self.outer_folds


def balanced_weights(df: DataFrame, keys: list[str], outcome: str) -> DataFrame:
    """Weight n / (classes x n_class) of each outcome class per keys, over the given training rows."""
    counts = df.groupBy(*keys, outcome).agg(F.count(F.lit(1)).alias("rows"))
    totals = counts.groupBy(*keys).agg(F.sum("rows").alias("_all"), F.count(F.lit(1)).alias("_k"))
    return join_on(counts, totals, keys).select(
        *keys, outcome, "rows", (F.col("_all") / (F.col("_k") * F.col("rows"))).alias("weight")
    )


def inner_parts(folds: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """Inner part of each split group in every outer split, -1 where the group is test data.

    ``folds`` has (split_group, outcome, repeat, fold). The outer split of (repeat, fold)
    is number repeat x outer_folds + fold.
    """
    sizes = folds.groupBy("repeat", "split_group").agg(
        F.min("fold").alias("_own"), F.count(F.lit(1)).alias("_n"), F.sum("outcome").alias("_pos")
    )
    others = F.filter(F.sequence(F.lit(0), F.lit(spec.outer_folds - 1)), lambda f: f != F.col("_own"))
    training = sizes.select("*", F.explode(others).alias("outer_fold"))
    seed = F.lit(spec.inner_seed) + F.col("repeat") * 10 + F.col("outer_fold")
    dealt = deal_groups(training, ["repeat", "outer_fold"], "split_group", spec.inner_folds, seed)
    entries = F.struct((F.col("repeat") * spec.outer_folds + F.col("outer_fold")).alias("outer"), F.col("fold"))
    maps = dealt.groupBy("split_group").agg(F.map_from_entries(F.collect_list(entries)).alias("_m"))
    outers = F.sequence(F.lit(0), F.lit(spec.outers() - 1))
    return maps.select("split_group", F.transform(outers, lambda o: F.coalesce(F.col("_m")[o], F.lit(-1))).alias("parts"))


def pick_regularisation(
    candidates: DataFrame, keys: list[str], c: str = "c", score: str = "inner_auroc", margin: float = 1e-12
) -> DataFrame:
    """Walk C upwards and move only to a score better by more than ``margin``."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(c).alias("c"), F.coalesce(score, F.lit(float("-inf"))).alias("s"))))
    start = F.struct(F.lit(None).cast("double").alias("c"), F.lit(float("-inf")).alias("s"))
    best = F.aggregate(
        "_o", start, lambda a, x: F.when(a["c"].isNull() | (x["s"] > a["s"] + margin), x).otherwise(a)
    )
    return candidates.groupBy(*keys).agg(ordered.alias("_o")).select(
        *keys, best["c"].alias("selected_c"), best["s"].alias("inner_auroc")
    )


@dataclass
class Tuning:
    """What inner tuning found: candidates and choices as tables, choices and scalings also as values."""

    candidates: DataFrame
    choices: DataFrame
    thresholds: DataFrame
    selected: dict[int, float]
    scalings: dict
    fitted: list[Fitted]


def _fit_counts(spark, fitted: list[Fitted], name: str = "convergence_warnings") -> DataFrame:
    counts: dict[tuple[int, float], int] = {}
    for f in fitted:
        key = (f.task.outer, float(f.task.c))
        counts[key] = counts.get(key, 0) + int(not f.converged)
    rows = [(outer, c, n) for (outer, c), n in counts.items()]
    return spark.createDataFrame(rows, f"outer int, c double, {name} int")


def tune(base: DataFrame, spec: AnalysisSpec, width: int, positions: list[int]) -> Tuning:
    """Choose C per outer split by one AUROC over pooled inner scores, and thresholds from them.

    ``base`` has (id, outcome, vec, parts). The inner parts are the same for every C.
    """
    scalings = split_scalings(base, positions, width)
    tasks = [
        FitTask(outer, part, float(c))
        for outer in range(spec.outers()) for part in range(spec.inner_folds) for c in sorted(spec.grid)
    ]
    fitted = fit_logistic_tasks(base, tasks, scalings, width, spec.options())
    pooled = predict_tasks(base, fitted, scalings, ["outcome"], "inner")
    # rows are scored once; AUROC and thresholds start from counts per score
    counts = saved(pooled.withColumn("probability", F.col("probability") + F.lit(0.0)).groupBy("outer", "c", "probability").agg(
        F.count_if(F.col("outcome") == 1).alias("pos"), F.count_if(F.col("outcome") == 0).alias("neg")
    ))
    scores = auroc_of_counts(counts, ["outer", "c"], "probability").withColumnRenamed("auroc", "inner_auroc")
    # one row per outer split and C
    candidates = cut_lineage(join_on(scores, _fit_counts(base.sparkSession, fitted), ["outer", "c"]))
    choices = cut_lineage(pick_regularisation(candidates, ["outer"]))
    selected = {row["outer"]: row["selected_c"] for row in choices.collect()}
    picked = F.broadcast(choices.select("outer", F.col("selected_c").alias("c")))  # one row per outer split
    best = counts.join(picked, ["outer", "c"])
    celled = with_score_cells(best, "probability", score_splits(best, "probability"))
    thresholds = thresholds_of_collapsed(celled, ["outer"], "probability", spec.sensitivity_target)
    return Tuning(candidates, choices, thresholds, selected, scalings, fitted)


def prepare_rows(cohort: DataFrame, folds: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """Rows of the population with their split parts: the cohort's columns plus ``parts``.

    ``folds`` holds (id, repeat, fold) for the whole cohort, so a subset keeps its folds.
    """
    kept = keep_population(cohort, spec.population, prefixes=spec.populations)
    split = "group_id" if spec.design == "scaffold_grouped" else "id"
    keyed = kept.withColumn("split_group", F.col(split).cast("string"))
    rows = keyed.select("id", "split_group", "outcome").join(folds.select("id", "repeat", "fold"), "id")
    parts = inner_parts(rows, spec)
    return salted_join(keyed, parts, ["split_group"], F.col("id")).drop("split_group")


def fold_violations(cohort: DataFrame, folds: DataFrame, spec: AnalysisSpec) -> DataFrame:
    """(kind, name, problem) for rows of the population whose folds cannot be used.

    Every id needs each repeat once, with a fold in range; rows that are split together,
    all of a group or those of one id, need the same fold in a repeat.
    """
    kept = keep_population(cohort, spec.population, prefixes=spec.populations)
    split = "group_id" if spec.design == "scaffold_grouped" else "id"
    asked = kept.select("id", F.col(split).cast("string").alias("split_group")).distinct()
    inside = F.col("repeat").between(0, spec.repeats - 1) & F.col("fold").between(0, spec.outer_folds - 1)
    seen = folds.groupBy("id").agg(
        F.count(F.lit(1)).alias("_n"), F.count_distinct("repeat").alias("_repeats"), F.count_if(~F.coalesce(inside, F.lit(False))).alias("_outside")
    )
    joined = join_on(asked.select("id").distinct(), seen, ["id"], "left").fillna(0, ["_n", "_repeats", "_outside"])
    checks = {
        "missing": F.col("_repeats") < spec.repeats, "repeated": F.col("_n") > F.col("_repeats"), "outside": F.col("_outside") > 0,
    }
    problems = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda p: p.isNotNull())
    of_ids = joined.select(F.lit("id").alias("kind"), F.col("id").cast("string").alias("name"), F.explode(problems).alias("problem"))
    placed = salted_join(folds.select("id", "repeat", "fold"), asked, ["id"], F.struct("repeat", "fold"))
    of_groups = split_groups(placed, "split_group", "repeat", "fold").select(
        F.lit("group").alias("kind"), F.col("split_group").alias("name"), F.lit("split").alias("problem")
    ).distinct()
    return of_ids.unionByName(of_groups)


def transport_violations(
    development: DataFrame, predictions: DataFrame, models: list[str], spec: AnalysisSpec, folds: DataFrame | None = None
) -> DataFrame:
    """(kind, name, problem) for development predictions that a transport must not start from.

    They hold exactly the given models, exactly the repeats 0 .. n-1, and exactly the
    development ids; ``folds``, where given, hold development ids only.
    """
    told = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(kind).cast("string").alias("name"), "problem")
    sets = {"model": models, "repeat": list(range(spec.repeats))}
    parts = [
        told(grid_gaps(predictions.select(kind).distinct(), {kind: values}), kind) for kind, values in sets.items()
    ]
    seen = predictions.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("model", "repeat").alias("_cells"))
    known = development.select("id", F.lit(1).alias("_known"))
    joined = seen.join(known, "id", "full_outer")
    full = len(models) * spec.repeats
    checks = {
        "stranger": F.col("_known").isNull(), "uncovered": F.col("_n").isNull(),
        "incomplete": F.col("_cells") < full, "repeated": F.col("_n") > F.col("_cells"),
    }
    problems = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]), lambda p: p.isNotNull())
    parts.append(told(joined.select("id", F.explode(problems).alias("problem")), "id"))
    if folds is not None:
        strangers = folds.select("id").distinct().join(development.select("id"), "id", "left_anti")
        parts.append(told(strangers.withColumn("problem", F.lit("fold of a stranger")), "id"))
    return reduce(DataFrame.unionByName, parts)


def nested_cv(
    cohort: DataFrame,
    folds: DataFrame,
    tables: dict[str, DataFrame],
    models: dict[str, list[Block]],
    spec: AnalysisSpec = AnalysisSpec(),
    held_out: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions per (id, model, repeat), and the tuning log.

    ``cohort`` has (id, group_id, outcome, ...) with more columns carried along; ``tables``
    maps block names to (id, vec); ``models`` lists the blocks of each model. ``held_out``,
    where given, are exactly the ids with all features that ``cohort`` must not hold.
    Folds that ``fold_violations`` names, repeated ids and any lost row raise ``ContractError``.
    """
    # both are read by several checks and plans
    cohort, folds = saved(cohort), saved(folds.select("id", "repeat", "fold"))
    enforce(key_violations(cohort, ["id"]), "cohort ids")
    enforce(fold_violations(cohort, folds, spec), "folds of the cohort")
    if held_out is not None:
        features = list(tables.values())
        apart = common_complete(features[0].select("id"), features[1:]).join(cohort.select("id"), "id", "left_anti").distinct()
        enforce(set_diff(apart, held_out), "ids held out")
    rows = saved(prepare_rows(cohort, folds, spec))
    outputs, logs = [], []
    for model, blocks in models.items():
        width, positions = sum(b.width for b in blocks), continuous_positions(blocks)
        base = saved(assemble_blocks(rows.select("id", "outcome", "parts"), tables, blocks))
        found = tune(base, spec, width, positions)
        refits = fit_logistic_tasks(
            base, [FitTask(o, None, c) for o, c in sorted(found.selected.items())], found.scalings, width, spec.options()
        )
        scored = predict_tasks(base, refits, found.scalings, ["id"], "outer").withColumnRenamed("c", "selected_c")
        warned = _fit_counts(base.sparkSession, refits).drop("c")
        # one row per outer split, a number the settings fix
        settings = F.broadcast(join_on(found.thresholds, warned, ["outer"]))
        outputs.append(join_on(scored, settings, ["outer"]).withColumn("model", F.lit(model)))
        logs.append(join_on(found.candidates, found.choices.select("outer", "selected_c"), ["outer"]).withColumn("model", F.lit(model)))
    splits = {
        "repeat": F.floor(F.col("outer") / spec.outer_folds).cast("int"),
        "outer_fold": (F.col("outer") % spec.outer_folds).cast("int"),
    }
    predictions = reduce(DataFrame.unionByName, outputs).withColumns(splits).drop("outer")
    carried = join_on(predictions, rows.drop("parts"), ["id"])
    result = saved(carried)
    asked = keep_population(cohort, spec.population, prefixes=spec.populations).count()
    expected = asked * spec.repeats * len(models)
    if result.count() != expected:
        raise ContractError(f"Expected {expected} predictions, found {result.count()}")
    if {"B", "D"} <= set(models):
        enforce(pairing_violations(result, ["id", "repeat"], "model", ["B", "D"], "outcome", "group_id"), "B and D are not paired")
    tuning = reduce(DataFrame.unionByName, logs).withColumns(splits).drop("outer")
    return result, tuning


def transport(
    development: DataFrame,
    predictions: DataFrame,
    tuning: DataFrame,
    update: DataFrame,
    tables: dict[str, DataFrame],
    models: dict[str, list[Block]],
    spec: AnalysisSpec = AnalysisSpec(),
) -> DataFrame:
    """Fit each model once on all development rows and score the untouched update rows.

    Coverage of the development predictions and of the tuning grid is checked before
    ``update`` is read. C is the modal choice, ties to the smaller; thresholds come from
    predictions averaged over repeats.
    """
    names = list(models)
    # read by several checks and plans
    development = saved(development)
    enforce(key_violations(development, ["id"]), "development ids")
    enforce(transport_violations(development, predictions, names, spec), "development predictions")
    dims = {"model": names, "repeat": list(range(spec.repeats)), "outer_fold": list(range(spec.outer_folds))}
    fits = tuning.select("model", "repeat", "outer_fold", "selected_c").distinct()
    enforce(grid_gaps(fits, dims), "tuning grid")
    enforce(fits.where(~F.col("selected_c").isin(list(spec.grid))), "selected C outside the grid")

    chosen = {r["model"]: r["chosen"] for r in modal_choice(fits, ["model"], "selected_c").collect()}
    averaged = predictions.groupBy("model", "id").agg(F.avg("probability").alias("probability"))
    ordered = validated_join(averaged, development.select("id", "outcome"), ["id"])
    thresholds = F.broadcast(operating_thresholds(ordered, ["model"], "outcome", "probability", spec.sensitivity_target))
    update = saved(update)
    enforce(key_violations(update, ["id"]), "update ids")
    enforce(update.select("id").join(development.select("id"), "id", "left_semi"), "update ids are in development")
    shared = [c for c in development.columns if c in update.columns]
    both = development.select(*shared).withColumn("parts", F.array(F.lit(0))).unionByName(
        update.select(*shared).withColumn("parts", F.array(F.lit(-1)))
    )
    outputs = []
    for model, blocks in models.items():
        width = sum(b.width for b in blocks)
        base = saved(assemble_blocks(both.select("id", "outcome", "parts"), tables, blocks))
        scalings = split_scalings(base.where("parts[0] = 0"), continuous_positions(blocks), width)
        fitted = fit_logistic_tasks(base, [FitTask(0, None, float(chosen[model]))], scalings, width, spec.options())
        scored = predict_tasks(base, fitted, scalings, ["id"], "outer").drop("outer")
        outputs.append(
            scored.withColumnRenamed("c", "selected_c").withColumns(
                {"model": F.lit(model), "convergence_warnings": F.lit(int(not fitted[0].converged))}
            )
        )
    result = join_on(join_on(reduce(DataFrame.unionByName, outputs), thresholds, ["model"]), update, ["id"])
    result = saved(result)
    if result.count() != update.count() * len(names):
        raise ContractError("update prediction coverage is incomplete")
    return result
