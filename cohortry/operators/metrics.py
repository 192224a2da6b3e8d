"""Metric aggregates grouped by any keys, with optional integer weights.

Rows are collapsed to one row per distinct score before anything is ordered, so a
score shared by a large part of the rows is summed map-side and costs one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions.scores import clipped_logit
from cohortry.operators.prefix import CELL, running_sums, score_splits, single_value_cells, with_score_cells
from cohortry.operators.skew import SALTS, hot_keys, is_small, join_on, salted_join, whole_row
from cohortry.session import cut_lineage

BUNDLE = [
    "auroc",
    "pr_auroc",
    "brier",
    "sensitivity",
    "specificity",
    "precision",
    "balanced_accuracy",
    "calibration_intercept",
    "calibration_slope",
]


def _ratio(top: Column, bottom: Column) -> Column:
    """NULL where the bottom is zero, also under ANSI mode."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def collapse_scores(
    df: DataFrame,
    keys: list[str],
    y: str,
    score: str,
    weight: str | None = None,
    splits: list[float] | None = None,
) -> DataFrame:
    """One row per keys and distinct score with integer ``pos`` and ``neg`` counts and its cell."""
    if splits is None:
        splits = score_splits(df, score)
    w = F.col(weight) if weight else F.lit(1)
    celled = with_score_cells(df.withColumn(score, F.col(score).cast("double") + F.lit(0.0)), score, splits)
    return celled.groupBy(*keys, CELL, score).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col(y) == 0, w).otherwise(0)).cast("bigint").alias("neg"),
    )


def auroc_of_counts(counts: DataFrame, keys: list[str], score: str) -> DataFrame:
    """AUROC per keys from ``pos`` and ``neg`` counts in rows of any finer grain."""
    celled = with_score_cells(counts, score, score_splits(counts, score))
    merged = celled.groupBy(*keys, CELL, score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return auroc_of_collapsed(merged, keys, score)


def auroc_of_collapsed(collapsed: DataFrame, keys: list[str], score: str) -> DataFrame:
    """AUROC per keys from collapsed counts: pairs ordered inside cells plus pairs across cells.

    Only per-cell sums cross cells, so no row-level join back is needed. Counts stay
    integers until the final products; one-class keys give NULL.
    """
    local = Window.partitionBy(*keys, CELL).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    per_cell = (
        collapsed.withColumn("neg_upto", F.sum("neg").over(local))
        .groupBy(*keys, CELL)
        .agg(
            F.sum(F.col("pos").cast("double") * (2 * F.col("neg_upto") - F.col("neg"))).alias("twice_area"),
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
        )
    )
    return auroc_of_cells(per_cell, keys)


def auroc_of_cells(per_cell: DataFrame, keys: list[str]) -> DataFrame:
    """AUROC per keys from one row per cell: ``twice_area`` inside it, ``pos`` and ``neg``."""
    cells = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    placed = per_cell.withColumn("neg_before", F.coalesce(F.sum("neg").over(cells), F.lit(0)))
    area = F.sum(F.col("twice_area") + 2.0 * F.col("pos") * F.col("neg_before"))
    return placed.groupBy(*keys).agg(
        _ratio(area, 2.0 * F.sum("pos") * F.sum("neg")).alias("auroc")
    )


def auroc(
    df: DataFrame,
    keys: list[str],
    y: str,
    score: str,
    weight: str | None = None,
    splits: list[float] | None = None,
) -> DataFrame:
    """Area under the ROC curve per keys; tied scores count one half."""
    return auroc_of_collapsed(collapse_scores(df, keys, y, score, weight, splits), keys, score)


def threshold_counts(collapsed: DataFrame, keys: list[str], score: str) -> DataFrame:
    """For each distinct score, counts at or above it: ``tp``, ``fp``, ``point`` and totals per keys."""
    return running_sums(
        collapsed,
        keys,
        [F.col(score).desc()],
        {"tp": F.col("pos"), "fp": F.col("neg"), "point": F.lit(1).cast("bigint")},
        descending=True,
        totals=True,
    )


def average_precision(
    df: DataFrame,
    keys: list[str],
    y: str,
    score: str,
    weight: str | None = None,
    splits: list[float] | None = None,
) -> DataFrame:
    """Sum over falling thresholds of recall gained times precision there."""
    counts = threshold_counts(collapse_scores(df, keys, y, score, weight, splits), keys, score)
    gained = F.col("pos") * _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    return counts.groupBy(*keys).agg(_ratio(F.sum(gained), F.max("tp_total")).alias("pr_auroc"))


def ranking_metrics(
    df: DataFrame, keys: list[str], y: str, score: str, splits: list[float] | None = None
) -> DataFrame:
    """AUROC and average precision from one ordered pass."""
    return _ranking(threshold_counts(collapse_scores(df, keys, y, score, None, splits), keys, score), keys)


def _ranking(counts: DataFrame, keys: list[str]) -> DataFrame:
    gained = F.col("pos") * _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    area = F.sum(F.col("neg").cast("double") * (2 * F.col("tp") - F.col("pos")))
    return counts.groupBy(*keys).agg(
        _ratio(area, 2.0 * F.max("tp_total") * F.max("fp_total")).alias("auroc"),
        _ratio(F.sum(gained), F.max("tp_total")).alias("pr_auroc"),
    )


def brier_expr(y: str, score: str) -> Column:
    return F.avg(F.pow(F.col(score) - F.col(y), F.lit(2)))


def confusion_exprs(y: str, predicted: Column) -> dict[str, Column]:
    """Rates from integer counts; precision is 0 when nothing is predicted positive."""
    tp = F.count_if(predicted & (F.col(y) == 1))
    fp = F.count_if(predicted & (F.col(y) == 0))
    fn = F.count_if(~predicted & (F.col(y) == 1))
    tn = F.count_if(~predicted & (F.col(y) == 0))
    return _rates(tp, fp, fn, tn)


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    sensitivity = _ratio(tp, tp + fn)
    specificity = _ratio(tn, tn + fp)
    return {
        "sensitivity": sensitivity,
        "specificity": specificity,
        "precision": F.coalesce(_ratio(tp, tp + fp), F.lit(0.0)),
        "balanced_accuracy": (sensitivity + specificity) / 2,
    }


def brier(df: DataFrame, keys: list[str], y: str, score: str) -> DataFrame:
    return df.groupBy(*keys).agg(brier_expr(y, score).alias("brier"))


def confusion_rates(df: DataFrame, keys: list[str], y: str, score: str, threshold: str) -> DataFrame:
    """Sensitivity, specificity, precision and balanced accuracy at each row's own threshold."""
    rates = confusion_exprs(y, F.col(score) >= F.col(threshold))
    return df.groupBy(*keys).agg(*[value.alias(name) for name, value in rates.items()])


def calibration_fit(df: DataFrame, keys: list[str], y: str, score: str, c: float = 1e6) -> DataFrame:
    """Intercept and slope of the outcome on the clipped logit, and whether the fit converged."""
    if not keys:
        return calibration_fit(df.withColumn("_all", F.lit(0)), ["_all"], y, score, c).drop("_all")
    counts = df.groupBy(*keys, score).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    return calibration_of_counts(counts, keys, score, c)


def calibration_of_counts(
    counts: DataFrame, keys: list[str], score: str, c: float = 1e6, most: int = 100, tolerance: float = 1e-9
) -> DataFrame:
    """The calibration line from outcome counts per score, with ``calibration_converged``.

    Newton steps on the loss with the slope's penalty slope^2 / (2c), from the identity line,
    where a sound model already is. A step that does not lower the loss is halved. A key is
    done when its step is below ``tolerance`` of its line; it then takes part no more. A pass
    is one grouped aggregate for all open keys, and one row per key moves between passes. A
    key that is not done after ``most`` passes, or has no finite optimum, gets NaN, which no
    later mean can hide.
    """
    base = cut_lineage(counts.select(
        *keys, F.col("pos").cast("double").alias("_y"), (F.col("pos") + F.col("neg")).cast("double").alias("_n"),
        clipped_logit(F.col(score)).alias("_x"),
    ))
    few = is_small(base.select(*keys).distinct())
    hot = [] if few else hot_keys(base, keys)
    carried = ["_a", "_b", "_loss", "_da", "_db", "_scale"]
    current, done = None, []
    for _ in range(most):
        if current is None:
            start = {"_a": 0.0, "_b": 1.0, "_loss": float("inf"), "_da": 0.0, "_db": 0.0, "_scale": 0.0}
            rows = base.withColumns({name: F.lit(value) for name, value in start.items()})
        else:
            rows = salted_join(base, F.broadcast(current) if few else current, keys, F.col("_x"), hot=hot)
        z = (F.col("_a") + F.col("_scale") * F.col("_da")) + (F.col("_b") + F.col("_scale") * F.col("_db")) * F.col("_x")
        rows = rows.withColumn("_z", z).withColumn("_p", 1.0 / (1.0 + F.exp(-F.col("_z")))).select(
            *keys, "_x", *carried,
            (F.col("_n") * (F.greatest(F.col("_z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z")))) - F.col("_y") * F.col("_z")).alias("_l"),
            (F.col("_n") * F.col("_p") - F.col("_y")).alias("_e"),
            (F.col("_n") * F.col("_p") * (1.0 - F.col("_p"))).alias("_v"),
        )
        sums = rows.groupBy(*keys).agg(
            *[F.first(name).alias(name) for name in carried],
            F.sum("_l").alias("_l"),
            F.sum("_e").alias("_g0"),
            F.sum(F.col("_e") * F.col("_x")).alias("_g1"),
            F.sum("_v").alias("_h00"),
            F.sum(F.col("_v") * F.col("_x")).alias("_h01"),
            F.sum(F.col("_v") * F.col("_x") * F.col("_x")).alias("_h11"),
        )
        tried = sums.withColumns({"_ta": F.col("_a") + F.col("_scale") * F.col("_da"), "_tb": F.col("_b") + F.col("_scale") * F.col("_db")})
        tried = tried.withColumns({
            "_l": F.col("_l") + F.col("_tb") * F.col("_tb") / (2 * c),
            "_g1": F.col("_g1") + F.col("_tb") / c,
            "_h11": F.col("_h11") + 1.0 / c,
        })
        det = F.nullif(F.col("_h00") * F.col("_h11") - F.col("_h01") * F.col("_h01"), F.lit(0.0))
        lower = F.col("_l") <= F.col("_loss") + 1e-12 * F.abs(F.col("_l"))
        step = {
            "_na": (F.col("_h01") * F.col("_g1") - F.col("_h11") * F.col("_g0")) / det,
            "_nb": (F.col("_h01") * F.col("_g0") - F.col("_h00") * F.col("_g1")) / det,
        }
        taken = tried.withColumns(step).select(
            *keys,
            F.when(lower, F.col("_ta")).otherwise(F.col("_a")).alias("_a"),
            F.when(lower, F.col("_tb")).otherwise(F.col("_b")).alias("_b"),
            F.when(lower, F.col("_l")).otherwise(F.col("_loss")).alias("_loss"),
            F.when(lower, F.col("_na")).otherwise(F.col("_da")).alias("_da"),
            F.when(lower, F.col("_nb")).otherwise(F.col("_db")).alias("_db"),
            F.when(lower, F.lit(1.0)).otherwise(F.col("_scale") / 2).alias("_scale"),
        )
        small = F.col("_scale") * (F.abs("_da") + F.abs("_db")) <= tolerance * (1 + F.abs("_a") + F.abs("_b"))
        state = F.when(F.col("_da").isNull() | F.col("_db").isNull(), "failed").when(small, "done").otherwise("open")
        passed = cut_lineage(taken.withColumn("_state", state))
        states = {r["_state"]: r["count"] for r in passed.groupBy("_state").count().collect()}
        if set(states) - {"open"}:
            done.append(passed.where("_state <> 'open'"))
        current = passed.where("_state = 'open'").drop("_state")
        if not states.get("open"):
            break
    else:
        done.append(current.withColumn("_state", F.lit("failed")))
    found = reduce(DataFrame.unionByName, [d.select(*keys, "_a", "_b", "_scale", "_da", "_db", "_state") for d in done]) if done else passed
    ended, nan = F.col("_state") == "done", F.lit(float("nan"))
    return found.select(
        *keys,
        F.when(ended, F.col("_a") + F.col("_scale") * F.col("_da")).otherwise(nan).alias("calibration_intercept"),
        F.when(ended, F.col("_b") + F.col("_scale") * F.col("_db")).otherwise(nan).alias("calibration_slope"),
        ended.alias("calibration_converged"),
    )


def evaluate(df: DataFrame, keys: list[str], y: str, score: str, threshold: str) -> DataFrame:
    """All nine metrics per keys.

    The rows are read once, into a narrow table of outcome counts per (keys, score,
    threshold) that every metric then starts from.
    """
    if not keys:
        return evaluate(df.withColumn("_all", F.lit(0)), ["_all"], y, score, threshold).drop("_all")
    rows = df.withColumn(score, F.col(score).cast("double") + F.lit(0.0))
    counts = cut_lineage(
        rows.groupBy(*keys, score, threshold).agg(
            F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
        )
    )
    per_score = counts.groupBy(*keys, score).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    celled = with_score_cells(per_score, score, score_splits(counts, score))
    ranked = _ranking(threshold_counts(celled, keys, score), keys)
    called = F.col(score) >= F.col(threshold)
    tp, fp = (F.sum(F.when(called, F.col(n)).otherwise(0)) for n in ("pos", "neg"))
    fn, tn = (F.sum(F.when(called, 0).otherwise(F.col(n))) for n in ("pos", "neg"))
    squared = F.sum(
        F.col("pos") * F.pow(F.col(score) - 1.0, F.lit(2)) + F.col("neg") * F.pow(F.col(score), F.lit(2))
    )
    plain = counts.groupBy(*keys).agg(
        (squared / F.sum(F.col("pos") + F.col("neg"))).alias("brier"),
        *[value.alias(name) for name, value in _rates(tp, fp, fn, tn).items()],
    )
    calibrated = calibration_of_counts(per_score, keys, score)
    return join_on(join_on(ranked, plain, keys), calibrated, keys).select(*keys, *BUNDLE)


def average_rank(df: DataFrame, keys: list[str], value: str, splits: list[float] | None = None) -> DataFrame:
    """Add the mean rank of each value within keys, ties sharing it.

    NULL ranks after all numbers and NaN after NULL, each as one tie. Rows cross the network
    once: a table with a row per key and cell says how many rows lie before a cell, and rows
    are ordered inside it only. In a cell of one value every row has the same rank, which that
    table gives, so such a cell is spread over many tasks however large it is.
    """
    if splits is None:
        splits = score_splits(df, value)
    last, number = len(splits) + 1, F.col(value).cast("double")
    cell = F.when(number.isNull(), last).when(F.isnan(number), last + 1).otherwise(F.col(CELL))
    celled = with_score_cells(df, value, splits).withColumn(CELL, cell)
    sizes = celled.groupBy(*keys, CELL).agg(F.count(F.lit(1)).alias("_own"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(sizes.withColumn("_before", F.coalesce(F.sum("_own").over(earlier), F.lit(0))))
    on = [*keys, CELL]
    placed = join_on(celled, F.broadcast(offsets), on) if is_small(offsets) else salted_join(celled, offsets, on, whole_row(celled))
    tied = F.col(CELL).isin([*single_value_cells(splits), last, last + 1])
    spread = placed.withColumn("_salt", F.when(tied, F.monotonically_increasing_id() % SALTS).otherwise(0))
    inside = Window.partitionBy(*on, "_salt").orderBy(value)
    within = F.rank().over(inside) + F.count(F.lit(1)).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.col("_before") + F.when(tied, F.col("_own") + 1).otherwise(within) / F.lit(2.0)
    return spread.withColumn("average_rank", rank).drop(CELL, "_own", "_before", "_salt")


def roc_curve(
    df: DataFrame, keys: list[str], y: str, score: str, splits: list[float] | None = None
) -> DataFrame:
    """One point per distinct threshold, falling, after the start (0, 0) at +infinity.

    ``point`` numbers the points from 0. Collinear points are kept.
    """
    return roc_points(threshold_counts(collapse_scores(df, keys, y, score, None, splits), keys, score), keys, score)


def roc_points(counts: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The ROC curve from ``threshold_counts``."""
    here = F.struct(
        F.col("point"),
        F.col(score).alias("threshold"),
        _ratio(F.col("fp"), F.col("fp_total")).alias("fpr"),
        _ratio(F.col("tp"), F.col("tp_total")).alias("tpr"),
    )
    start = F.struct(
        F.lit(0).cast("bigint").alias("point"),
        F.lit(float("inf")).alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    # the row of the highest score carries the start point with it
    return counts.select(
        *keys, F.inline(F.when(F.col("point") == 1, F.array(start, here)).otherwise(F.array(here)))
    )


def pr_curve(
    df: DataFrame, keys: list[str], y: str, score: str, splits: list[float] | None = None
) -> DataFrame:
    """One point per distinct threshold, rising, then the end point (precision 1, recall 0)."""
    return pr_points(threshold_counts(collapse_scores(df, keys, y, score, None, splits), keys, score), keys, score)


def pr_points(counts: DataFrame, keys: list[str], score: str) -> DataFrame:
    """The precision-recall curve from ``threshold_counts``."""
    here = F.struct(
        (F.col("point_total") - F.col("point")).alias("point"),
        F.col(score).alias("threshold"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _ratio(F.col("tp"), F.col("tp_total")).alias("recall"),
    )
    end = F.struct(
        F.col("point_total").alias("point"),
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return counts.select(
        *keys, F.inline(F.when(F.col("point") == 1, F.array(end, here)).otherwise(F.array(here)))
    )


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    steps: list[float],
    weight: str | None = None,
    splits: list[float] | None = None,
) -> DataFrame:
    """Quantiles with linear interpolation per keys: one row per keys and ``step``.

    Unlike the built-in exact percentile, which holds every distinct value of a key in
    one buffer, this reads the values off distributed running counts. NULLs are left out.
    """
    present = df.where(F.col(value).isNotNull())
    if splits is None:
        splits = score_splits(present, value)
    w = F.col(weight) if weight else F.lit(1)
    counted = (
        with_score_cells(present.withColumn(value, F.col(value).cast("double") + F.lit(0.0)), value, splits)
        .groupBy(*keys, CELL, value)
        .agg(F.sum(w).cast("bigint").alias("_n"))
    )
    upto = running_sums(counted, keys, [F.col(value)], {"_upto": F.col("_n")}, totals=True)
    place = lambda step: (F.col("_upto_total") - 1) * step
    first = F.col("_upto") - F.col("_n")
    holds = lambda index: (index >= first) & (index < F.col("_upto"))
    wanted = F.filter(
        F.array(*[F.lit(float(step)) for step in steps]),
        lambda step: holds(F.floor(place(step))) | holds(F.ceil(place(step))),
    )
    hits = upto.withColumn("step", F.explode(wanted))
    share = place(F.col("step")) - F.floor(place(F.col("step")))
    low = F.max(F.when(holds(F.floor(place(F.col("step")))), F.col(value)))
    high = F.max(F.when(holds(F.ceil(place(F.col("step")))), F.col(value)))
    return (
        hits.groupBy(*keys, "step")
        .agg(low.alias("_low"), high.alias("_high"), F.max(share).alias("_share"))
        .select(*keys, "step", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias("quantile"))
    )


def calibration_bins(df: DataFrame, keys: list[str], y: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and observed rate in quantile bins; a bin is the number of inner edges below.

    Edges interpolate linearly between scores. Empty bins give no row; ``bin`` numbers those that remain.
    """
    if not keys:
        return calibration_bins(df.withColumn("_all", F.lit(0)), ["_all"], y, score, bins).drop("_all")
    counts = df.groupBy(*keys, score).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    return bins_of_counts(cut_lineage(counts), keys, score, bins)


def bins_of_counts(counts: DataFrame, keys: list[str], score: str, bins: int = 10) -> DataFrame:
    """The calibration bins from ``pos`` and ``neg`` counts per keys and score."""
    counted = counts.select(*keys, score, (F.col("pos") + F.col("neg")).alias("_n"), F.col("pos").alias("_pos"))
    steps = [i / bins for i in range(1, bins)]
    edges = (
        exact_quantiles(counted, keys, score, steps, "_n")
        .groupBy(*keys)
        .agg(F.collect_list("quantile").alias("_edges"))
    )
    edges = cut_lineage(edges)
    if is_small(edges):
        joined = join_on(counted, F.broadcast(edges), keys)
    else:
        joined = salted_join(counted, edges, keys, F.col(score))
    binned = joined.withColumn("_bin", F.size(F.filter("_edges", lambda edge: edge < F.col(score))))
    filled = binned.groupBy(*keys, "_bin").agg(
        (F.sum(F.col(score) * F.col("_n")) / F.sum("_n")).alias("mean_predicted"),
        (F.sum("_pos") / F.sum("_n")).alias("observed_fraction"),
        F.sum("_n").alias("rows"),
    )
    order = Window.partitionBy(*keys).orderBy("_bin")
    return filled.withColumn("bin", F.row_number().over(order) - 1).drop("_bin")


def operating_thresholds(
    df: DataFrame, keys: list[str], y: str, score: str, target: float = 0.8, splits: list[float] | None = None
) -> DataFrame:
    """Per keys: the first maximum of TPR - FPR, and the least FPR that reaches the target TPR.

    Both run along falling thresholds from +infinity, so ties go to the higher one.
    A key where no point reaches the target gets 0.0.
    """
    return thresholds_of_collapsed(collapse_scores(df, keys, y, score, None, splits), keys, score, target)


def thresholds_of_collapsed(collapsed: DataFrame, keys: list[str], score: str, target: float = 0.8) -> DataFrame:
    """``operating_thresholds`` from one row of counts per keys and score, with its cell."""
    curve = roc_points(threshold_counts(collapsed, keys, score), keys, score)
    gain = F.col("tpr") - F.col("fpr")
    reached = F.when(F.col("tpr") >= target, F.struct(-F.col("fpr"), F.col("threshold")))
    return curve.groupBy(*keys).agg(
        F.max_by("threshold", F.struct(gain, F.col("threshold"))).alias("youden_threshold"),
        F.coalesce(F.max_by("threshold", reached), F.lit(0.0)).alias("sensitivity_threshold"),
    )
