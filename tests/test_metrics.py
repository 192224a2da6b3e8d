import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions.scores import interval_verdict
from cohortry.operators import metrics
from cohortry.operators.ordering import assert_order_invariant
from cohortry.operators.prefix import numbered, score_splits, single_value_cells, with_score_cells


def brute_auroc(y, p):
    pos, neg = [a for a, b in zip(p, y) if b], [a for a, b in zip(p, y) if not b]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return wins / (len(pos) * len(neg)) if pos and neg else None


def scored(spark, n=400, levels=40, hot=0.34, seed=3):
    """Rows of two keys where one score holds a third of everything."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        p = 0.5 if rng.random() < hot else rng.randrange(levels) / levels
        rows.append((i, "ab"[i % 2], int(rng.random() < 0.3 + 0.4 * p), p, 0.4 + 0.1 * (i % 3), 1 + i % 3))
    return rows, spark.createDataFrame(rows, "id int, k string, y int, p double, t double, w int")


def test_auroc_matches_pair_counting(spark):
    rows, df = scored(spark)
    got = {r["k"]: r["auroc"] for r in metrics.auroc(df, ["k"], "y", "p").collect()}
    for k in "ab":
        part = [r for r in rows if r[1] == k]
        assert got[k] == pytest.approx(brute_auroc([r[2] for r in part], [r[3] for r in part]), abs=1e-12)


def test_weighted_auroc_equals_repeated_rows(spark):
    rows, df = scored(spark)
    got = metrics.auroc(df, [], "y", "p", weight="w").first()["auroc"]
    y = [r[2] for r in rows for _ in range(r[5])]
    p = [r[3] for r in rows for _ in range(r[5])]
    assert got == pytest.approx(brute_auroc(y, p), abs=1e-12)


def test_ties_one_class_and_empty(spark):
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5)], "y int, p double")
    assert metrics.auroc(tied, [], "y", "p").first()["auroc"] == 0.5
    single = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, p double")
    assert metrics.auroc(single, [], "y", "p").first()["auroc"] is None
    assert metrics.auroc(single.limit(0).withColumn("k", F.lit(1)), ["k"], "y", "p").count() == 0


def test_borders_never_change_the_result(spark):
    _, df = scored(spark)
    results = [
        metrics.auroc(df, ["k"], "y", "p", splits=s).orderBy("k").collect() for s in ([], [0.5], [0.1, 0.2, 0.9, 2.0])
    ]
    assert results[0] == results[1] == results[2]


def test_heavy_score_gets_its_own_cell(spark):
    _, df = scored(spark)
    splits = score_splits(df, "p", 16)
    alone = single_value_cells(splits)
    assert alone
    held = with_score_cells(df, "p", splits).where(F.col("_cell").isin(alone)).groupBy("_cell").agg(F.count_distinct("p").alias("n"))
    assert {r["n"] for r in held.collect()} == {1}


def test_zero_signs_share_a_cell(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "p double")
    cells = with_score_cells(df, "p", [0.0, 0.5]).collect()
    assert cells[0]["_cell"] == cells[1]["_cell"]


def test_average_precision_and_curves(spark):
    rows, df = scored(spark)
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    total, last, expected = y.sum(), 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        recall = y[p >= t].sum() / total
        expected += (recall - last) * y[p >= t].mean()
        last = recall
    assert metrics.average_precision(df, [], "y", "p").first()["pr_auroc"] == pytest.approx(expected, abs=1e-12)
    roc = metrics.roc_curve(df, [], "y", "p").orderBy("point").collect()
    assert (roc[0]["fpr"], roc[0]["tpr"], roc[0]["threshold"]) == (0.0, 0.0, math.inf)
    assert (roc[-1]["fpr"], roc[-1]["tpr"]) == (1.0, 1.0)
    assert [r["point"] for r in roc] == list(range(len(set(p)) + 1))
    pr = metrics.pr_curve(df, [], "y", "p").orderBy("point").collect()
    assert (pr[-1]["precision"], pr[-1]["recall"], pr[-1]["threshold"]) == (1.0, 0.0, None)
    assert pr[0]["recall"] == 1.0 and len(pr) == len(set(p)) + 1


def test_thresholds(spark):
    rows, df = scored(spark)
    y, p = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    points = [(math.inf, 0.0, 0.0)] + [
        (t, y[p >= t].sum() / y.sum(), (1 - y[p >= t]).sum() / (1 - y).sum()) for t in sorted(set(p), reverse=True)
    ]
    best = max(range(len(points)), key=lambda i: (round(points[i][1] - points[i][2], 12), -i))
    reach = min((q for q in points if q[1] >= 0.8), key=lambda q: q[2])
    got = metrics.operating_thresholds(df, [], "y", "p", 0.8).first()
    assert got["youden_threshold"] == points[best][0]
    assert got["sensitivity_threshold"] == reach[0]


def test_useless_score_keeps_the_infinite_threshold(spark):
    df = spark.createDataFrame([(0, 0.9), (1, 0.1)], "y int, p double")
    assert metrics.operating_thresholds(df, [], "y", "p").first()["youden_threshold"] == math.inf


def test_calibration_matches_direct_newton(spark):
    rows, df = scored(spark, n=600, levels=200, hot=0.0)
    y = np.array([r[2] for r in rows], float)
    q = np.clip(np.array([r[3] for r in rows]), 1e-6, 1 - 1e-6)
    x = np.column_stack([np.ones(len(q)), np.log(q / (1 - q))])
    b, penalty = np.zeros(2), np.diag([0.0, 1e-6])
    for _ in range(50):
        f = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve(x.T @ (x * (f * (1 - f))[:, None]) + penalty, x.T @ (f - y) + penalty @ b)
    got = metrics.calibration_fit(df, [], "y", "p").first()
    assert got["calibration_intercept"] == pytest.approx(b[0], abs=1e-6)
    assert got["calibration_slope"] == pytest.approx(b[1], abs=1e-6)


def direct_line(rows, c=1e6):
    """The penalised optimum by damped Newton steps on all rows."""
    y = np.array([r[0] for r in rows], float)
    q = np.clip(np.array([r[1] for r in rows], float), 1e-6, 1 - 1e-6)
    x = np.column_stack([np.ones(len(q)), np.log(q / (1 - q))])
    penalty = np.diag([0.0, 1 / c])
    loss = lambda b: (np.logaddexp(0, x @ b) - y * (x @ b)).sum() + b @ penalty @ b / 2
    b = np.array([0.0, 1.0])
    for _ in range(2000):
        f = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve(x.T @ (x * (f * (1 - f))[:, None]) + penalty, x.T @ (f - y) + penalty @ b)
        scale = 1.0
        while loss(b - scale * step) > loss(b) + 1e-12 and scale > 1e-9:
            scale /= 2
        b = b - scale * step
    return b


@pytest.mark.parametrize("case", ["far out", "at the ends", "separable", "steep"])
def test_calibration_of_extreme_scores(spark, case):
    rng = np.random.default_rng(5)
    if case in ("far out", "at the ends"):
        edge = 1e-5 if case == "far out" else 0.0
        rows = [(int(u ^ (i % 10 < 3)), 1 - edge if u else edge) for i, u in enumerate(rng.random(400) < 0.4)]
    elif case == "separable":
        rows = [(int(p > 0.5), float(p)) for p in rng.random(200)]
    else:
        rows = [(int(rng.random() < 1 / (1 + np.exp(-8 * np.log(p / (1 - p))))), float(p)) for p in rng.random(300)]
    got = metrics.calibration_fit(spark.createDataFrame(rows, "y int, p double"), [], "y", "p").first()
    a, b = direct_line(rows)
    assert got["calibration_converged"]
    assert got["calibration_intercept"] == pytest.approx(a, rel=1e-5, abs=1e-6)
    assert got["calibration_slope"] == pytest.approx(b, rel=1e-5, abs=1e-6)


def test_calibration_without_an_optimum_is_reported(spark):
    df = spark.createDataFrame([("one", 1, 0.3), ("one", 1, 0.6), ("both", 1, 0.7), ("both", 0, 0.6), ("both", 1, 0.4)], "k string, y int, p double")
    got = {r["k"]: r for r in metrics.calibration_fit(df, ["k"], "y", "p").collect()}
    assert not got["one"]["calibration_converged"] and math.isnan(got["one"]["calibration_slope"])
    assert got["both"]["calibration_converged"] and math.isfinite(got["both"]["calibration_slope"])


def test_bundle_agrees_with_single_metrics(spark):
    _, df = scored(spark)
    bundle = {r["k"]: r for r in metrics.evaluate(df, ["k"], "y", "p", "t").collect()}
    parts = [
        metrics.auroc(df, ["k"], "y", "p"), metrics.average_precision(df, ["k"], "y", "p"), metrics.brier(df, ["k"], "y", "p"),
        metrics.confusion_rates(df, ["k"], "y", "p", "t"), metrics.calibration_fit(df, ["k"], "y", "p").drop("calibration_converged"),
    ]
    for part in parts:
        for row in part.drop("calibration_converged").collect():
            for name in part.columns[1:]:
                assert bundle[row["k"]][name] == pytest.approx(row[name], abs=1e-9)


def test_exact_quantiles_match_numpy(spark):
    rows, df = scored(spark)
    got = {r["step"]: r["quantile"] for r in metrics.exact_quantiles(df, [], "p", [0.0, 0.025, 0.5, 0.975, 1.0]).collect()}
    for step, value in got.items():
        assert value == pytest.approx(np.quantile([r[3] for r in rows], step), abs=1e-12)


def test_row_numbers_are_total(spark):
    _, df = scored(spark)
    celled = with_score_cells(df, "p", score_splits(df, "p", 8))
    got = [r["row_no"] for r in numbered(celled, [], [F.col("p"), F.col("id")]).orderBy("p", "id").collect()]
    assert got == list(range(1, df.count() + 1))


def test_metrics_do_not_depend_on_input_order(spark):
    _, df = scored(spark)
    assert_order_invariant(lambda d: metrics.auroc(d, ["k"], "y", "p"), df)
    assert_order_invariant(lambda d: metrics.roc_curve(d, ["k"], "y", "p"), df)
    assert_order_invariant(lambda d: metrics.calibration_bins(d, ["k"], "y", "p").drop("mean_predicted"), df)


@pytest.mark.parametrize(
    "lower, upper, region",
    [
        (0.04, 0.08, "meaningful_gain"), (0.01, 0.05, "some_gain"), (-0.01, 0.05, "inconclusive"),
        (-0.05, -0.01, "worse"), (0.0, 0.02, "small_gain"), (-0.01, 0.02, "important_gain_excluded_without_superiority"),
    ],
)
def test_interval_regions(spark, lower, upper, region):
    df = spark.createDataFrame([(lower, upper)], "l double, u double")
    assert df.select(interval_verdict(F.col("l"), F.col("u"), 0.03)).first()[0] == region


def test_average_rank_matches_counting(spark):
    """Ties, a value held by a third of the rows, NULL and NaN, with borders on and between values."""
    rng = np.random.default_rng(5)
    values = [float(v) for v in rng.integers(0, 40, 400)] + [7.5] * 200 + [None] * 5 + [float("nan")] * 4
    rows = [(k, i, v) for k in ("a", "b", None) for i, v in enumerate(values[: 500 if k == "a" else None])]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(5)
    order = lambda v: (2, 0.0) if v is None else (3, 0.0) if v != v else (1, v)
    expected = {}
    for key in ("a", "b", None):
        own = [(i, order(v)) for k, i, v in rows if k == key]
        ranks = {x: sum(y < x for _, y in own) + (sum(y == x for _, y in own) + 1) / 2 for x in {x for _, x in own}}
        expected |= {(key, i): ranks[x] for i, x in own}
    for splits in (None, [], [7.5, np.nextafter(7.5, np.inf)], [3.0, 7.5, np.nextafter(7.5, np.inf), 20.2]):
        got = metrics.average_rank(df, ["k"], "v", splits)
        assert got.columns == ["k", "i", "v", "average_rank"]
        assert {(r["k"], r["i"]): r["average_rank"] for r in got.collect()} == expected
    assert metrics.average_rank(df.where("false"), ["k"], "v").count() == 0
