"""Metrics, curves, intervals and verdicts over the prediction view."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from cohortry import views
from cohortry.functions.scores import clipped_logit, interval_verdict, threshold_flag, verdict_wording
from cohortry.functions.scores import VERDICTS
from cohortry.operators import metrics, resample
from cohortry.plans import estimate

KEYS = ["model", "repeat"]
# Resamples of some queries that SQL checks, and of those that draw their whole number.
R, WHOLE = 20, 2000
SEED = 120900
Y, P = "outcome", "probability"


def rounded(df, places=6):
    """Round floating columns so that summation order cannot show."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, places).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def off_tie(value):
    """Means of the view's scores can end in an exact half of the last kept digit; move them off it."""
    return value + 1e-9


RANKED = views.PREDICTIONS + """, ranked as (
  select *, rank() over (partition by model, repeat order by probability)
    + (count(*) over (partition by model, repeat, probability) - 1) / 2.0 as rk
  from predictions)"""

AUROC_SQL = RANKED + """, aurocs as (
  select model, repeat, (sum(rk) filter (outcome = 1) - count_if(outcome = 1) * (count_if(outcome = 1) + 1) / 2.0)
    / (count_if(outcome = 1)::double * count_if(outcome = 0)) as auroc
  from ranked group by model, repeat)"""

STEPS_SQL = views.PREDICTIONS + """, distinct_scores as (
  select model, repeat, probability, count_if(outcome = 1) as pos, count_if(outcome = 0) as neg
  from predictions group by all),
steps as (
  select *, sum(pos) over w as tp, sum(neg) over w as fp, row_number() over w as point,
    sum(pos) over k as n1, sum(neg) over k as n0, count(*) over k as points
  from distinct_scores
  window w as (partition by model, repeat order by probability desc), k as (partition by model, repeat))"""

ROC_SQL = STEPS_SQL + """, roc as (
  select model, repeat, point::bigint as point, probability as threshold, fp / n0::double as fpr, tp / n1::double as tpr from steps
  union all
  select distinct model, repeat, 0::bigint, 'infinity'::double, 0.0::double, 0.0::double from steps)"""

RATES_SQL = """
  select model, repeat, avg(power(probability - outcome, 2)) as brier,
    tp / (tp + fn)::double as sensitivity, tn / (tn + fp)::double as specificity,
    coalesce(tp / nullif(tp + fp, 0)::double, 0.0) as precision,
    (tp / (tp + fn)::double + tn / (tn + fp)::double) / 2 as balanced_accuracy
  from (select *,
      count_if(outcome = 1 and probability >= youden_threshold) over k as tp,
      count_if(outcome = 0 and probability >= youden_threshold) over k as fp,
      count_if(outcome = 1 and probability < youden_threshold) over k as fn,
      count_if(outcome = 0 and probability < youden_threshold) over k as tn
    from predictions window k as (partition by model, repeat))
  group by model, repeat, tp, fp, fn, tn"""

AP_SQL = """
  select model, repeat, sum(pos * (tp / (tp + fp)::double)) / max(n1) as pr_auroc from steps group by model, repeat"""

SEVEN = STEPS_SQL + """, ranked as (
  select *, rank() over (partition by model, repeat order by probability)
    + (count(*) over (partition by model, repeat, probability) - 1) / 2.0 as rk
  from predictions), aurocs as (
  select model, repeat, (sum(rk) filter (outcome = 1) - count_if(outcome = 1) * (count_if(outcome = 1) + 1) / 2.0)
    / (count_if(outcome = 1)::double * count_if(outcome = 0)) as auroc
  from ranked group by model, repeat), aps as (""" + AP_SQL + "), rates as (" + RATES_SQL + ")"


NEWTON = 20


def newton_sql(steps: int = NEWTON) -> str:
    """CTEs ``n0`` .. ``n<steps>`` that walk to the calibration line of the prediction view.

    Plain Newton steps; the view's scores need about six to stand still.
    """
    ctes = [
        """base as materialized (select model, repeat, outcome::double as y, ln(q / (1 - q)) as x from (
    select *, greatest(least(probability, 1 - 1e-6), 1e-6) as q from predictions))""",
        "n0 as (select distinct model, repeat, 0.0::double as a, 1.0::double as b from predictions)",
    ]
    for i in range(steps):
        ctes.append(f"""n{i + 1} as (
  select model, repeat, a - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as a,
    b - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as b
  from (select model, repeat, a, b, sum(p - y) as g0, sum((p - y) * x) + b / 1e6 as g1, sum(p * (1 - p)) as h00,
      sum(p * (1 - p) * x) as h01, sum(p * (1 - p) * x * x) + 1e-6 as h11
    from (select *, 1 / (1 + exp(-(a + b * x))) as p from base join n{i} using (model, repeat))
    group by model, repeat, a, b))""")
    return ", ".join(ctes)


NINE = SEVEN + ", " + newton_sql() + """,
bundle as (select aurocs.*, pr_auroc, brier, sensitivity, specificity, precision, balanced_accuracy,
    a as calibration_intercept, b as calibration_slope
  from aurocs join aps using (model, repeat) join rates using (model, repeat) join """ + f"n{NEWTON}" + """ using (model, repeat)),
long as (unpivot bundle on auroc, pr_auroc, brier, sensitivity, specificity, precision, balanced_accuracy,
  calibration_intercept, calibration_slope into name metric value value)"""


def draws_sql(source: str, repeats: bool, seed: int, resamples: int) -> str:
    """CTEs from a prediction CTE to one delta per resample."""
    keys = "resample, model" + (", repeat" if repeats else "")
    sides = "resample" + (", repeat" if repeats else "")
    return f""", numbered as (
  select group_id, row_number() over (order by {views.h(str(seed), 'group_id')}, group_id) - 1 as group_no
  from (select distinct group_id from {source})),
times as (
  select resample, n.group_id, t.times from (
    select resample, {views.h(str(seed), 'resample', 'g.group_no')} % (select count(*) from numbered) as group_no,
      count(*) as times
    from range({resamples}) r(resample) cross join numbered g group by all) t
  join numbered n using (group_no)),
weighted as (
  select {keys}, probability, sum(times) filter (outcome = 1) as pos, sum(times) filter (outcome = 0) as neg
  from {source} join times using (group_id) group by all),
cumulated as (
  select {keys}, coalesce(pos, 0) as pos, coalesce(neg, 0) as neg,
    sum(coalesce(neg, 0)) over (partition by {keys} order by probability) as upto
  from weighted),
boot_auroc as (
  select {keys}, sum(pos::double * (2 * upto - neg)) / nullif(2.0 * sum(pos) * sum(neg), 0) as auroc
  from cumulated group by {keys}),
sided as (
  select {sides}, max(auroc) filter (model = 'D') - max(auroc) filter (model = 'B') as delta
  from boot_auroc group by {sides}),
draws as (select resample, avg(delta) as delta from sided where delta is not null group by resample)"""


BOOT_SQL = views.PREDICTIONS + draws_sql("predictions", True, SEED, R)
WHOLE_BOOT_SQL = views.PREDICTIONS + draws_sql("predictions", True, SEED, WHOLE)
INTERVAL = """select quantile_cont(delta, 0.025) as ci_lower, quantile_cont(delta, 0.975) as ci_upper,
  count(delta) as successful from draws"""


def verdict_sql(lower: str, upper: str, gain: float) -> str:
    return f"""case when {lower} > {gain} then 'meaningful_gain' when {lower} > 0 and {upper} >= {gain} then 'some_gain'
    when {lower} <= 0 and {upper} >= {gain} then 'inconclusive' when {upper} < 0 then 'worse'
    when {lower} >= 0 and {upper} < {gain} then 'small_gain'
    when {upper} < {gain} then 'important_gain_excluded_without_superiority' end"""


def wording_sql(region: str) -> str:
    return "case " + region + " " + " ".join(f"when '{k}' then '{v}'" for k, v in VERDICTS.items()) + " end"


def x1(spark, d):
    return rounded(metrics.auroc(views.predictions(spark, d), KEYS, Y, P))


def x2(spark, d):
    return rounded(metrics.average_precision(views.predictions(spark, d), KEYS, Y, P))


def x3(spark, d):
    return rounded(metrics.brier(views.predictions(spark, d), KEYS, Y, P))


def x4(spark, d):
    return rounded(metrics.confusion_rates(views.predictions(spark, d), KEYS, Y, P, "youden_threshold"))


def x5(spark, d):
    return rounded(metrics.calibration_fit(views.predictions(spark, d), KEYS, Y, P))


def x5_extreme(spark: SparkSession, d: str) -> DataFrame:
    """Scores so far out that plain Newton steps from the identity line run away; two scores have a line in closed form."""
    extreme = views.predictions(spark, d).withColumn("probability", F.when(F.col(P) >= 0.5, 1 - 1e-5).otherwise(1e-5))
    line = metrics.calibration_fit(extreme, ["model"], Y, P)
    return line.withColumns({c: F.round(c, 5) for c in ("calibration_intercept", "calibration_slope")})


def x6(spark, d):
    return rounded(metrics.evaluate(views.predictions(spark, d), KEYS, Y, P, "youden_threshold"))


def w1(spark, d):
    return metrics.average_rank(views.predictions(spark, d).select(*KEYS, "id", P), KEYS, P)


def w2(spark, d):
    return rounded(metrics.roc_curve(views.predictions(spark, d), KEYS, Y, P))


def w3(spark, d):
    return rounded(metrics.pr_curve(views.predictions(spark, d), KEYS, Y, P))


def w4(spark, d):
    bins = metrics.calibration_bins(views.predictions(spark, d), KEYS, Y, P)
    return rounded(bins.withColumn("mean_predicted", off_tie(F.col("mean_predicted"))))


def w5(spark, d):
    return rounded(metrics.operating_thresholds(views.predictions(spark, d), KEYS, Y, P, 0.8))


def quantile_edges(spark, d):
    return rounded(metrics.exact_quantiles(views.predictions(spark, d), KEYS, P, [0.025, 0.25, 0.5, 0.975]))


def p16(spark, d):
    return rounded(
        views.predictions(spark, d).select("id", *KEYS, clipped_logit(F.col(P) * 1.3 - 0.1).alias("logit"))
    )


def p17(spark, d):
    return views.predictions(spark, d).select(
        "id", *KEYS, threshold_flag(F.col(P), F.col("youden_threshold")).alias("predicted")
    )


def repeat_metrics(spark, d):
    """All nine metrics per model and repeat."""
    return estimate.repeat_metrics(views.predictions(spark, d))


def e1(spark, d):
    return rounded(estimate.model_performance(repeat_metrics(spark, d)))


def a5(spark, d):
    return rounded(estimate.repeat_uncertainty(repeat_metrics(spark, d)))


def a6(spark, d):
    scored = metrics.auroc(views.predictions(spark, d), KEYS, Y, P)
    return rounded(estimate.paired_by_repeat(scored))


def e2(spark, d):
    scored = metrics.auroc(views.predictions(spark, d), KEYS, Y, P)
    one = estimate.paired_delta(estimate.paired_by_repeat(scored))
    return rounded(one.select("delta", F.posexplode("repeat_deltas").alias("repeat", "repeat_delta")))


def boot(spark, d, resamples=R):
    return resample.cluster_bootstrap(views.predictions(spark, d), "group_id", "model", Y, P, resamples, SEED)


def e3(spark, d, resamples=WHOLE):
    return rounded(boot(spark, d, resamples))


def single(spark, d):
    return views.predictions(spark, d).where("repeat = 0 and release = 'added'")


def e4(spark, d, resamples=R):
    return rounded(
        resample.cluster_bootstrap(single(spark, d), "group_id", "model", Y, P, resamples, SEED + 1, repeat=None)
    )


def a7(spark, d, resamples=R):
    return rounded(resample.percentile_interval(boot(spark, d, resamples), []))


def j13(spark, d, resamples=R):
    return resample.group_draws(views.cohort(spark, d), "group_id", resamples, SEED)


def e5(spark, d):
    # an interval per part, spread around zero
    part = views.table(spark, d, "part")
    low = (F.col("p_partkey") % 23 - 14) / F.lit(200.0)
    rows = part.select("p_partkey", low.alias("lo"), (low + F.col("p_size") / F.lit(500.0)).alias("hi"))
    region = interval_verdict(F.col("lo"), F.col("hi"), 0.03)
    return rows.select("p_partkey", region.alias("region"), verdict_wording(region).alias("interpretation"))


def a14(spark, d):
    part = views.table(spark, d, "part")
    low = (F.col("p_partkey") % 23 - 14) / F.lit(200.0)
    rows = part.select(
        "p_brand", low.alias("lo"), (low + F.col("p_size") / F.lit(500.0)).alias("hi"), F.lit(0.03).alias("truth")
    )
    return rounded(resample.interval_diagnostics(rows, ["p_brand"], "lo", "hi", "truth"))


def a14_shift(spark, d):
    events = views.table(spark, d, "events").select(
        "event_type", F.col("user_id").alias("resample"), F.col("value").alias("delta")
    )
    return rounded(resample.endpoint_shift(events, ["event_type"], 20))


def estimate_row(spark, d, resamples=WHOLE):
    return rounded(estimate.estimate(views.predictions(spark, d), resamples, SEED))


def whole(query):
    """The query with all resamples."""
    return partial(query, resamples=WHOLE)


ROUNDED = ", ".join(f"round({m}, 6) as {m}" for m in metrics.BUNDLE)
MEANS = ", ".join(f"round(avg({m}), 6) as {m}" for m in metrics.BUNDLE)

#: What follows the ``predictions`` and ``draws`` CTEs: the one row of an estimate.
VERDICT_SQL = (
    f", i as ({INTERVAL}), p as (select avg(delta) as delta_auroc from ("
    "select repeat, max(auroc) filter (model = 'D') - max(auroc) filter (model = 'B') as delta from ("
    "select model, repeat, (sum(rk) filter (outcome = 1) - count_if(outcome = 1) * (count_if(outcome = 1) + 1) / 2.0) "
    "/ (count_if(outcome = 1)::double * count_if(outcome = 0)) as auroc from ("
    "select *, rank() over (partition by model, repeat order by probability) + "
    "(count(*) over (partition by model, repeat, probability) - 1) / 2.0 as rk from predictions) "
    "group by model, repeat) group by repeat)), v as (select *, "
    + verdict_sql("ci_lower", "ci_upper", 0.03) + " as region from p cross join i) "
    "select round(delta_auroc, 6) as delta_auroc, round(ci_lower, 6) as ci_lower, round(ci_upper, 6) as ci_upper, "
    "successful, region, " + wording_sql("region") + " as interpretation from v"
)

ENTRIES = {
    "x1_auroc": (x1, f"with {AUROC_SQL} select model, repeat, round(auroc, 6) as auroc from aurocs"),
    "x2_average_precision": (
        x2, f"with {STEPS_SQL}, aps as ({AP_SQL}) select model, repeat, round(pr_auroc, 6) as pr_auroc from aps"),
    "x3_brier": (
        x3, f"with {views.PREDICTIONS} select model, repeat, round(avg(power(probability - outcome, 2)), 6) as brier "
            "from predictions group by all"),
    "x4_confusion_rates": (
        x4, f"with {views.PREDICTIONS}, rates as ({RATES_SQL}) select model, repeat, round(sensitivity, 6) as sensitivity, "
            "round(specificity, 6) as specificity, round(precision, 6) as precision, "
            "round(balanced_accuracy, 6) as balanced_accuracy from rates"),
    "x5_calibration_fit": (
        x5, f"with {views.PREDICTIONS}, {newton_sql()} select model, repeat, round(a, 6) as calibration_intercept, "
            f"round(b, 6) as calibration_slope, true as calibration_converged from n{NEWTON}"),
    "x5_extreme_calibration": (
        x5_extreme, f"""with {views.PREDICTIONS}, two as (select model, probability >= 0.5 as high, avg(outcome) as p from predictions group by all),
ends as (select model, ln(max(p) filter (high) / (1 - max(p) filter (high))) as up,
  ln(max(p) filter (not high) / (1 - max(p) filter (not high))) as down from two group by model),
line as (select model, (up - down) / (2 * ln((1 - 1e-5) / 1e-5)) as b, (up + down) / 2 as a from ends)
select model, round(a, 5) as calibration_intercept, round(b, 5) as calibration_slope, true as calibration_converged from line"""),
    "x6_metric_bundle": (x6, f"with {NINE} select model, repeat, {ROUNDED} from bundle"),
    "w1_average_rank": (
        w1, f"with {views.PREDICTIONS} select model, repeat, id, probability, rank() over (partition by model, repeat order by probability) "
            "+ (count(*) over (partition by model, repeat, probability) - 1) / 2.0::double as average_rank from predictions"),
    "w2_roc_curve": (
        w2, f"with {ROC_SQL} select model, repeat, point, round(threshold, 6) as threshold, round(fpr, 6) as fpr, "
            "round(tpr, 6) as tpr from roc"),
    "w3_pr_curve": (
        w3, f"with {STEPS_SQL} select model, repeat, (points - point)::bigint as point, round(probability, 6) as threshold, "
            "round(tp / (tp + fp)::double, 6) as precision, round(tp / n1::double, 6) as recall from steps "
            "union all select distinct model, repeat, points::bigint, null::double, 1.0::double, 0.0::double from steps"),
    "w4_calibration_bins": (
        w4, f"with {views.PREDICTIONS}, edges as (select model, repeat, "
            "quantile_cont(probability, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) as e from predictions group by all), "
            "binned as (select p.*, len([x for x in e if x < probability]) as b from predictions p join edges "
            "using (model, repeat)) "
            "select model, repeat, (row_number() over (partition by model, repeat order by b) - 1)::integer as bin, "
            "round(avg(probability) + 1e-9, 6) as mean_predicted, round(avg(outcome), 6) as observed_fraction, "
            "count(*) as rows from binned group by model, repeat, b"),
    "w5_operating_thresholds": (
        w5, f"with {ROC_SQL}, best as (select model, repeat, "
            "row_number() over (partition by model, repeat order by tpr - fpr desc, threshold desc) as a, "
            "row_number() over (partition by model, repeat order by tpr >= 0.8 desc, fpr, threshold desc) as b, "
            "threshold, tpr from roc) select model, repeat, round(max(threshold) filter (a = 1), 6) as youden_threshold, "
            "round(coalesce(max(threshold) filter (b = 1 and tpr >= 0.8), 0.0), 6) as sensitivity_threshold "
            "from best group by all"),
    "a7_exact_quantiles": (
        quantile_edges,
        f"with {views.PREDICTIONS}, q as (select model, repeat, unnest([0.025,0.25,0.5,0.975])::double as step, "
        "unnest(quantile_cont(probability, [0.025,0.25,0.5,0.975])) as quantile from predictions group by model, repeat) "
        "select model, repeat, round(step, 6) as step, round(quantile, 6) as quantile from q"),
    "p16_clipped_logit": (
        p16, f"with {views.PREDICTIONS}, c as (select *, greatest(least(probability * 1.3::double - 0.1::double, 1 - 1e-6), 1e-6) as q "
             "from predictions) select id, model, repeat, round(ln(q / (1 - q)), 6) as logit from c"),
    "p17_threshold_flag": (
        p17, f"with {views.PREDICTIONS} select id, model, repeat, (probability >= youden_threshold)::integer as predicted "
             "from predictions"),
    "e1_model_performance": (e1, f"with {NINE} select model, {MEANS} from bundle group by model"),
    "a5_repeat_uncertainty": (
        a5, f"with {NINE} select model, metric, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as repeat_sd, "
            "round(min(value), 6) as repeat_min, round(max(value), 6) as repeat_max from long group by model, metric"),
    "a6_pivot_by_repeat": (
        a6, f"""with {AUROC_SQL} select repeat, round(max(auroc) filter (model = 'B'), 6) as "B",
            round(max(auroc) filter (model = 'D'), 6) as "D",
            round(max(auroc) filter (model = 'D') - max(auroc) filter (model = 'B'), 6) as delta
            from aurocs group by repeat"""),
    "e2_paired_delta": (
        e2, f"with {AUROC_SQL}, sides as (select repeat, max(auroc) filter (model = 'D') - "
            "max(auroc) filter (model = 'B') as delta from aurocs group by repeat) "
            "select round(avg(delta) over (), 6) as delta, repeat, round(delta, 6) as repeat_delta from sides"),
    "e3_cluster_bootstrap": (e3, f"with {WHOLE_BOOT_SQL} select resample, round(delta, 6) as delta from draws"),
    "e4_single_pass_bootstrap": (
        e4, f"with {views.PREDICTIONS}, single as (select * from predictions where repeat = 0 and release = 'added')"
            + draws_sql("single", False, SEED + 1, R) + " select resample, round(delta, 6) as delta from draws"),
    "a7_percentile_interval": (
        a7, f"with {BOOT_SQL}, i as ({INTERVAL}) select round(ci_lower, 6) as ci_lower, round(ci_upper, 6) as ci_upper, "
            "successful from i"),
    "j13_group_draws": (
        j13, f"with {views.COHORT}" + draws_sql("cohort", True, SEED, R).split("weighted as (")[0].rstrip().rstrip(",")
             + " select resample, group_id, times from times"),
    "e5_interval_verdict": (
        e5, "with rows as (select p_partkey, (p_partkey % 23 - 14) / 200.0::double as lo, "
            "(p_partkey % 23 - 14) / 200.0::double + p_size / 500.0::double as hi from part), v as (select p_partkey, "
            + verdict_sql("lo", "hi", 0.03) + " as region from rows) select p_partkey, region, "
            + wording_sql("region") + " as interpretation from v"),
    "a14_interval_diagnostics": (
        a14, "with rows as (select p_brand, (p_partkey % 23 - 14) / 200.0::double as lo, "
             "(p_partkey % 23 - 14) / 200.0::double + p_size / 500.0::double as hi from part) "
             "select p_brand, round(avg(hi - lo), 6) as mean_width, "
             "round(avg(case when lo <= 0.03 and 0.03 <= hi then 1.0 else 0.0 end), 6) as coverage, "
             "count(*) as intervals from rows group by p_brand"),
    "a14_endpoint_shift": (
        a14_shift, "select event_type, round(greatest("
                   "abs(quantile_cont(value, 0.025) - quantile_cont(value, 0.025) filter (user_id < 20)), "
                   "abs(quantile_cont(value, 0.975) - quantile_cont(value, 0.975) filter (user_id < 20))), 6) "
                   "as max_endpoint_shift from events group by event_type"),
    "estimate": (
        estimate_row,
        f"with {WHOLE_BOOT_SQL}{VERDICT_SQL}"),
    "e3_cluster_bootstrap_500": (
        partial(e3, resamples=500), f"with {views.PREDICTIONS}" + draws_sql("predictions", True, SEED, 500) + " select resample, round(delta, 6) as delta from draws"),
    "e3_cluster_bootstrap_2000": (whole(e3), None),
    "e4_single_pass_bootstrap_2000": (
        whole(e4), f"with {views.PREDICTIONS}, single as (select * from predictions where repeat = 0 and release = 'added')"
                   + draws_sql("single", False, SEED + 1, WHOLE) + " select resample, round(delta, 6) as delta from draws"),
    "a7_percentile_interval_2000": (whole(a7), None),
    "j13_group_draws_2000": (whole(j13), None),
    "estimate_2000": (whole(estimate_row), None),
}
