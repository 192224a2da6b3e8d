import dataclasses

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortry.operators import fit
from cohortry.operators.contracts import ContractError
from cohortry.operators.folds import stratified_folds, stratified_group_folds
from cohortry.operators.vectors import Block
from cohortry.plans import nested_cv as cv


def data(n=150, d=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.array([1, 10, 0.1, 1, 5]) + np.array([0, 100, 0, -3, 2])
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.1 * (x[:, 1] - 100))))).astype(int)
    return x, y, rng.integers(0, 3, n)


def frame(spark, x, y, parts):
    rows = [(i, a.tolist(), int(b), [int(c)]) for i, (a, b, c) in enumerate(zip(x, y, parts))]
    return spark.createDataFrame(rows, "id int, vec array<double>, outcome int, parts array<int>")


def scalings_of(df, width, positions=None):
    long = df.select("outcome", "vec", F.lit(0).alias("outer"), F.col("parts")[0].alias("part"))
    return fit.collect_scalings(fit.fold_scaler(long, ["outer"], "part", list(range(width)) if positions is None else positions, width))


def direct(x, y, c, penalise=True, weights=None):
    a = np.hstack([x, np.ones((len(x), 1))])
    w, p = np.zeros(a.shape[1]), np.ones(a.shape[1])
    p[-1] = float(penalise)
    s = np.ones(len(y)) if weights is None else weights
    for _ in range(100):
        f = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve(c * (a * (s * f * (1 - f))[:, None]).T @ a + np.diag(p), c * a.T @ (s * (f - y)) + p * w)
    return w


def scaled(x, rows):
    mean, sd = x[rows].mean(0), x[rows].std(0)
    return (x - mean) / np.where(sd == 0, 1, sd)


@pytest.mark.parametrize("method, penalise", [("newton", True), ("newton", False), ("gradient", True)])
def test_fits_match_a_direct_solution(spark, method, penalise):
    x, y, parts = data()
    df = frame(spark, x, y, parts)
    tasks = [fit.FitTask(0, part, c) for part in (None, 0, 2) for c in (0.01, 1.0, 100.0)]
    options = fit.FitOptions(penalise_intercept=penalise, method=method)
    fitted = fit.fit_logistic_tasks(df, tasks, scalings_of(df, 5), 5, options)
    for f in fitted:
        rows = np.ones(len(y), bool) if f.task.excluded is None else parts != f.task.excluded
        want = direct(scaled(x, rows)[rows], y[rows], f.task.c, penalise)
        assert f.converged
        assert f.coefficients == pytest.approx(want, abs=1e-5)


def test_fits_match_spark_ml(spark):
    x, y, parts = data()
    df = frame(spark, x, y, parts)
    scalings = scalings_of(df, 5)
    ours = fit.fit_logistic_tasks(df, [fit.FitTask(0, None, 0.5)], scalings, 5, fit.FitOptions(penalise_intercept=False))[0]
    s = scalings[(0, None)]
    rows = [(s.apply(a[None, :])[0].tolist(), float(b)) for a, b in zip(x, y)]
    ml = spark.createDataFrame(rows, "v array<double>, label double").select(array_to_vector("v").alias("features"), "label")
    model = LogisticRegression(regParam=1 / (0.5 * len(y)), elasticNetParam=0.0, standardization=False, tol=1e-12, maxIter=500).fit(ml)
    assert ours.coefficients == pytest.approx([*model.coefficients, model.intercept], abs=1e-6)


def test_balanced_weights_match(spark):
    x, y, parts = data()
    df = frame(spark, x, y, parts)
    got = fit.fit_logistic_tasks(df, [fit.FitTask(0, 1, 1.0)], scalings_of(df, 5), 5, fit.FitOptions(balanced=True))[0]
    rows = parts != 1
    n, n1 = rows.sum(), y[rows].sum()
    weights = np.where(y[rows] == 1, n / (2 * n1), n / (2 * (n - n1)))
    assert got.coefficients == pytest.approx(direct(scaled(x, rows)[rows], y[rows], 1.0, True, weights), abs=1e-6)


def test_separable_data_converges_by_halving(spark):
    x = np.array([[-2.0], [-1.0], [1.0], [2.0], [30.0]])
    df = frame(spark, x, np.array([0, 0, 1, 1, 1]), np.zeros(5, int))
    got = fit.fit_logistic_tasks(df, [fit.FitTask(0, None, 1e6)], scalings_of(df, 1), 1)[0]
    assert got.converged and np.isfinite(got.coefficients).all()


def test_iteration_limit_is_reported(spark):
    x, y, parts = data()
    df = frame(spark, x, y, parts)
    got = fit.fit_logistic_tasks(df, [fit.FitTask(0, None, 1.0)], scalings_of(df, 5), 5, fit.FitOptions(max_iterations=2))[0]
    assert not got.converged


def test_scaler_sees_training_rows_only(spark):
    rows = [([0.0], 0, 0), ([2.0], 1, 0), ([4.0], 0, 0), ([6.0], 1, 0), ([1e9], 1, 1)]
    df = spark.createDataFrame(rows, "vec array<double>, outcome int, part int").withColumn("outer", F.lit(0))
    row = fit.fold_scaler(df, ["outer"], "part", [0], 1).where("excluded = 1").first()
    assert row["mean"][0] == pytest.approx(3.0, abs=1e-6)
    assert row["scale"][0] == pytest.approx(np.std([0, 2, 4, 6]), rel=1e-6)


def test_scalings_of_all_splits_match_the_scaler(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4)) * 5 + 100
    x[:, 2] = 7.0
    x[rng.random((80, 4)) < 0.1] = np.nan
    x[:, 1] = np.where(np.isnan(x[:, 1]), 1.0, x[:, 1])
    rows = [(v.tolist(), int(y), p.tolist()) for v, y, p in zip(x, rng.integers(0, 2, 80), rng.integers(-1, 3, (80, 2)))]
    df = spark.createDataFrame(rows, "vec array<double>, outcome int, parts array<int>").repartition(3)
    long = df.select("outcome", "vec", F.posexplode("parts").alias("outer", "part")).where("part >= 0")
    want = fit.collect_scalings(fit.fold_scaler(long, ["outer"], "part", [0, 1, 2], 4))
    got = fit.split_scalings(df, [0, 1, 2], 4)
    assert set(got) == set(want)
    for key, scaling in want.items():
        for name in ("mean", "scale"):
            assert getattr(got[key], name) == pytest.approx(getattr(scaling, name), rel=1e-12)
        assert got[key].median[0] == pytest.approx(scaling.median[0])
        assert (got[key].rows, got[key].positives) == (scaling.rows, scaling.positives)


def test_scaler_fills_gaps_and_keeps_constants(spark):
    rows = [([1.0, 7.0, 1.0], 0, 0), ([None, 7.0, 0.0], 1, 0), ([5.0, 7.0, 1.0], 0, 0), ([float("nan"), 7.0, 0.0], 1, 1), ([9.0, 7.0, 1.0], 1, 1)]
    df = spark.createDataFrame(rows, "vec array<double>, outcome int, part int").withColumn("outer", F.lit(0))
    got = {r["excluded"]: r for r in fit.fold_scaler(df, ["outer"], "part", [0, 1], 3).collect()}
    assert got[1]["median"][0] == 3.0 and got[1]["mean"][0] == pytest.approx(3.0)
    assert got[1]["scale"][0] == pytest.approx(np.std([1, 3, 5]))
    assert (got[1]["mean"][1], got[1]["scale"][1]) == (7.0, 1.0)
    assert (got[1]["mean"][2], got[1]["scale"][2]) == (0.0, 1.0)
    assert got[None]["median"][0] == 5.0 and got[None]["rows"] == 5


def test_pick_prefers_the_smaller_c_within_the_margin(spark):
    rows = [("a", 0.1, 0.7), ("a", 1.0, 0.7 + 5e-13), ("a", 10.0, 0.69), ("b", 0.1, 0.6), ("b", 1.0, 0.61), ("c", 0.1, None), ("c", 1.0, None)]
    df = spark.createDataFrame(rows, "k string, c double, inner_auroc double")
    got = {r["k"]: r["selected_c"] for r in cv.pick_regularisation(df, ["k"]).collect()}
    assert got == {"a": 0.1, "b": 1.0, "c": 0.1}


SPEC = cv.AnalysisSpec(outer_folds=3, inner_folds=3, repeats=2, grid=(0.1, 1.0))
MODELS = {"B": [Block("x", 5)], "D": [Block("x", 5), Block("bits", 2, continuous=False)]}


@pytest.fixture(scope="module")
def study(spark):
    x, y, _ = data(180, seed=4)
    rows = [(f"i{i:03d}", f"g{i % 45}", int(y[i]), "added" if i % 45 >= 36 else "original", "vMost" if i % 2 else "vNo") for i in range(180)]
    cohort = spark.createDataFrame(rows, "id string, group_id string, outcome int, release string, category string").cache()
    tables = {
        "x": spark.createDataFrame([(r[0], x[i].tolist()) for i, r in enumerate(rows)], "id string, vec array<double>"),
        "bits": spark.createDataFrame([(r[0], [float(i % 2), float(i % 7 == 0)]) for i, r in enumerate(rows)], "id string, vec array<double>"),
    }
    development = cohort.where("release = 'original'")
    folds = stratified_group_folds(development, 3, [11, 12]).cache()
    predictions, tuning = cv.nested_cv(development, folds, tables, MODELS, SPEC)
    return dict(x=x, y=y, rows=rows, cohort=cohort, development=development, tables=tables, folds=folds, predictions=predictions, tuning=tuning.cache())


def brute_nested(study, model, repeat, outer):
    """The same rule with plain loops, for one outer split."""
    from tests.test_metrics import brute_auroc

    index = {r[0]: i for i, r in enumerate(study["rows"])}
    ids = sorted(r["id"] for r in study["development"].collect())
    x = np.array([study["x"][index[i]] for i in ids])
    y = np.array([study["y"][index[i]] for i in ids])
    own = {r["id"]: r["fold"] for r in study["folds"].where(F.col("repeat") == repeat).collect()}
    parts = {r["id"]: r["parts"][repeat * 3 + outer] for r in cv.prepare_rows(study["development"], study["folds"], SPEC).collect()}
    part = np.array([parts[i] for i in ids])
    assert all((part[j] == -1) == (own[i] == outer) for j, i in enumerate(ids))
    train = part >= 0
    best, oof_best, c_best = -1, None, None
    for c in SPEC.grid:
        oof = np.full(len(ids), np.nan)
        for k in range(3):
            inner, valid = train & (part != k), part == k
            z = scaled(x, inner)
            w = direct(z[inner], y[inner], c)
            oof[valid] = 1 / (1 + np.exp(-(z[valid] @ w[:-1] + w[-1])))
        score = brute_auroc(y[train], oof[train])
        if score > best + 1e-12:
            best, oof_best, c_best = score, oof, c
    z = scaled(x, train)
    w = direct(z[train], y[train], c_best)
    test = part == -1
    p = 1 / (1 + np.exp(-(z[test] @ w[:-1] + w[-1])))
    points = [(np.inf, 0.0)] + [
        (t, (y[train][oof_best[train] >= t].mean() * 0 + y[train][oof_best[train] >= t].sum() / y[train].sum()
             - (1 - y[train][oof_best[train] >= t]).sum() / (1 - y[train]).sum())) for t in sorted(set(oof_best[train]), reverse=True)
    ]
    youden = max(points, key=lambda q: (round(q[1], 12), q[0]))[0]
    return c_best, best, dict(zip([i for i, t in zip(ids, test) if t], p)), youden


@pytest.mark.parametrize("repeat, outer", [(0, 0), (1, 2)])
def test_nested_cv_matches_plain_loops(study, repeat, outer):
    c, score, p, youden = brute_nested(study, "B", repeat, outer)
    rows = study["predictions"].where(f"model = 'B' and repeat = {repeat} and outer_fold = {outer}").collect()
    assert {r["selected_c"] for r in rows} == {c}
    assert {r["id"]: r["probability"] for r in rows} == pytest.approx(p, abs=1e-6)
    assert rows[0]["youden_threshold"] == pytest.approx(youden, abs=1e-6)
    logged = study["tuning"].where(f"model = 'B' and repeat = {repeat} and outer_fold = {outer} and c = {c}").first()
    assert logged["inner_auroc"] == pytest.approx(score, abs=1e-9)


def test_every_row_is_scored_once_per_model_and_repeat(study):
    assert study["predictions"].count() == 144 * 2 * 2
    assert study["predictions"].select("id", "model", "repeat").distinct().count() == 144 * 2 * 2
    assert study["tuning"].count() == 2 * 2 * 3 * 2


def test_own_outcome_never_reaches_a_prediction(spark, study):
    """Flip every outcome of one outer fold: its predictions in that fold must not move."""
    folds = study["folds"].where("repeat = 0")
    held = folds.where("fold = 1").select("id", F.lit(1).alias("flip"))
    flipped = study["development"].join(held, "id", "left").withColumn(
        "outcome", F.when(F.col("flip") == 1, 1 - F.col("outcome")).otherwise(F.col("outcome"))
    ).drop("flip")
    spec = dataclasses.replace(SPEC, repeats=1)
    models = {"B": MODELS["B"]}
    first, _ = cv.nested_cv(study["development"], folds, study["tables"], models, spec)
    second, _ = cv.nested_cv(flipped, folds, study["tables"], models, spec)
    a = {r["id"]: r["probability"] for r in first.where("outer_fold = 1").collect()}
    b = {r["id"]: r["probability"] for r in second.where("outer_fold = 1").collect()}
    assert a == pytest.approx(b, abs=1e-9)


def test_transport_checks_before_it_reads_the_update_rows(spark, study):
    models = {"B": MODELS["B"]}
    predictions = study["predictions"].where("model = 'B'")
    tuning = study["tuning"].where("model = 'B'")
    update = study["cohort"].where("release = 'added'")
    result = cv.transport(study["development"], predictions, tuning, update, study["tables"], models, SPEC)
    assert result.count() == update.count() == 36
    assert set(result.columns) >= {"id", "model", "probability", "selected_c", "youden_threshold", "sensitivity_threshold", "outcome"}
    flipped = update.withColumn("outcome", 1 - F.col("outcome"))
    again = cv.transport(study["development"], predictions, tuning, flipped, study["tables"], models, SPEC)
    assert {r["id"]: r["probability"] for r in result.collect()} == pytest.approx({r["id"]: r["probability"] for r in again.collect()}, abs=1e-9)

    class Untouchable:
        def __getattr__(self, name):
            raise AssertionError("the update rows were read before the checks passed")

    for broken_predictions, broken_tuning in (
        (predictions.where("repeat = 0"), tuning), (predictions, tuning.where("not (repeat = 1 and outer_fold = 2)")),
        (predictions.where("id <> 'i000'"), tuning),
    ):
        with pytest.raises(ContractError):
            cv.transport(study["development"], broken_predictions, broken_tuning, Untouchable(), study["tables"], models, SPEC)


def test_transport_names_what_is_wrong(spark, study):
    both = ["B", "D"]
    predictions, development = study["predictions"], study["development"]
    found = lambda p, f=None: {(r["kind"], r["problem"]) for r in cv.transport_violations(development, p, both, SPEC, f).collect()}
    assert found(predictions) == set()
    unknown = predictions.withColumn("model", F.when((F.col("model") == "D") & (F.col("repeat") == 0), "Z").otherwise(F.col("model")))
    assert ("model", "outside") in found(unknown)
    assert ("repeat", "missing") in found(predictions.where("repeat = 0"))
    assert found(predictions.unionByName(predictions.limit(1))) == {("id", "repeated")}
    assert ("id", "uncovered") in found(predictions.where("id <> 'i000'"))
    stranger = predictions.limit(1).withColumn("id", F.lit("nobody"))
    assert ("id", "stranger") in found(predictions.unionByName(stranger))
    folds = study["folds"].select("id", "repeat", "fold")
    assert ("id", "fold of a stranger") in found(predictions, folds.unionByName(folds.limit(1).withColumn("id", F.lit("nobody"))))
    with pytest.raises(ContractError, match="in development"):
        cv.transport(
            development, predictions, study["tuning"], study["cohort"].where("release = 'added'").unionByName(development.limit(20)),
            study["tables"], MODELS, SPEC,
        )


def test_unusable_folds_are_errors(study):
    development, folds = study["development"], study["folds"].select("id", "repeat", "fold")
    found = lambda f: {(r["kind"], r["problem"]) for r in cv.fold_violations(development, f, SPEC).collect()}
    group = development.first()["group_id"]
    inside = development.where(F.col("group_id") == group).select("id")
    assert found(folds) == set()
    left_out = folds.join(inside, "id", "left_anti")
    assert found(left_out) == {("id", "missing")}
    assert found(folds.unionByName(folds.limit(1))) == {("id", "repeated")}
    some = inside.first()["id"]
    apart = folds.withColumn("fold", F.when((F.col("id") == some) & (F.col("repeat") == 0), (F.col("fold") + 1) % 3).otherwise(F.col("fold")))
    assert found(apart) == ({("group", "split")} if inside.count() > 1 else set())
    assert ("id", "outside") in found(folds.withColumn("fold", F.col("fold") + 1))
    for broken in (left_out, folds.where("repeat = 0")):
        with pytest.raises(ContractError):
            cv.nested_cv(development, broken, study["tables"], {"B": MODELS["B"]}, SPEC)
    with pytest.raises(ContractError, match="held out"):
        cv.nested_cv(development, folds, study["tables"], {"B": MODELS["B"]}, SPEC, held_out=study["cohort"].where("release = 'added'").select("id").limit(3))


def test_repeated_features_are_errors(study):
    twice = {name: t.unionByName(t.limit(1)) for name, t in study["tables"].items()}
    with pytest.raises(ContractError, match="repeat"):
        cv.nested_cv(study["development"], study["folds"], twice, {"B": MODELS["B"]}, SPEC)


def test_subset_keeps_its_folds_and_random_design_splits_groups(study):
    spec = dataclasses.replace(SPEC, repeats=1, population="vmost", populations={"vmost": ["vMost"]}, weights="balanced")
    got, _ = cv.nested_cv(study["development"], study["folds"].where("repeat = 0"), study["tables"], {"B": MODELS["B"]}, spec)
    own = {r["id"]: r["fold"] for r in study["folds"].where("repeat = 0").collect()}
    assert got.count() == 72 and all(own[r["id"]] == r["outer_fold"] for r in got.collect())
    rows = stratified_folds(study["development"], 3, [5])
    spec = dataclasses.replace(SPEC, repeats=1, design="stratified_random")
    got, _ = cv.nested_cv(study["development"], rows, study["tables"], {"B": MODELS["B"]}, spec)
    assert got.count() == 144
    assert got.groupBy("group_id").agg(F.count_distinct("outer_fold").alias("n")).where("n > 1").count() > 0


@pytest.mark.parametrize("change", [{"design": "x"}, {"weights": "x"}, {"grid": (1.0, 1.0)}])
def test_unknown_settings_are_errors(change):
    with pytest.raises(ValueError):
        cv.AnalysisSpec(**change)


def test_unknown_population_is_an_error(study):
    with pytest.raises(ValueError):
        cv.nested_cv(study["development"], study["folds"], study["tables"], MODELS, dataclasses.replace(SPEC, population="x"))


@pytest.mark.parametrize("share", [0.05, 0.9])
def test_packed_rows_give_the_sums_of_whole_vectors(spark, monkeypatch, share):
    """Packets hold what is not zero; gaps, parts left out and class weights count as in the pass over whole vectors."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((90, 40)) < share, rng.normal(2, 1, (90, 40)), 0.0)
    x[rng.random(x.shape) < 0.02] = np.nan
    rows = [(r.tolist(), int(rng.random() < 0.4), [int(rng.integers(-1, 3)), int(rng.integers(0, 2))]) for r in x]
    df = spark.createDataFrame(rows, "vec array<double>, outcome int, parts array<int>")
    scalings = fit.split_scalings(df, list(range(30)), 40)
    tasks = dict(enumerate([fit.FitTask(0, None, 1.0), fit.FitTask(0, 1, 1.0), fit.FitTask(1, 0, 0.1), fit.FitTask(1, 0, 1.0)]))
    points = {n: rng.normal(size=41) for n in tasks}
    monkeypatch.setattr(fit, "PACKET_ROWS", 16)
    packets = fit.packed_rows(df)
    assert packets.where("row is null").isEmpty() == (share < 0.1)
    found, want = (
        {r["task"]: np.array(r["stats"]) for r in made(rows, tasks, points, scalings, fit.FitOptions(balanced=True), *more).collect()}
        for made, rows, more in ((fit._packed_pass, packets, ()), (fit._sum_pass, df, (False,)))
    )
    assert found.keys() == want.keys() == tasks.keys()
    for n in tasks:
        assert found[n] == pytest.approx(want[n], rel=1e-9, abs=1e-9)


def test_transport_reads_its_cohorts_once(spark, study, monkeypatch):
    """Checks and plans start from written tables, not from the plans they were given."""
    written = []
    write = cv.saved

    def refuse(*_):
        raise ContractError("far enough")

    monkeypatch.setattr(cv, "saved", lambda df: written.append(df.columns) or write(df))
    monkeypatch.setattr(cv, "transport_violations", refuse)
    with pytest.raises(ContractError, match="far enough"):
        cv.transport(study["development"], None, None, None, {}, MODELS, SPEC)
    assert written == [study["development"].columns]


def test_passes_over_wide_vectors_hold_little_of_a_batch(spark, monkeypatch):
    """The functions of ``split_scalings`` get one large batch; what they allocate does not go with its rows."""
    import tracemalloc

    import pyarrow as pa

    passes, settings, frames = [], [], type(spark.range(1))
    send, collect = frames.mapInArrow, frames.collect

    def told(df, function, schema, *more):
        passes.append(function)
        return send(df, function, schema, *more)

    monkeypatch.setattr(frames, "mapInArrow", told)
    monkeypatch.setattr(frames, "collect", lambda df: settings.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) or collect(df))
    width, rows, before = 2_000, 2_000, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    x = np.random.default_rng(3).normal(size=(rows, width))
    df = spark.createDataFrame([([float(v) for v in x[i]], i % 2, [0]) for i in range(20)], "vec array<double>, outcome int, parts array<int>")
    fit.split_scalings(df, list(range(width)), width)
    batch = pa.RecordBatch.from_arrays([
        pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(x.ravel())), pa.array(np.arange(rows) % 2), pa.array([[0]] * rows, pa.list_(pa.int32())),
    ], names=["vec", "outcome", "parts"])
    for function in passes:
        tracemalloc.start()
        sums = sum(np.array(b.column("stats")[0].as_py())[2:2 + width] for b in function(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < x.nbytes and np.isfinite(sums).all()
    assert len(passes) == 2 and set(settings) == {"4m"} and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
