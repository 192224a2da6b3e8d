import random

import numpy as np
import pytest

from cohortry.operators import resample
from cohortry.operators.ordering import assert_order_invariant
from tests.test_metrics import brute_auroc


def predictions(spark, n=240, seed=5, hot_group=0.4, hot_score=0.4):
    """One group and one score hold much of the data."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "hot" if rng.random() < hot_group else f"g{rng.randrange(25)}"
        y = int(rng.random() < 0.5)
        for model in "BD":
            for repeat in range(2):
                p = 0.25 if rng.random() < hot_score else round(0.6 * rng.random() + 0.3 * y, 2)
                rows.append((i, group, y, model, repeat, p))
    return rows, spark.createDataFrame(rows, "id int, group_id string, outcome int, model string, repeat int, probability double")


def brute_deltas(rows, draws, resamples):
    deltas = {}
    for r in range(resamples):
        by_repeat = []
        for repeat in sorted({row[4] for row in rows}):
            scores = {}
            for model in "BD":
                y, p = [], []
                for row in rows:
                    if row[3] == model and row[4] == repeat:
                        y += [row[2]] * draws.get((r, row[1]), 0)
                        p += [row[5]] * draws.get((r, row[1]), 0)
                scores[model] = brute_auroc(y, p)
            if None not in scores.values():
                by_repeat.append(scores["D"] - scores["B"])
        if by_repeat:
            deltas[r] = float(np.mean(by_repeat))
    return deltas


@pytest.mark.parametrize("chunk", [2048, 7])
def test_bootstrap_matches_row_copies(spark, chunk):
    rows, df = predictions(spark)
    draws = {(r["resample"], r["group_id"]): r["times"] for r in resample.group_draws(df, "group_id", 6, 11).collect()}
    got = {
        r["resample"]: r["delta"]
        for r in resample.cluster_bootstrap(df, "group_id", "model", "outcome", "probability", 6, 11, chunk_rows=chunk).collect()
    }
    want = brute_deltas(rows, draws, 6)
    assert got.keys() == want.keys()
    for r in got:
        assert got[r] == pytest.approx(want[r], abs=1e-12)


def brute_pieces(score, times, pos, neg):
    """Twice the area, positives and negatives of every resample, pair by pair."""
    w_pos, w_neg = times * pos[:, None], times * neg[:, None]
    wins = 2 * (score[:, None] > score[None, :]) + (score[:, None] == score[None, :]).astype(int)
    return np.einsum("ir,ij,jr->r", w_pos.astype(float), wins.astype(float), w_neg.astype(float)), w_pos.sum(0), w_neg.sum(0)


@pytest.mark.parametrize("cuts", [[], [1], [40], [3, 4, 5, 70], [10, 20, 30, 40, 50, 60, 70, 80, 90]])
@pytest.mark.parametrize("big", [1, 10**9])
def test_sweeps_over_any_cut_add_up(cuts, big):
    """Tasks cut the rows anywhere, also inside a score; their pieces give the whole area."""
    rng = np.random.default_rng(len(cuts))
    score = np.sort(rng.integers(0, 25, 100) / 10)
    times, pos, neg = rng.integers(0, 4, (100, 7)).astype(np.uint8), rng.integers(0, 3, 100) * big, rng.integers(0, 3, 100) * big
    found = {}
    for a, b in zip([0, *cuts], [*cuts, 100]):
        sweep = resample.Sweep(7)
        for start in range(a, b, 9):
            rows = slice(start, min(b, start + 9))
            sweep.add(score[rows], times[rows], pos[rows], neg[rows])
        for at, kind, area, p, n in sweep.pieces():
            old = found.get((at, kind), (0, 0, 0))
            found[(at, kind)] = (old[0] + area, old[1] + p, old[2] + n)
    area, before = np.zeros(7), np.zeros(7)
    for (_, kind), (inner, p, n) in sorted(found.items()):
        area += (p.astype(float) * n if kind == 0 else inner) + 2.0 * p * before
        before = before + n
    want = brute_pieces(score, times, pos, neg)
    assert area == pytest.approx(want[0], rel=1e-12)
    assert (sum(v[1] for v in found.values()) == want[1]).all() and (before == want[2]).all()


def test_draws_that_do_not_fit_every_task(spark, monkeypatch):
    rows, df = predictions(spark, n=80)
    sent = resample.cluster_bootstrap(df, "group_id", "model", "outcome", "probability", 9, 2, draw_block=4).orderBy("resample").collect()
    monkeypatch.setattr(resample, "BROADCAST_BYTES", 0)
    met = resample.cluster_bootstrap(df, "group_id", "model", "outcome", "probability", 9, 2, draw_block=4).orderBy("resample").collect()
    assert [tuple(r) for r in sent] == [pytest.approx(tuple(r), abs=1e-12) for r in met]


def test_a_group_drawn_more_than_255_times(spark):
    draws = spark.range(700).selectExpr("0L as resample", "0L as group_no")
    groups = spark.createDataFrame([("g", 0)], "group_id string, group_no bigint")
    row = resample._multiplicities(draws, groups, "group_id", 3, 3).first()
    assert np.frombuffer(row["times"], np.uint16).tolist() == [700, 0, 0]
    assert resample._unpacked(__import__("pyarrow").array([bytes(row["times"]), b"\x01\x02\x03"]), 3).tolist() == [[700, 0, 0], [1, 2, 3]]


def test_many_blocks_of_resamples(spark):
    rows, df = predictions(spark, n=60)
    whole = resample.cluster_bootstrap(df, "group_id", "model", "outcome", "probability", 9, 2).orderBy("resample").collect()
    split = resample.cluster_bootstrap(df, "group_id", "model", "outcome", "probability", 9, 2, draw_block=4).orderBy("resample").collect()
    assert [r["resample"] for r in whole] == [r["resample"] for r in split]
    assert [r["delta"] for r in whole] == pytest.approx([r["delta"] for r in split], abs=1e-12)


def test_whole_groups_are_drawn(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), ("c",)], "group_id string")
    draws = resample.group_draws(df, "group_id", 50, 7)
    per = {r["resample"]: r["n"] for r in draws.groupBy("resample").agg({"times": "sum"}).toDF("resample", "n").collect()}
    assert per == dict.fromkeys(range(50), 3)


def test_one_class_resamples_give_no_row(spark):
    rows = [(i, f"g{i}", int(i == 0), m, 0, 0.1 * i) for i in range(3) for m in "BD"]
    df = spark.createDataFrame(rows, "id int, group_id string, outcome int, model string, repeat int, probability double")
    draws = resample.group_draws(df, "group_id", 40, 3).collect()
    both = {r["resample"] for r in draws if r["group_id"] == "g0"} & {r["resample"] for r in draws if r["group_id"] != "g0"}
    got = resample.cluster_bootstrap(df, "group_id", "model", "outcome", "probability", 40, 3).collect()
    assert {r["resample"] for r in got} == both


def test_draws_do_not_depend_on_input_order(spark):
    _, df = predictions(spark, n=40)
    assert_order_invariant(lambda d: resample.group_draws(d, "group_id", 5, 1), df)


def test_a_single_group_gives_the_point_estimate_every_time(spark):
    rows, df = predictions(spark, n=30, hot_group=1.0)
    got = resample.cluster_bootstrap(df, "group_id", "model", "outcome", "probability", 5, 1).collect()
    point = brute_deltas(rows, {(0, "hot"): 1}, 1)[0]
    assert [r["delta"] for r in got] == pytest.approx([point] * 5, abs=1e-12)


def test_interval_of_the_draws(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.arange(41))], "resample int, delta double")
    row = resample.percentile_interval(df, []).first()
    assert (row["ci_lower"], row["ci_upper"], row["successful"]) == (1.0, 39.0, 41)


def test_more_resamples_than_a_block_match_row_copies(spark):
    rows, df = predictions(spark, n=40)
    n = 2 * resample.DRAW_BLOCK + 10
    draws = {(r["resample"], r["group_id"]): r["times"] for r in resample.group_draws(df, "group_id", n, 3).collect()}
    got = {r["resample"]: r["delta"] for r in resample.cluster_bootstrap(df, "group_id", "model", "outcome", "probability", n, 3).collect()}
    want = brute_deltas(rows, draws, n)
    assert got.keys() == want.keys()
    assert [got[r] for r in want] == pytest.approx(list(want.values()), abs=1e-12)


def test_registered_bootstraps_draw_the_whole_number_of_resamples(spark, monkeypatch):
    import __spark_entry__ as entry_points
    from cohortry.operators import prefix

    monkeypatch.setattr(prefix, "CELL_ROWS", 100_000)
    answer = entry_points.queries()["estimate_2000"](spark, "/root/testdata/sf0.001").first()
    assert answer["successful"] == 2000


@pytest.mark.parametrize("prefix", ["120900:7", "-3:1999", "x" * 60])
def test_hashes_of_a_block_are_the_column_expression(spark, prefix):
    from pyspark.sql import functions as F

    from cohortry.functions.hashing import stable_hash, stable_hashes

    for start, stop in ((0, 120), (9_990, 10_020), (99_999_995, 100_000_005)):
        want = [r["h"] for r in spark.range(start, stop, 1, 1).select(stable_hash(F.lit(prefix), "id").alias("h")).collect()]
        assert stable_hashes(prefix, start, stop).tolist() == want


def test_packed_draws_are_the_single_draws(spark, monkeypatch):
    monkeypatch.setattr(resample, "DRAWN_AT_ONCE", 1_000)
    size, resamples = 5_000, 3  # two ranges, five parts a resample
    got = np.zeros((resamples, size), int)
    for r in resample._drawn(spark, size, resamples, 7).collect():
        at = r["range"] * resample._range_width(size) + np.frombuffer(r["drawn"], np.uint16).astype(int)
        np.add.at(got[r["resample"]], at, 1)
    want = np.zeros_like(got)
    for r in resample._draws(spark, size, resamples, 7).collect():
        want[r["resample"], r["group_no"]] += 1
    assert (got == want).all() and (got.sum(axis=1) == size).all()


def test_tables_of_draws_in_blocks_and_slots(spark, monkeypatch):
    """Every block of resamples meets every slot of rows; rows travel without their draws."""
    rows, df = predictions(spark, n=80)
    draws = {(r["resample"], r["group_id"]): r["times"] for r in resample.group_draws(df, "group_id", 9, 2).collect()}
    monkeypatch.setattr(resample, "BROADCAST_BYTES", 60)
    monkeypatch.setattr(resample, "TASK_PRODUCTS", 100)
    monkeypatch.setattr(resample, "PACKED_BYTES", 8)
    got = {r["resample"]: r["delta"] for r in resample.cluster_bootstrap(df, "group_id", "model", "outcome", "probability", 9, 2, chunk_rows=5).collect()}
    want = brute_deltas(rows, draws, 9)
    assert got.keys() == want.keys()
    assert [got[r] for r in want] == pytest.approx(list(want.values()), abs=1e-12)


def test_a_packed_row_grows_with_its_counts_not_with_resamples(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 3_000, 1, 1).select(
        (F.col("id") % 3 == 0).alias("k"), (F.col("id") / 7).alias("_score"), (F.col("id") * 7 % 500).alias("group_no"),
        (F.col("id") % 2).alias("pos"), F.when(F.col("id") == 5, 70_000).otherwise(1).cast("bigint").alias("neg"), F.lit(0).alias("part"),
    ).sortWithinPartitions("k", "_score")
    packed = resample._packed(rows, ["k"], 512).collect()
    assert sum(len(r["data"]) for r in packed) == 4 * 3_000 and sum(len(r["new"]) for r in packed) == 3_000
    assert {len(r["neg"]) // len(r["new"]) for r in packed} == {1, 4}
    assert sum(np.frombuffer(r["neg"], resample.KINDS[len(r["neg"]) // len(r["new"])]).astype(int).sum() for r in packed) == 72_999


def test_blocks_of_resamples_read_rows_that_were_written_once(spark, monkeypatch):
    """What a bootstrap writes and shuffles does not grow with the number of blocks."""
    from pathlib import Path

    from cohortry import session

    rows, df = predictions(spark, n=80)
    session._checkpoint_folder(spark)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    packed = []

    def told(r, keys, *more, **options):
        packed.append((r.select("block").distinct().count(), r.rdd.getNumPartitions(), r._jdf.queryExecution().executedPlan().toString()))
        return sweep(r, keys, *more, **options)

    sweep = resample._swept_packed
    monkeypatch.setattr(resample, "_swept_packed", told)
    written = {}
    for blocks in (9, 45):
        before = set(folder.rglob("*.parquet"))
        got = resample.cluster_bootstrap(df, "group_id", "model", "outcome", "probability", 45, 2, draw_block=45 // blocks).orderBy("resample").collect()
        tables = {f.parent for f in set(folder.rglob("*.parquet")) - before}
        sizes = [sum(len(r["data"]) for r in spark.read.parquet(str(t)).select("data").collect()) for t in tables if "data" in spark.read.parquet(str(t)).columns]
        written[blocks] = (sizes, [r["delta"] for r in got])
        assert packed[-1][:2] == (blocks, blocks) and "Exchange" not in packed[-1][2]
    assert written[9][0] == written[45][0] and len(written[9][0]) == 1 and written[9][0][0] > 0
    assert written[9][1] == pytest.approx(written[45][1], abs=1e-12)


@pytest.mark.parametrize("size", [1, 3, 700])
def test_tables_of_draws_are_the_single_draws(spark, monkeypatch, size):
    monkeypatch.setattr(resample, "DRAWN_AT_ONCE", 100)
    want = np.zeros((size, 400 if size == 1 else 4), int)
    for r in resample._draws(spark, size, want.shape[1], 7).collect():
        want[r["group_no"], r["resample"]] += 1
    got = [resample._drawn_table(size, first, width, 7) for first, width in ((0, 1), (1, want.shape[1] - 1))]
    assert (np.hstack(got) == want).all() and got[1].dtype == np.uint8


def test_a_table_of_draws_widens_where_a_group_is_drawn_more_than_255_times(monkeypatch):
    monkeypatch.setattr(resample, "stable_hashes", lambda prefix, start, stop: np.zeros(stop - start, np.uint64) + np.uint64(5 if prefix.endswith(":1") else 0))
    monkeypatch.setattr(resample, "DRAWN_AT_ONCE", 200)
    got = resample._drawn_table(700, 0, 2, 1)
    assert got.dtype == np.uint16 and got[0].tolist() == [700, 0] and got[5].tolist() == [0, 700] and got.sum() == 1_400


def test_slots_in_any_order_of_files(spark, monkeypatch):
    """Several slots a block, and a reader that gives the split files backwards."""
    rows, df = predictions(spark, n=80)
    draws = {(r["resample"], r["group_id"]): r["times"] for r in resample.group_draws(df, "group_id", 9, 2).collect()}
    for name, value in (("BROADCAST_BYTES", 60), ("TASK_PRODUCTS", 100), ("HASHED_AS_ROWS", 1)):
        monkeypatch.setattr(resample, name, value)
    seen = []
    sweep = resample._swept_packed

    def backwards(r, *more):
        seen.append(r.rdd.getNumPartitions())
        return sweep(r.repartition(3, "block").sortWithinPartitions("block", "part", r["at"].desc()), *more)

    monkeypatch.setattr(resample, "_swept_packed", backwards)
    got = {r["resample"]: r["delta"] for r in resample.cluster_bootstrap(df, "group_id", "model", "outcome", "probability", 9, 2, chunk_rows=5).collect()}
    want = brute_deltas(rows, draws, 9)
    assert seen[0] > 9 and got.keys() == want.keys()
    assert [got[r] for r in want] == pytest.approx(list(want.values()), abs=1e-12)


@pytest.mark.parametrize("name", ["e3_cluster_bootstrap", "estimate", "r3_sensitivity_table"])
def test_queries_that_draw_2000_resamples_in_code_and_sql(spark, monkeypatch, name):
    import __spark_entry__ as entry_points

    asked = []

    def told(counts, group, keys, score, resamples, *more, **options):
        asked.append(resamples)
        return drawn(counts, group, keys, score, 2, *more, **options)

    drawn = resample.resampled_auroc
    monkeypatch.setattr(resample, "resampled_auroc", told)
    entry_points.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked and set(asked) == {2000}
    assert "range(2000) r(resample)" in entry_points.oracle_sql()[name] and "range(20)" not in entry_points.oracle_sql()[name]
