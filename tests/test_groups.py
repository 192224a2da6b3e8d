import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry import views
from cohortry.functions.hashing import stable_hash
from cohortry.operators import folds, groups, vectors
from cohortry.operators.contracts import ContractError, split_groups
from cohortry.operators.ordering import assert_order_invariant


def tanimoto(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def random_sets(rng, n, universe, hot_bit=True):
    rows = []
    for i in range(n):
        if i % 3 == 0:
            bits = {1, 2, 3, 5}  # a third of the rows are copies of one set
        else:
            bits = set(rng.sample(range(universe), rng.randrange(0, 9))) | ({0} if hot_bit and rng.random() < 0.6 else set())
        rows.append((i, sorted(bits)))
    return rows


def sequential_leaders(rows, threshold, hashes):
    """The plain rule over all rows: most neighbours first, then hash, each founder takes its open neighbours."""
    sets = {i: set(b) for i, b in rows}
    near = {i: {j for j in sets if j != i and 1 - tanimoto(sets[i], sets[j]) <= 1 - threshold} for i in sets}
    rep = {}
    for i, b in rows:
        rep[i] = min(j for j, c in rows if c == b)
    order = sorted(sets, key=lambda i: (-len(near[i]), hashes[rep[i]], rep[i], i))
    taken, clusters = {}, 0
    for i in order:
        if i in taken:
            continue
        for j in {i} | near[i]:
            taken.setdefault(j, clusters)
        clusters += 1
    return taken


@pytest.mark.parametrize("small,large,threshold", [(243, 729, 1 / 3), (1_000, 10_000, 0.1), (1, 3, 1 / 3), (5, 25, 0.2)])
def test_pairs_at_the_exact_limit(spark, small, large, threshold):
    rows = [(1, list(range(small))), (2, list(range(large)))]
    distinct, _ = groups.fingerprints(spark.createDataFrame(rows, "id int, bits array<int>"))
    assert [(r["a"], r["b"]) for r in groups.tanimoto_pairs(distinct, threshold).collect()] == [(1, 2)]


@pytest.mark.parametrize("threshold", [0.1, 0.2, 1 / 3, 0.5])
def test_nested_sets_at_exact_limits(spark, threshold):
    sizes = [1, 2, 3, 4, 5, 6, 8, 9, 10, 12, 15, 16, 18, 20, 25, 27, 30, 40, 50, 81, 100]
    rows = [(n, list(range(n))) for n in sizes]
    distinct, _ = groups.fingerprints(spark.createDataFrame(rows, "id int, bits array<int>"))
    got = {(r["a"], r["b"]) for r in groups.tanimoto_pairs(distinct, threshold).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sizes, 2) if 1 - a / b <= 1 - threshold}


def test_common_bits_are_met_in_blocks(spark):
    rng = random.Random(9)
    rows = [(i, sorted({0, *rng.sample(range(1, 40), 5)})) for i in range(90)]
    distinct, _ = groups.fingerprints(spark.createDataFrame(rows, "id int, bits array<int>"))
    found = [{(r["a"], r["b"]) for r in groups.tanimoto_pairs(distinct, 0.4, block=b).collect()} for b in (4, 1_000)]
    assert found[0] == found[1] and found[0]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_pairs_match_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 10))
    rows = random_sets(rng, 120, 24)
    df = spark.createDataFrame(rows, "id int, bits array<int>")
    distinct, members = groups.fingerprints(df)
    got = {(r["a"], r["b"]): r["similarity"] for r in groups.tanimoto_pairs(distinct, threshold).collect()}
    reps = {tuple(b): i for i, b in reversed(rows)}
    want = {
        tuple(sorted((reps[a], reps[b]))): tanimoto(set(a), set(b))
        for a, b in itertools.combinations(reps, 2)
        if 1 - tanimoto(set(a), set(b)) <= 1 - threshold
    }
    assert got == pytest.approx(want)
    assert len(got) == len(want)
    assert members.count() == len(rows)


@pytest.mark.parametrize("seed", range(3))
def test_leaders_match_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    rows = random_sets(rng, 60, 12)
    df = spark.createDataFrame(rows, "id int, bits array<int>")
    hashes = {r["id"]: r["h"] for r in df.select("id", stable_hash(0, "id").alias("h")).collect()}
    got = {r["id"]: r["cluster_no"] for r in groups.cluster_sets(df, 0.5).collect()}
    assert got == sequential_leaders(rows, 0.5, hashes)


def test_group_keys_and_fallback(spark):
    rows = [(1, "k", [1, 2]), (2, "k", [8]), (3, "", [1, 2, 3]), (4, None, [1, 2, 3, 4]), (5, "", [50]), (6, "", [])]
    df = spark.createDataFrame(rows, "id int, key string, bits array<int>")
    got = {r["id"]: r["group_id"] for r in groups.assign_groups(df, 0.5).collect()}
    assert got[1] == got[2] == "scaffold:k"
    assert got[3] == got[4] == "acyclic:0000"
    assert len({got[5], got[6], got[3]}) == 3


def test_update_rows_do_not_shape_development_groups(spark):
    rows = [(i, "", bits, "dev" if i < 20 else "upd") for i, bits in random_sets(random.Random(1), 40, 10)]
    df = spark.createDataFrame(rows, "id int, key string, bits array<int>, release string")
    both = {r["id"]: r["group_id"] for r in groups.isolated_groups(df, 0.5, "release", "dev", "upd").collect()}
    alone = {r["id"]: r["group_id"] for r in groups.assign_groups(df.where("release = 'dev'"), 0.5).collect()}
    assert {i: both[i] for i in alone} == alone and len(both) == 40


def grouped_rows(spark, n=600, hot=0.34, seed=2):
    rng = random.Random(seed)
    rows = [(i, "hot" if rng.random() < hot else f"g{rng.randrange(80)}", int(rng.random() < 0.4)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, group_id string, outcome int")


def test_folds_keep_groups_and_classes(spark):
    df = grouped_rows(spark)
    dealt = folds.stratified_group_folds(df, 5, [1, 2, 3]).cache()
    assert dealt.count() == 3 * df.count()
    assert split_groups(dealt, "group_id", "repeat", "fold").count() == 0
    assert folds.fold_violations(dealt, ["repeat"], 5).count() == 0
    sizes = dealt.select("repeat", "fold", "group_id").distinct().groupBy("repeat", "fold").count().collect()
    assert max(r["count"] for r in sizes) - min(r["count"] for r in sizes) <= 1
    assert dealt.groupBy("group_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() > 0


def test_one_class_folds_are_reported(spark):
    df = spark.createDataFrame([(i, f"g{i}", int(i < 2)) for i in range(20)], "id int, group_id string, outcome int")
    with pytest.raises(ContractError):
        folds.stratified_group_folds(df, 5, [1])
    dealt = folds.stratified_group_folds(df, 5, [1], check=False)
    assert folds.fold_violations(dealt, ["repeat"], 5).where("problem = 'one_class'").count() == 3


def test_row_folds_balance_classes_and_keep_the_group(spark):
    df = grouped_rows(spark)
    dealt = folds.stratified_folds(df, 5, [4])
    per = dealt.groupBy("outcome", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in per if r["outcome"] == y]
        assert max(counts) - min(counts) <= 1
    assert dealt.select("id", "group_id").exceptAll(df.select("id", "group_id")).count() == 0


def test_folds_and_pairs_do_not_depend_on_input_order(spark):
    df = grouped_rows(spark, 150)
    assert_order_invariant(lambda d: folds.stratified_group_folds(d, 3, [1, 2]), df)
    assert_order_invariant(lambda d: folds.stratified_folds(d, 3, [1]), df)
    sets = spark.createDataFrame(random_sets(random.Random(8), 50, 12), "id int, bits array<int>")
    assert_order_invariant(lambda d: groups.cluster_sets(d, 0.5), sets)


def test_pooling_ignores_the_mask(spark):
    rows = [("a", 0, 1, [3.0, 0.0]), ("a", 1, 1, [0.0, 4.0]), ("a", 2, 0, [99.0, 99.0]), ("z", 0, 0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, position int, mask int, vec array<double>")
    got = {r["id"]: r["vec"] for r in vectors.masked_mean_pool(df).collect()}
    assert got["a"] == pytest.approx([0.6, 0.8])
    assert got["z"] == [0.0, 0.0]


def test_pooling_adds_up_runs_of_rows_before_they_are_grouped(spark):
    rows = [(i % 3 if i >= 300 else i // 100, i % 7 != 0, [float(i), 1.0]) for i in range(306)] + [(None, True, [2.0, 0.0])]
    df = spark.createDataFrame([(i, int(m), v) for i, m, v in rows], "id int, mask int, vec array<float>").coalesce(1)
    assert vectors.run_sums(df).count() == 3 + 6 + 1
    got = {r["id"]: (r["attended"], r["vec"]) for r in vectors.masked_mean_pool(df).collect()}
    for key in (0, 1, 2, None):
        kept = [v for i, m, v in rows if i == key and m]
        mean = np.mean(kept, axis=0)
        assert got[key][0] == len(kept) and got[key][1] == pytest.approx(list(mean / np.linalg.norm(mean)))


def test_tokens_are_the_stable_hashes_of_words(spark, monkeypatch, tmp_path):
    texts = ["a b  a", " \tx y ", "", None, "ä a " * 50, " ".join(f"w{i}" for i in range(200))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(views, "KNOWN_WORDS", 3)
    words = F.transform(F.split(F.trim("text"), " "), lambda w: F.when(stable_hash(59, w) % 50 == 0, 0).otherwise(stable_hash(59, w) % 30000 + 1))
    want = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").select("id", words.alias("token_ids"))
    rows = lambda df: sorted((r["id"], r["token_ids"]) for r in df.collect())
    found = views.tokens(spark, str(tmp_path))
    assert rows(found) == rows(want)
    # nothing is hashed in column expressions, once for every use of the tokens
    assert "md5" not in found._jdf.queryExecution().toString()


def unit_rows(n=20, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(f"i{i:02d}", row.tolist()) for i, row in enumerate(x)]


def test_repeatability(spark):
    rows = unit_rows()
    base = spark.createDataFrame(rows, "id string, vec array<double>")
    turned = spark.createDataFrame(list(reversed(rows)), "id string, vec array<double>")
    assert all(r["passed"] for r in vectors.repeatability_report(base, base, turned, 18).collect())
    off = base.withColumn("vec", F.when(F.col("id") == "i03", F.transform("vec", lambda x: x + 1e-3)).otherwise(F.col("vec")))
    verdicts = {r["comparison"]: r["passed"] for r in vectors.repeatability_report(base, base, off, 18).collect()}
    assert verdicts == {"same_order": True, "reordered": False}
    short = base.where("id > 'i02'")
    assert not any(r["passed"] for r in vectors.repeatability_report(base, short, short, 18).collect())
    bad = base.withColumn("vec", F.transform("vec", lambda x: F.when(F.col("id") == "i00", float("nan")).otherwise(x)))
    row = vectors.compare_vector_runs(base, bad).first()
    assert (row["finite"], row["within_tolerance"]) == (False, False)


def test_coverage(spark):
    base = spark.createDataFrame(unit_rows(), "id string, vec array<double>")
    one = base.where("id = 'i05'")
    assert vectors.coverage_report(base.select("id"), base, one).first()["passed"]
    assert not vectors.coverage_report(base.select("id"), base.where("id <> 'i01'"), one).first()["passed"]
    assert not vectors.coverage_report(base.select("id"), base, one.union(one)).first()["passed"]
    assert not vectors.coverage_report(base.select("id"), base, base).first()["passed"]


def test_triage(spark):
    df = spark.createDataFrame([("a", [5, 6]), ("b", [0, 1, 2, 3, 4]), ("c", [1, 2, 3, 4, 5])], "id string, token_ids array<int>")
    ok, failures = vectors.triage_sequences(df, 4)
    assert [(r["id"], r["sequence_length"]) for r in ok.collect()] == [("a", 2)]
    assert {(r["id"], r["reason"], r["unknown_count"]) for r in failures.collect()} == {("b", "TOKENIZATION_FAILURE", 1), ("c", "OVERLENGTH", 0)}


def test_triage_makes_the_tokens_once_for_both_parts(spark):
    rows = [("a", [5, 6]), ("b", [0, 1, 0, None, 4]), ("c", [1, 2, 3, 4, None]), ("d", None), ("e", []), ("f", [None, None])]
    df = spark.createDataFrame(rows, "id string, token_ids array<bigint>").mapInArrow(lambda batches: batches, "id string, token_ids array<bigint>")
    ok, failures = vectors.triage_sequences(df, 4)
    assert sorted(map(tuple, ok.collect())) == [("a", [5, 6], 2), ("d", None, None), ("e", [], 0), ("f", [None, None], 2)]
    assert sorted(map(tuple, failures.collect())) == [("b", "TOKENIZATION_FAILURE", 2, 5), ("c", "OVERLENGTH", 0, 5)]
    both = ok.select("id", "sequence_length").unionByName(failures.select("id", "sequence_length"))
    assert "MapInArrow" not in both._jdf.queryExecution().executedPlan().toString()


def test_missing_features_are_an_error(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id int")
    tables = {"x": spark.createDataFrame([(1, [1.0])], "id int, vec array<double>")}
    with pytest.raises(ContractError):
        vectors.assemble_blocks(ids, tables, [vectors.Block("x", 1)])
    blocks = [vectors.Block("a", 2), vectors.Block("b", 3, False), vectors.Block("c", 1)]
    assert vectors.continuous_positions(blocks) == [0, 1, 5]


def sequential(n, rank, pairs):
    """Visit by rank; (leader of each node)."""
    around = {i: set() for i in range(n)}
    for a, b in pairs:
        around[a].add(b)
        around[b].add(a)
    leader = {}
    for i in sorted(range(n), key=rank):
        if i not in leader:
            leader[i] = i
            for j in around[i]:
                leader.setdefault(j, i)
    return leader


@pytest.mark.parametrize("shape", ["chain", "two chains that meet", "random", "star of chains"])
def test_rounds_stay_few_on_chains(spark, monkeypatch, shape):
    """Ranks fall along a chain, so a node knows nothing before all nodes ahead of it do."""
    n, rng = 700, random.Random(3)
    pairs = {
        "chain": [(i, i + 1) for i in range(n - 1)],
        "two chains that meet": [(i, i + 2) for i in range(n - 2)] + [(n - 2, n - 1), (100, 101)],
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(900)],
        "star of chains": [(0, i) for i in range(1, 40)] + [(i, i + 39) for i in range(1, n - 39)],
    }[shape]
    pairs = pairs + [pairs[0], pairs[5][::-1], (7, 7)]
    nodes = spark.createDataFrame([(i, n - i) for i in range(n)], "rep bigint, neighbours bigint")
    rounds = []
    write = groups.saved
    monkeypatch.setattr(groups, "saved", lambda df: rounds.append(1) or write(df))
    monkeypatch.setattr("cohortry.operators.prefix.CELL_ROWS", 1000)
    got = {r["rep"]: r["leader"] for r in groups.leader_clusters(nodes, spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == sequential(n, lambda i: i, pairs)
    assert len(rounds) <= 18


@pytest.mark.parametrize("threshold", [0.1, 0.3, 1 / 3, 0.4, 0.8])
@pytest.mark.parametrize("universe", [12, 300])
def test_pairs_of_blocks_are_all_pairs(spark, monkeypatch, threshold, universe):
    """Sets over few bits are compared block by block; only pairs found leave a task."""
    rng = random.Random(universe)
    sets = {i: frozenset(rng.sample(range(0, 7 * universe, 7), rng.randrange(0, min(universe, 40)))) for i in range(150)}
    sets = {min(i for i in sets if sets[i] == s): s for s in set(sets.values())}
    want = {}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and x | y and 1.0 - len(x & y) / len(x | y) <= 1.0 - threshold:
                want[(a, b)] = len(x & y) / len(x | y)
    monkeypatch.setattr(groups, "BLOCK_SETS", 8)
    monkeypatch.setattr(groups, "PACKED_SETS", 4)
    called = []
    whole = groups._pairs_by_blocks
    monkeypatch.setattr(groups, "_pairs_by_blocks", lambda *args: called.append(1) or whole(*args))
    monkeypatch.setattr(groups, "WORDS_A_PAIR", 10**9)
    distinct = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "rep int, bits array<int>")
    found = groups.tanimoto_pairs(distinct, threshold).collect()
    assert called and len(found) == len(want)
    assert {(r["a"], r["b"]): r["similarity"] for r in found} == want
    monkeypatch.setattr(groups, "WORDS_A_PAIR", 0)
    assert {(r["a"], r["b"]): r["similarity"] for r in groups.tanimoto_pairs(distinct, threshold).collect()} == want
    assert len(called) == 1


@pytest.mark.parametrize("left_over", [0, 8])
def test_dense_sets_are_clustered_without_writing_their_pairs(spark, monkeypatch, left_over):
    """Most pairs are similar: rounds walk through packed sets, and only pairs among the nodes left over are looked for."""
    rows = [*random_sets(random.Random(5), 150, 10), (500, []), (501, [])]
    df = spark.createDataFrame(rows, "id int, bits array<int>")
    hashes = {r["id"]: r["h"] for r in df.select("id", stable_hash(0, "id").alias("h")).collect()}
    asked, whole = [], groups._pairs_by_blocks
    monkeypatch.setattr(groups, "_pairs_by_blocks", lambda packed, threshold: asked.append(packed.count()) or whole(packed, threshold))
    monkeypatch.setattr(groups, "WORDS_A_PAIR", 10**9)
    monkeypatch.setattr(groups, "WALK_SETS", 16)
    monkeypatch.setattr(groups, "EDGES_A_NODE", left_over)
    monkeypatch.setattr(groups, "BLOCK_SETS", 8)
    monkeypatch.setattr(groups, "PACKED_SETS", 4)
    found = groups.cluster_sets(df, 0.3).collect()
    assert {r["id"]: r["cluster_no"] for r in found} == sequential_leaders(rows, 0.3, hashes)
    assert asked == [0] if left_over == 0 else 0 < asked[0] < 100, asked


@pytest.mark.parametrize("release", [False, True])
def test_neighbours_are_counted_once(spark, monkeypatch, release):
    """Order needs the counts twice, for the borders of its cells and for the rows; blocks are compared for them once."""
    rows = random_sets(random.Random(6), 120, 10)
    df = spark.createDataFrame([(i, "", "old" if i % 4 else "new", b) for i, b in rows], "id int, key string, release string, bits array<int>")
    plans, splits = [], groups.score_splits
    monkeypatch.setattr(groups, "score_splits", lambda df, *args: plans.append(df._jdf.queryExecution().executedPlan().toString()) or splits(df, *args))
    monkeypatch.setattr(groups, "WORDS_A_PAIR", 10**9)
    found = groups.isolated_groups(df, 0.3, "release", "old", "new") if release else groups.assign_groups(df, 0.3)
    assert found.count() == len(rows)
    assert plans and not any("MapInArrow" in plan for plan in plans)
