import pytest
from pyspark.sql import functions as F

from cohortry.functions import text
from cohortry.functions.fixed_values import SALT_WORDS, UNRESOLVED_DEFAULT, UNRESOLVED_TOKENS
from cohortry.operators import contracts, curate, ordering, resolve
from cohortry.operators.contracts import ContractError
from cohortry.sources import readers, sinks


def test_noisy_snapshot(spark, tmp_path):
    good = "LT1\tAspirin\tx\tlabel\tvNo-DILI-Concern\tNew"
    lines = ["# title", good, "LT2\tshort", "LTx\ta\tb\tc\td\te", good.replace("LT1", "LT3") + "\textra", "LT4\tB\t8\tl\tc\t"]
    (tmp_path / "snapshot.md").write_text("\n".join(lines))
    columns = ["record_id", "name", "severity", "section", "category", "comment"]
    df = readers.read_delimited(spark, str(tmp_path / "snapshot.md"), columns, "LT[0-9]+")
    shaped = df.select(
        "record_id", text.lenient_int(F.col("severity")).alias("severity"),
        text.two_way(F.col("comment"), "New", "added", "original").alias("release"),
    )
    assert sorted(map(tuple, shaped.collect())) == [("LT1", None, "added"), ("LT4", 8, "original")]


def test_csv_ids_stay_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n\n007,1\n")
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), "id string, n int").first()["id"] == "007"


def test_vector_length_is_enforced(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "id string, vec array<float>")
    sinks.write_vectors(df, str(tmp_path / "v"))
    assert readers.read_vectors(spark, str(tmp_path / "v")).count() == 2
    with pytest.raises(ContractError):
        readers.read_vectors(spark, str(tmp_path / "v"), 2)


def test_name_candidates(spark):
    df = spark.createDataFrame([("Amlodipine Besylate ",), ("aspirin",), ("Complex",)], "name string")
    got = resolve.name_candidates(df, "name", SALT_WORDS).select("query", "method").collect()
    assert {tuple(r) for r in got} == {
        ("Amlodipine Besylate", "exact-name"), ("Amlodipine", "salt-suffix-fallback"), ("aspirin", "exact-name"),
        ("Complex", "exact-name"),
    }


def test_adjudication(spark):
    queries = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "query string")
    candidates = spark.createDataFrame(
        [("a", " A ", 1), ("A", "other", 2), ("b", "zzz", 3), ("c", "x", 4), ("c", "y", 5)],
        "query_name string, title string, candidate_id int",
    )
    got = {r["query"]: (r["candidate_id"], r["candidate_count"], r["adjudication"]) for r in resolve.adjudicate_candidates(queries, candidates).collect()}
    assert got == {"A": (1, 2, resolve.BY_TITLE), "B": (3, 1, resolve.ONLY_ONE)}


def test_fallback_stays_beside_an_exact_hit(spark):
    names = spark.createDataFrame([("X sodium",), ("Y sodium",), ("Z",)], "name string")
    candidates = spark.createDataFrame(
        [("x sodium", "t", 1), ("x", "t", 2), ("y", "t", 3)], "query_name string, title string, candidate_id int"
    )
    tried = resolve.name_candidates(names, "name", SALT_WORDS)
    found = resolve.adjudicate_candidates(tried.select("query"), candidates)
    got = {r["name"]: r for r in resolve.resolve_with_fallback(names, found, "name", SALT_WORDS).collect()}
    assert (got["X sodium"]["candidate_id"], got["X sodium"]["active_candidate_id"]) == (1, 2)
    assert (got["Y sodium"]["resolution_method"], got["Y sodium"]["candidate_id"]) == (resolve.FALLBACK, 3)
    assert got["Z"]["identity_status"] == "unresolved"


def test_cached_null_is_asked_again(spark):
    wanted = spark.createDataFrame([("A",), ("a ",), ("B",), ("C",)], "k string")
    cache = spark.createDataFrame([("a", "hit"), ("b", None)], "k string, v string")
    assert {r[0] for r in resolve.cache_misses(wanted, cache, "k", "v").collect()} == {"b", "c"}


def test_unresolved_classes(spark):
    df = spark.createDataFrame([("Interferon beta",), ("polyplex",), ("plain",), (None,)], "name string")
    got = [r[0] for r in df.select(text.classify_by_tokens(F.col("name"), UNRESOLVED_TOKENS, UNRESOLVED_DEFAULT)).collect()]
    assert got == ["BIOLOGIC_OR_MACROMOLECULE", "POLYMER_OR_UNRESOLVED_INORGANIC", UNRESOLVED_DEFAULT, UNRESOLVED_DEFAULT]


FACTS = "id int, source_present boolean, parse_ok boolean, has_metal boolean, standardise_ok boolean, has_carbon boolean, " \
        "multi_component boolean, n_organic_fragments int, n_heavy_atoms int, n_amide_bonds int, mol_weight double, parent_key string"


def fact(id, **changes):
    row = {"id": id, "source_present": True, "parse_ok": True, "has_metal": False, "standardise_ok": True, "has_carbon": True,
           "multi_component": False, "n_organic_fragments": 1, "n_heavy_atoms": 10, "n_amide_bonds": 0, "mol_weight": 300.0,
           "parent_key": "K"}
    return tuple({**row, **changes}.values())


def test_rule_order(spark):
    rows = [
        fact(1), fact(2, source_present=False, parse_ok=False), fact(3, has_metal=True, n_organic_fragments=2, standardise_ok=False),
        fact(4, has_metal=True), fact(5, n_heavy_atoms=0, has_carbon=False), fact(6, mol_weight=2000.0, n_heavy_atoms=160),
        fact(7, mol_weight=2000.1), fact(8, n_amide_bonds=6, mol_weight=700.0), fact(9, multi_component=True),
    ]
    df = spark.createDataFrame(rows, FACTS)
    got = {r["id"]: (r["eligibility"], r["exclusion_code"], r["curation_flags"])
           for r in curate.rule_cascade(df, curate.structure_rules(), curate.salt_flag()).collect()}
    assert got[1] == got[4] == got[6] == (True, None, "")
    assert got[2] == (False, "STRUCTURE_UNAVAILABLE", None)
    assert got[3] == (False, "POLYMER_OR_UNRESOLVED_INORGANIC", "METAL_WITH_MULTIPLE_ORGANIC_FRAGMENTS")
    assert got[5] == (False, "POLYMER_OR_UNRESOLVED_INORGANIC", None)
    assert got[7] == (False, "BIOLOGIC_OR_MACROMOLECULE", None)
    assert got[8] == (False, "BIOLOGIC_OR_MACROMOLECULE", "PEPTIDE_OR_PEPTIDOMIMETIC_RULE")
    assert got[9] == (True, None, "SALT_OR_MULTICOMPONENT_SOURCE")


def test_equivalence(spark):
    exact = curate.rule_cascade(spark.createDataFrame([fact(1), fact(2), fact(3), fact(4, parse_ok=False)], FACTS), curate.structure_rules())
    active = curate.rule_cascade(spark.createDataFrame([fact(1), fact(2, parent_key="other"), fact(4)], FACTS), curate.structure_rules())
    got = {r["id"]: (r["eligibility"], r["curation_flags"], r["used_active"]) for r in curate.adjudicate_equivalent(exact, active).collect()}
    assert got[1] == (True, "PUBCHEM_ACTIVE_MOIETY_EQUIVALENCE_CONFIRMED", True)
    assert got[2] == (True, "EXACT_PRODUCT_PARENT_RETAINED_NON_EQUIVALENT_SUFFIX_FALLBACK", False)
    assert got[3] == (True, "", False)
    assert got[4] == (False, "", False)


def test_duplicates_conflict_as_a_unit(spark):
    rows = [(1, True, "A", 0), (2, True, "A", 1), (3, True, "B", 1), (4, True, "B", None), (5, False, "B", 0), (6, True, None, 1), (7, True, None, 0)]
    df = spark.createDataFrame(rows, "id int, eligibility boolean, parent_key string, outcome int").withColumn("exclusion_code", F.lit(None).cast("string"))
    got = {r["id"]: (r["eligibility"], r["exclusion_code"]) for r in curate.resolve_duplicates(df).collect()}
    assert got == {
        1: (False, "DUPLICATE_LABEL_CONFLICT"), 2: (False, "DUPLICATE_LABEL_CONFLICT"), 3: (True, None), 4: (False, "DUPLICATE_PARENT"),
        5: (False, None), 6: (True, None), 7: (True, None),
    }


def test_overlay_keeps_originals_under_null(spark):
    base = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, name string, n int")
    decisions = spark.createDataFrame([(1, "z", True), (2, None, False)], "id int, name string, ok boolean")
    assert sorted(map(tuple, curate.overlay(base, decisions).collect())) == [(1, "z", 5, True), (2, "b", 6, False)]


@pytest.mark.parametrize(
    "path, problem",
    [("", "empty"), ("C:\\x\\y", "drive"), ("c:rel", "drive"), ("/abs", "absolute"), ("\\\\host\\x", "absolute"),
     ("a/../b", "segment"), ("a//b", "segment"), ("./a", "segment"), ("a\\b", None), ("a/b.c", None)],
)
def test_paths(spark, path, problem):
    df = spark.createDataFrame([(path,)], "path string")
    ok, rejects = curate.canonical_paths(df, "path")
    assert [r["problem"] for r in rejects.collect()] == ([problem] if problem else [])
    assert ok.count() == (0 if problem else 1)


def test_path_collision(spark):
    df = spark.createDataFrame([("a\\b",), ("a/b",), ("c",), ("c",)], "path string")
    ok, rejects = curate.canonical_paths(df, "path")
    assert [r["path"] for r in ok.collect()] == ["c", "c"]
    assert {(r["path"], r["problem"]) for r in rejects.collect()} == {("a\\b", "collision"), ("a/b", "collision")}


def test_blind_view_hides_outcomes(spark):
    df = spark.createDataFrame([("b", "X", 1, True), ("a", "Y", 0, True), ("c", None, 1, False)], "id string, text string, outcome int, eligibility boolean")
    view = curate.blind_view(df, ["id", "text"])
    assert view.columns == ["id", "text"] and [r["id"] for r in view.collect()] == ["a", "b"]
    with pytest.raises(ContractError):
        curate.blind_view(df.withColumn("eligibility", F.lit(True)), ["id", "text"])


def test_unknown_population(spark):
    with pytest.raises(ValueError):
        curate.population(spark.range(1), "nobody")


def test_sample_is_exact_and_stable(spark):
    df = spark.range(1003)
    first = ordering.hash_sample(df, 0.1, 9)
    assert first.count() == 101
    ordering.assert_order_invariant(lambda d: ordering.hash_sample(d, 0.1, 9), df)
    assert ordering.hash_sample(spark.range(1), 0.05, 1).count() == 1


def test_islands_and_holes(spark):
    values = [1, 2, 3, 7, 9, 10, 10, 40]
    df = spark.createDataFrame([(v,) for v in values], "value bigint")
    assert sorted(map(tuple, ordering.integer_islands(df).collect())) == [(1, 3, 3), (7, 7, 1), (9, 10, 2), (40, 40, 1)]
    assert sorted(map(tuple, ordering.integer_holes(df).collect())) == [(4, 6, 3), (8, 8, 1), (11, 39, 29)]
    assert ordering.integer_islands(df.limit(0)).count() == 0


def test_groups_reach_the_target(spark):
    df = spark.createDataFrame([(f"g{i % 7}",) for i in range(50)], "g string")
    got = ordering.groups_to_target(df, "g", 4).orderBy("upto").collect()
    assert got[-1]["upto"] >= 25 > got[-1]["upto"] - got[-1]["rows"]


def plain_digest(ids):
    import hashlib

    hashes = [hashlib.sha256(i.encode()).hexdigest() for i in set(ids)]
    sums = [sum(int(h[15 * k : 15 * k + 15], 16) for h in hashes) for k in range(4)]
    return hashlib.sha256(":".join(map(str, [len(hashes), *sums])).encode()).hexdigest()


def test_digest_has_one_definition_for_every_size(spark):
    ids = [f"new-{i}" for i in range(300)]
    df = spark.createDataFrame([(i,) for i in [*reversed(ids), "new-7", None]], "id string")
    digest = lambda d: contracts.id_digest(d).first()["digest"]
    assert digest(df) == digest(df.repartition(5)) == plain_digest(ids)
    assert digest(df.where("id <> 'new-7'")) != digest(df)
    assert digest(df.limit(0)) == plain_digest([])
    many = spark.range(120_000).select(F.col("id").cast("string"))
    assert digest(many) == plain_digest([str(i) for i in range(120_000)])


def test_prediction_contract(spark):
    def rows(*extra):
        base = [(f"i{i}", m, r, i % 2, 0.5, 0.4, "original") for i in range(2) for m in "BD" for r in range(2)]
        return spark.createDataFrame([*base, *extra], "id string, model string, repeat int, outcome int, probability double, t double, release string")

    ids = spark.createDataFrame([("i0",), ("i1",)], "id string")
    found = lambda df: {r["problem"]: r["violations"] for r in contracts.prediction_violations(df, ids, ["B", "D"], 2, "original", ["probability", "t"]).collect()}
    assert found(rows()) == {}
    assert found(rows(("i0", "B", 0, 0, 0.5, 0.4, "original"))) == {"duplicate_key": 1}
    assert found(rows().withColumn("probability", F.when(F.col("id") == "i0", 1.2).otherwise(0.1))) == {"score_out_of_range": 4}
    assert found(rows().withColumn("t", F.lit(float("inf")))) == {"not_finite": 8}
    assert found(rows().where("not (id = 'i1' and model = 'B')")) == {"cells_incomplete": 1}
    assert found(rows().where("id <> 'i1'")) == {"id_missing": 1}
    with pytest.raises(ContractError):
        found(rows().drop("outcome"))


def test_partition_and_split(spark):
    df = spark.createDataFrame([("old-1", "o"), ("old-2", "o"), ("new-1", "n")], "id string, release string")
    dev, upd, bad = contracts.split_cohort(df, "release", "o", "n")
    assert (dev.count(), upd.count(), bad.count()) == (2, 1, 0)
    assert contracts.partition_violations(df, {"d": dev, "u": upd}, "id", "release", {"d": "o", "u": "n"}).count() == 0
    assert contracts.split_cohort(df, "release", "o", "x")[2].collect()[0]["problem"] == "unknown_release"


def test_validated_join_rejects_repeats(spark):
    left = spark.createDataFrame([(1,), (1,)], "k int")
    right = spark.createDataFrame([(1, "a")], "k int, v string")
    assert contracts.validated_join(left, right, ["k"]).count() == 2
    with pytest.raises(ContractError):
        contracts.validated_join(left, right, ["k"], "one_to_one")
    with pytest.raises(ContractError):
        contracts.validated_join(left, right.union(right), ["k"])


def test_drift(spark):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    before = contracts.table_fingerprint(df, "t")
    assert contracts.drifted_tables(before, contracts.table_fingerprint(df.repartition(5), "t")).count() == 0
    assert contracts.drifted_tables(before, contracts.table_fingerprint(df.withColumn("v", F.col("v") + 1), "t")).count() == 1
    assert contracts.drifted_tables(before, contracts.table_fingerprint(df, "u")).count() == 2


def test_write_with_summary(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id int, label string")
    summary = sinks.write_with_summary(df, str(tmp_path / "t"), "label")
    assert summary == {"rows": 3, "missing_labels": 1}
    assert {r["rows"] for r in spark.read.json(str(tmp_path / "t.summary")).collect()} == {2, 1}


def test_held_out_ids_against_the_declared_set(spark):
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    held = contracts.held_out_ids(ids("a", "b", "c", "x"), ids("a", "b", "c", "y"), ids("a"))
    assert {r["id"] for r in held.collect()} == {"b", "c"}
    assert contracts.set_diff(held, ids("b", "c")).count() == 0
    assert {tuple(r) for r in contracts.set_diff(held, ids("b", "d")).collect()} == {("c", "left"), ("d", "right")}


def test_reconciliation(spark):
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    assert contracts.reconcile(ids("a", "b"), ids("a"), ids("b")).count() == 0
    found = contracts.reconcile(ids("a", "b", "c"), ids("a", "b", "z"), ids("b"))
    assert {tuple(r) for r in found.collect()} == {("b", "both_outcomes"), ("c", "no_outcome"), ("z", "not_requested")}


def test_lineage_conflicts(spark):
    rows = [("r1", "seed", "1"), ("r2", "seed", "1"), ("r1", "model", "a"), ("r2", "model", "b"), ("r1", "only", "x")]
    df = spark.createDataFrame(rows, "run string, field string, value string")
    assert {r["field"] for r in contracts.lineage_conflicts(df).collect()} == {"model", "only"}


def test_review_packets(spark):
    df = spark.range(50).select("id", (F.col("id") % 5 != 0).alias("eligibility"), F.lit("c").alias("code"))
    out, routine, counts = ordering.review_packets(df, 0.1, 3, columns=["id", "gone", "code"])
    assert (out.count(), routine.count(), out.columns) == (10, 4, ["id", "code"])
    row = counts.first()
    assert (row["exclusion_rows"], row["inclusion_population"], row["sample_rows"]) == (10, 40, 4)


def test_names_lose_white_space_of_every_kind(spark):
    df = spark.createDataFrame([("\tBar Sodium\u00a0",), ("bar\tsodium\n",), (" STRASSE",), ("Stra\u00dfe\u2003",), ("\u03a3\u03af\u03c3\u03c5\u03c6\u03bf\u03c2",), (None,)], "name string")
    folded = [r[0] for r in df.select(text.fold(F.col("name"))).collect()]
    assert folded == ["bar sodium", "bar\tsodium", "strasse", "strasse", "\u03c3\u03af\u03c3\u03c5\u03c6\u03bf\u03c3", None]
    stripped = [r[0] for r in df.select(text.without_suffix(F.col("name"), ["sodium"])).collect()]
    assert stripped[:2] == ["Bar", "bar"]
    numbers = spark.createDataFrame([("3.0",), (" 4\t",), ("4.5",), ("1e3",), ("x",), ("9007199254740993",), (None,)], "t string")
    assert [r[0] for r in numbers.select(text.lenient_int(F.col("t"))).collect()] == [3, 4, None, 1000, None, 9007199254740993, None]


def test_null_names_meet_nothing(spark):
    queries = spark.createDataFrame([(None,), ("a\t",)], "query string")
    candidates = spark.createDataFrame([(None, None, 1), ("A", "a", 2)], "query_name string, title string, candidate_id int")
    found = resolve.adjudicate_candidates(queries, candidates)
    assert [r["candidate_id"] for r in found.collect()] == [2]
    names = spark.createDataFrame([(None,), ("A",), ("a sodium",)], "name string")
    got = {r["name"]: r["candidate_id"] for r in resolve.resolve_with_fallback(names, found, "name", ["sodium"]).collect()}
    assert got == {None: None, "A": 2, "a sodium": 2}


def test_repeated_manual_rows_are_errors(spark):
    records = spark.createDataFrame([(1, "a", "resolved")], "id int, name string, identity_status string")
    reasons = spark.createDataFrame([(1, "X: y"), (1, "X: z")], "id int, reason string")
    facts = spark.createDataFrame([], "id int")
    with pytest.raises(ContractError, match="exclusions"):
        curate.curate(records, facts, facts, reasons, facts)


def test_exclusion_comes_before_replacement(spark):
    records = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "id int")
    reasons = spark.createDataFrame([(1, "X: y"), (2, "X: z"), (3, ""), (9, "not a record")], "id int, reason string")
    facts = spark.createDataFrame([fact(2), fact(3, has_metal=True, n_organic_fragments=2)], FACTS)
    got = {r["id"]: (r["decided_by"], r["eligibility"], r["exclusion_code"]) for r in curate.override_lookup(records, reasons, facts).collect()}
    assert got[1] == got[2] == ("exclusion", False, "X")
    assert got[3][:2] == ("override", False) and got[3][2]
    assert got[4] == got[None] == (None, None, None)
    with pytest.raises(ContractError, match="overrides"):
        curate.override_lookup(records, reasons, facts.union(facts))


def test_the_settings_of_runs_are_read_off_without_sorting_predictions(spark):
    """The smallest of strings is sorted for; only one row per run and model may get there."""
    from cohortry.catalog.contracts import g5

    plan = g5(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line.split("Aggregate [", 1)[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert any("model" in keys for keys in grouped)
    first = next(line for line in reversed(plan.splitlines()) if "Aggregate [" in line)
    assert "min(" not in first
