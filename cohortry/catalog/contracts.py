"""Contracts, set checks and lineage over tables with planted defects."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry import views
from cohortry.catalog.scores import rounded
from cohortry.functions.hashing import stable_hash
from cohortry.operators import contracts

h = views.h
NUMERIC = ["probability", "selected_c", "youden_threshold", "sensitivity_threshold"]


def faulty(spark, d):
    """Predictions with lost, doubled, out-of-range and relabelled rows."""
    roll = stable_hash(71, "model", "repeat", "id") % 1000
    base = views.predictions(spark, d).withColumn("roll", roll).where("roll <> 0")
    copies = F.when(F.col("roll") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        base.withColumn("copy", F.explode(copies))
        .withColumn("probability", F.when(F.col("roll") == 2, F.col("probability") + 2)
                    .when(F.col("roll") == 3, F.lit(float("nan"))).otherwise(F.col("probability")))
        .withColumn("outcome", F.when((F.col("roll") == 4) & (F.col("model") == "B"), 1 - F.col("outcome"))
                    .otherwise(F.col("outcome")))
        .withColumn("group_id", F.when((F.col("roll") == 5) & (F.col("model") == "D"), -1).otherwise(F.col("group_id")))
        .withColumn("outer_fold", F.when(F.col("roll") == 6, F.lit(None)).otherwise(F.col("outer_fold")))
        .drop("roll", "copy")
    )


FAULTY = views.PREDICTIONS + f""", rolls as (
  select *, {h('71', 'model', 'repeat', 'id')} % 1000 as roll from predictions),
faulty as (
  select id, case when roll = 5 and model = 'D' then -1 else group_id end as group_id, category,
    case when roll = 4 and model = 'B' then 1 - outcome else outcome end as outcome, release, model, repeat,
    case when roll = 6 then null else outer_fold end as outer_fold,
    case when roll = 2 then probability + 2 when roll = 3 then 'nan'::double else probability end as probability,
    youden_threshold, sensitivity_threshold, selected_c, convergence_warnings
  from rolls cross join (values (0), (1)) c(copy) where roll <> 0 and (copy = 0 or roll = 1))"""


def a8(spark, d):
    rows = views.folds(spark, d).withColumn(
        "fold", F.when(stable_hash(73, "repeat", "id") % 500 == 0, 9).otherwise(F.col("fold"))
    )
    return contracts.split_groups(rows, "group_id", "repeat", "fold")


def a8_wide(spark, d):
    """The same check from one fold column per repeat."""
    wide = views.cohort(spark, d).select(
        "id", "group_id", *[(stable_hash(23, F.lit(r), "group_id") % 5).cast("int").alias(f"fold_{r}") for r in range(views.REPEATS)]
    )
    long = contracts.long_folds(wide, ["id", "group_id"], "fold_")
    return long.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("rows"))


def a9(spark, d):
    return contracts.pairing_violations(faulty(spark, d), ["id", "repeat"], "model", ["B", "D"], "outcome", "group_id")


def a12(spark, d):
    return contracts.id_digest(views.cohort(spark, d))


def g1(spark, d):
    expected = {"F": 1, "O": 2, "X": 3}
    return contracts.count_violations(views.records(spark, d), "category", expected, 10)


def g2(spark, d):
    known = views.cohort(spark, d).where("id % 211 <> 0").select("id")
    return contracts.prediction_violations(faulty(spark, d), known, ["B", "D"], 5, "original", NUMERIC)


def g3(spark, d):
    return contracts.key_violations(views.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


TABLES = (
    "nation supplier customer part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def g4(spark, d):
    """All tables as recorded, but for a changed price, a table that is gone and one that is new."""
    marks = lambda named: contracts.concatenate([contracts.table_fingerprint(t, n) for n, t in named.items()])
    before = {n: views.table(spark, d, n) for n in TABLES}
    now = marks({**before, "region": views.table(spark, d, "region")})
    before["part"] = before["part"].withColumn(
        "p_retailprice", F.when(F.col("p_partkey") == 7, 0.0).otherwise(F.col("p_retailprice"))
    )
    before["retired"] = views.table(spark, d, "region")
    return contracts.drifted_tables(marks(before), now)


def g5(spark, d):
    """Each repeat is a run; its settings are read off its prediction rows."""
    # the smallest of strings is not a hash aggregate: it is taken from one row per repeat and model
    counted = views.predictions(spark, d).groupBy(F.col("repeat").cast("string").alias("run"), "model").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("outcome").alias("positives"), F.sum("convergence_warnings").alias("warnings")
    )
    runs = counted.groupBy("run").agg(
        *[F.sum(c).cast("string").alias(c) for c in ("rows", "positives", "warnings")], F.min("model").alias("first_model")
    )
    long = runs.unpivot(["run"], ["rows", "positives", "warnings", "first_model"], "field", "value")
    return contracts.lineage_conflicts(long)


def g6(spark, d):
    return contracts.estimation_violations(
        faulty(spark, d), ["id", "repeat"], ["B", "D"], ["probability", "youden_threshold", "sensitivity_threshold"]
    )


def fits(spark, d):
    return views.predictions(spark, d).select("model", "repeat", "outer_fold", "selected_c").distinct()


FITS = views.PREDICTIONS + """, fits as (select distinct model, repeat, outer_fold, selected_c from predictions),
counts as (select model, selected_c, count(*) as n from fits group by all),
modal as (select model, n as times_chosen, selected_c as chosen, sum(n) over (partition by model)::bigint as fits,
  row_number() over (partition by model order by n desc, selected_c) as place from counts)"""


def a3(spark, d):
    return contracts.modal_choice(fits(spark, d), ["model"], "selected_c")


def g7(spark, d):
    stored = contracts.modal_choice(fits(spark, d), ["model"], "selected_c").withColumn(
        "times_chosen", F.when(F.col("model") == "D", F.col("times_chosen") + 1).otherwise(F.col("times_chosen"))
    )
    return contracts.selection_conflicts(fits(spark, d), stored, ["model"], "selected_c")


def u1(spark, d):
    dev, upd, bad = contracts.split_cohort(views.records(spark, d), "priority", "1-URGENT", "5-LOW")
    parts = [dev.select("id", F.lit("development").alias("part")), upd.select("id", F.lit("update").alias("part")),
             bad.select("id", F.col("problem").alias("part"))]
    return contracts.concatenate(parts)


def u2(spark, d):
    full = views.cohort(spark, d)
    dev = full.where("release = 'original' and id % 97 <> 0")
    upd = full.where("release = 'added' or id % 89 = 0")
    return contracts.partition_violations(
        full.where("id % 83 <> 0"), {"development": dev, "update": upd}, "id", "release",
        {"development": "original", "update": "added"},
    )


def u3(spark, d):
    rows = views.cohort(spark, d)
    return contracts.set_diff(rows.where("id % 5 <> 0"), rows.where("id % 7 <> 0"))


def u4(spark, d):
    rows = views.cohort(spark, d).select("id")
    failed = rows.where("id % 50 = 0").unionByName(rows.where("id % 150 = 0"))
    return contracts.reconcile(rows.where("id % 61 <> 0"), rows.where("id % 50 <> 0 or id % 100 = 0"), failed)


def u5(spark, d):
    orders = views.records(spark, d).select("id", "category")
    parts = views.facts(spark, d).select("id", F.col("name").alias("category"), "outcome")
    return contracts.concatenate([orders, parts])


def j6(spark, d):
    rows = views.cohort(spark, d)
    return contracts.common_complete(
        rows.select("id", "outcome"), [rows.where("id % 5 <> 0"), rows.where("id % 7 <> 0")]
    )


def j7(spark, d):
    rows = views.cohort(spark, d)
    held = contracts.held_out_ids(rows.where("id % 5 <> 0"), rows.where("id % 7 <> 0"), rows.where("release = 'original'"))
    # against the declared update ids: an empty problem column means agreement
    declared = rows.where("release = 'added'").select("id")
    diff = contracts.set_diff(held, declared)
    return held.join(diff, "id", "full_outer")


def j8(spark, d):
    customers = views.table(spark, d, "customer").select(
        F.col("c_custkey").alias("group_id"), F.col("c_mktsegment").alias("segment")
    )
    return contracts.validated_join(views.cohort(spark, d).select("id", "group_id"), customers, ["group_id"])


def j10(spark, d):
    reference = views.folds(spark, d).select("id", "repeat", F.col("fold").alias("outer_fold"), "group_id")
    rows = faulty(spark, d).select("id", "model", "repeat", "outer_fold", "group_id")
    found = contracts.assignment_mismatches(
        rows.where("model = 'D'"), reference, ["id", "repeat"], ["outer_fold", "group_id"]
    )
    return found


def j11(spark, d):
    rows = fits(spark, d).where("not (model = 'B' and repeat = 2 and outer_fold = 3)")
    rows = rows.unionByName(rows.where("model = 'D' and outer_fold = 4"))
    return contracts.grid_gaps(
        rows, {"model": ["B", "D"], "repeat": [0, 1, 2, 3, 4, 5], "outer_fold": [0, 1, 2, 3, 4]}
    ).withColumn("rows", F.col("rows").cast("bigint"))


def a4(spark, d):
    return rounded(views.predictions(spark, d).groupBy("model", "id").agg(F.avg("probability").alias("probability")))


FIN = " and ".join(f"isfinite({c})" for c in NUMERIC)
FIN3 = " and ".join(f"isfinite({c})" for c in NUMERIC if c != "selected_c")

G2_SQL = FAULTY + f""", known as (select id from cohort where id % 211 <> 0),
keyed as (select id, model, repeat, count(*) as n from faulty group by all),
cells as (select coalesce(k.id, s.id) as id, s.cells, k.id as k from known k full join
  (select id, count(*) as cells from keyed group by id) s on k.id = s.id),
counted as (
  select 'release_wrong' as problem, count_if(release <> 'original') as violations from faulty
  union all select 'not_finite', count_if(not ({FIN})) from faulty
  union all select 'score_out_of_range', count_if(not probability between 0 and 1) from faulty
  union all select 'duplicate_key', count_if(n > 1) from keyed
  union all select 'id_missing', count_if(k is not null and cells is null) from cells
  union all select 'id_unknown', count_if(k is null) from cells
  union all select 'cells_incomplete', count_if(k is not null and cells <> 10) from cells)
select problem, violations::bigint as violations from counted where violations > 0"""

A9_BODY = """, seen as (
  select id, repeat, count(distinct model) as models, count(distinct outcome) as ys, count(distinct group_id) as gs
  from faulty group by id, repeat),
pairs as (select id, repeat, 'unpaired' as problem from seen where models < 2
  union all select id, repeat, 'outcomes_differ' from seen where ys <> 1
  union all select id, repeat, 'groups_differ' from seen where gs > 1)"""

U2_SQL = views.COHORT + """, f as (select id from cohort where id % 83 <> 0),
parts as (select id, 'd' as part, release <> 'original' as wrong from cohort where release = 'original' and id % 97 <> 0
  union all select id, 'u', release <> 'added' from cohort where release = 'added' or id % 89 = 0),
n as (select id, count(*) as n, bool_or(wrong) as wrong from parts group by id)
select id, 'overlap' as problem from n where n > 1
union all select id, 'uncovered' from f where id not in (select id from n)
union all select id, 'stranger' from n where id not in (select id from f)
union all select id, 'wrong_label' from n where wrong"""

U4_SQL = views.COHORT + """, req as (select id from cohort where id % 61 <> 0),
ok as (select id from cohort where id % 50 <> 0 or id % 100 = 0),
bad as (select id from cohort where id % 50 = 0 union all select id from cohort where id % 150 = 0),
u as (select id, 1 as q, 0 as o, 0 as b from req union all select id, 0, 1, 0 from ok union all select id, 0, 0, 1 from bad),
s as (select id, sum(q) as q, sum(o) as o, sum(b) as b from u group by id)
select id, 'not_requested' as problem from s where q = 0
union all select id, 'no_outcome' from s where o = 0 and b = 0
union all select id, 'both_outcomes' from s where o > 0 and b > 0
union all select id, 'repeated_failure' from s where b > 1"""

ENTRIES = {
    "a3_modal_choice": (a3, f"with {FITS} select model, chosen, times_chosen, fits from modal where place = 1"),
    "a4_mean_prediction": (
        a4, f"with {views.PREDICTIONS} select model, id, round(avg(probability), 6) as probability from predictions group by all"),
    "a8_split_groups": (
        a8, f"with {views.FOLD_ROWS}, moved as (select group_id, repeat, case when {h('73', 'repeat', 'id')} % 500 = 0 then 9 "
            "else fold end as fold from fold_rows) select group_id, repeat, min(fold) as lowest_fold, max(fold) as highest_fold "
            "from moved group by all having min(fold) <> max(fold)"),
    "a8_unpivot_folds": (
        a8_wide, f"with {views.FOLD_ROWS} select repeat, fold, count(*) as rows from fold_rows group by all"),
    "a9_pairing_violations": (a9, f"with {FAULTY}{A9_BODY} select * from pairs"),
    "a12_id_digest": (
        a12, f"with {views.COHORT}, hashed as (select sha256(id) as h from (select distinct id::varchar as id from cohort)), "
             "summed as (select count(*) as ids, " + ", ".join(f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::bigint) as s{i}" for i in range(4))
             + " from hashed) select ids, sha256(concat_ws(':', ids, s0, s1, s2, s3)) as digest from summed"),
    "g1_count_violations": (
        g1, f"with {views.RECORDS}, found as (select category as value, count(*) as found from records group by all "
            "union all select '(total)', count(*) from records), promised(value, expected) as "
            "(values ('F', 1::bigint), ('O', 2), ('X', 3), ('(total)', 10)) select coalesce(f.value, p.value) as value, "
            "coalesce(expected, 0) as expected, coalesce(found, 0) as found from found f full join promised p "
            "on f.value = p.value where coalesce(expected, 0) <> coalesce(found, 0)"),
    "g2_prediction_violations": (g2, f"with {G2_SQL}"),
    "g3_key_violations": (
        g3, "select l_orderkey, l_linenumber, count(*) as rows, 'duplicate' as problem from lineitem group by all having count(*) > 1"),
    "g4_drifted_tables": (
        g4, "select 'part' as table_name, count(*) as rows, count(*) as rows_now from part "
            "having count_if(p_partkey = 7 and p_retailprice <> 0) > 0 union all select 'retired', count(*), null from region "
            "union all select 'region', null, count(*) from region"),
    "g5_lineage_conflicts": (
        g5, f"with {views.PREDICTIONS}, runs as (select repeat, count(*)::varchar as rows, sum(outcome)::varchar as positives, "
            "sum(convergence_warnings)::varchar as warnings, min(model) as first_model from predictions group by repeat), "
            "long as (unpivot runs on rows, positives, warnings, first_model into name field value value) "
            "select field, count(distinct value) as distinct_values, count(distinct repeat) as runs from long group by field "
            "having count(distinct value) > 1"),
    "g6_estimation_violations": (
        g6, f"with {FAULTY}{A9_BODY}, counted as (select 'not_finite' as problem, count_if(not ({FIN3})) as violations from faulty "
            "union all select 'score_out_of_range', count_if(not probability between 0 and 1) from faulty "
            "union all select 'duplicate', count(*) from (select 1 from faulty group by id, repeat, model having count(*) > 1) "
            "union all select problem, count(*) from pairs group by problem) "
            "select problem, violations::bigint as violations from counted where violations > 0"),
    "g7_selection_conflicts": (
        g7, f"with {FITS} select model, chosen, times_chosen + 1 as times_chosen, chosen as expected_chosen, "
            "times_chosen as expected_times from modal where place = 1 and model = 'D'"),
    "u1_split_cohort": (
        u1, f"with {views.RECORDS} select id, case priority when '1-URGENT' then 'development' when '5-LOW' then 'update' "
            "else 'unknown_release' end as part from records"),
    "u2_partition_violations": (u2, f"with {U2_SQL}"),
    "u3_set_diff": (
        u3, f"with {views.COHORT} select id, case when id % 5 <> 0 then 'left' else 'right' end as only_in from cohort "
            "where (id % 5 <> 0) <> (id % 7 <> 0)"),
    "u4_reconcile": (u4, f"with {U4_SQL}"),
    "u5_concatenate": (
        u5, f"with {views.RECORDS}, {views.FACTS} select id, category, null::integer as outcome from records "
            "union all select id, name, outcome from facts"),
    "j6_common_complete": (
        j6, f"with {views.COHORT} select id, outcome from cohort where id % 5 <> 0 and id % 7 <> 0"),
    "j7_held_out_ids": (
        j7, f"with {views.COHORT} select id, case when id % 5 = 0 or id % 7 = 0 then 'right' end as only_in "
            "from cohort where release = 'added'"),
    "j8_validated_join": (
        j8, f"with {views.COHORT} select id, group_id, c_mktsegment as segment from cohort left join customer on group_id = c_custkey"),
    "j10_assignment_mismatches": (
        j10, f"with {FAULTY}, reference as (select id, repeat, cast({h('23', 'repeat', 'group_id')} % 5 as integer) as f, group_id as g "
             "from (select id, group_id, r.repeat::integer as repeat from cohort cross join range(5) r(repeat))) "
             "select id, repeat, outer_fold, group_id, f as expected_outer_fold, g as expected_group_id from faulty "
             "join reference using (id, repeat) where model = 'D' and (outer_fold is distinct from f or group_id is distinct from g)"),
    "j11_grid_gaps": (
        j11, f"with {FITS}, kept as (select * from fits where not (model = 'B' and repeat = 2 and outer_fold = 3)), "
             "doubled as (select * from kept union all select * from kept where model = 'D' and outer_fold = 4), "
             "grid as (select model, repeat::integer as repeat, outer_fold::integer as outer_fold from (values ('B'), ('D')) m(model) "
             "cross join range(6) r(repeat) cross join range(5) f(outer_fold)), "
             "n as (select g.model, g.repeat, g.outer_fold, count(d.model) as rows from grid g left join doubled d "
             "using (model, repeat, outer_fold) group by all) "
             "select *, case when rows = 0 then 'missing' else 'repeated' end as problem from n where rows <> 1"),
}
