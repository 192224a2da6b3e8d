"""Vector quality, similarity groups and folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry import views
from cohortry.catalog.scores import rounded
from cohortry.operators import folds, groups, vectors
from cohortry.operators.ordering import hash_sample

h = views.h
THRESHOLD = 0.4
SEEDS = [120812, 120813, 120814]
MAX_TOKENS = 2100


def token_rows(spark, d):
    """Long token table: one small vector per position, masked where the word is unknown."""
    rows = views.token_rows(spark, d)
    vec = F.array(*[(F.col("token") * k % 1000 - 500) / F.lit(1000.0) for k in (7, 11, 13, 17)])
    return rows.withColumns({"mask": (F.col("token") != 0).cast("int"), "vec": vec})


def v1(spark, d):
    pooled = vectors.masked_mean_pool(token_rows(spark, d))
    return rounded(pooled.select("id", "attended", *[F.col("vec")[i].alias(f"v{i}") for i in range(4)]))


def v2(spark, d):
    ok, failures = vectors.triage_sequences(views.tokens(spark, d), MAX_TOKENS)
    kept = ok.select("id", F.lit("ok").alias("reason"), F.lit(0).alias("unknown_count"), "sequence_length")
    return kept.unionByName(failures)


def spoiled(spark, d):
    """Vectors of which some are cut short, scaled or hold a value that is not a number."""
    label = (F.col("id") + F.col("outcome")) % 17
    vec = (
        F.when(label == 1, F.slice("vec", 1, 63))
        .when(label == 2, F.transform("vec", lambda x: x * F.lit(2.0).cast("float")))
        .when(label == 3, F.concat(F.slice("vec", 1, 63), F.array(F.lit(float("nan")).cast("float"))))
        .otherwise(F.col("vec"))
    )
    return views.vectors(spark, d).withColumn("vec", vec)


SPOILED = views.VECTORS + """, spoiled as (select id, case (id + outcome) % 17 when 1 then vec[1:63]
  when 2 then [x * 2::float for x in vec] when 3 then list_append(vec[1:63], 'nan'::float) else vec end as vec from vectors),
lengths as (select *, sqrt(list_sum([x::double * x::double for x in vec])) as norm, len([x for x in vec if not isfinite(x)]) as bad from spoiled)"""


def v3(spark, d):
    return vectors.vector_violations(spoiled(spark, d), 64)


def runs(spark, d):
    base = views.vectors(spark, d).select("id", "outcome", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    step = F.when(F.col("id") % 50 == 7, 1e-3).otherwise(F.lit(1e-7) * (F.col("id") % 3))
    second = base.withColumn("vec", F.transform("vec", lambda x: x + step))
    return base, second


RUNS = views.VECTORS + """, first_run as (select id, outcome, [x::double for x in vec] as vec from vectors),
stepped as (select *, case when id % 50 = 7 then 1e-3::double else 1e-7::double * (id % 3) end as step from first_run),
second_run as (select id, outcome, [x + step for x in vec] as vec from stepped),
compared as (select coalesce(a.id, b.id) as id, a.id is not null and b.id is not null as in_both, a.vec as va, b.vec as vb
  from (select * from first_run where outcome = 1 or id < 100) a full join second_run b using (id)),
diffs as (select id, in_both, case when in_both then true end as finite,
  case when in_both then list_bool_and([abs(va[i] - vb[i]) <= 1e-5 + 1e-5 * abs(vb[i]) for i in range(1, 65)]) end as close,
  case when in_both then list_max([abs(va[i] - vb[i]) for i in range(1, 65)]) end as max_abs_diff from compared)"""


def j9(spark, d):
    first, second = runs(spark, d)
    return rounded(vectors.compare_vectors(first.where("outcome = 1 or id < 100"), second), 9)


def j9_summary(spark, d):
    first, second = runs(spark, d)
    return rounded(vectors.compare_vector_runs(first.where("outcome = 1 or id < 100"), second), 9)


def v4(spark, d):
    first, second = runs(spark, d)
    same = first.withColumn("vec", F.transform("vec", lambda x: x + 1e-7))
    return rounded(vectors.repeatability_report(first, same, second, 18), 9)


def v5(spark, d):
    first, second = runs(spark, d)
    requested = first.select("id")

    def sample(run):
        return hash_sample(run, 0.05, 78123)

    near = sample(first).withColumn("vec", F.transform("vec", lambda x: x + 1e-7))
    cases = {
        "whole": (first, near),
        "rows_lost": (first.where("id % 50 <> 7"), near),
        "drifted": (first, sample(first).withColumn("vec", F.transform("vec", lambda x: x + F.col("id") * 1e-5))),
        "sample_too_large": (first, hash_sample(first, 0.1, 78123)),
    }
    reports = [vectors.coverage_report(requested, *runs_of).withColumn("case", F.lit(name)) for name, runs_of in cases.items()]
    return rounded(reduce(DataFrame.unionByName, reports), 9)


def a13(spark, d):
    return rounded(vectors.vector_summary(spoiled(spark, d).where("not isnan(element_at(vec, -1))").withColumn("tokens", F.size("vec")), token_count="tokens"))


BLOCKS = [vectors.Block("head", 8), vectors.Block("bits", 64, continuous=False)]


def blocks(spark, d):
    base = views.vectors(spark, d)
    return {
        "head": base.select("id", F.slice("vec", 1, 8).alias("vec")),
        "bits": base.select("id", F.transform("vec", lambda x: (x > views.BIT_CUT).cast("double")).alias("vec")),
    }


def j5(spark, d):
    df = vectors.assemble_blocks(views.vectors(spark, d).select("id", "outcome"), blocks(spark, d), BLOCKS)
    total = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rounded(df.select("id", "outcome", F.size("vec").alias("width"), total.alias("weighted_sum")), 4)


def j12(spark, d):
    distinct, _ = groups.fingerprints(views.bits(spark, d))
    return rounded(groups.tanimoto_pairs(distinct, THRESHOLD))


def j12_members(spark, d):
    return groups.fingerprints(views.bits(spark, d))[1]


def v7(spark, d):
    distinct, _ = groups.fingerprints(views.bits(spark, d).where("key = ''"))
    return groups.neighbour_counts(distinct, groups.tanimoto_pairs(distinct, THRESHOLD))


def v6(spark, d):
    return groups.assign_groups(views.bits(spark, d), THRESHOLD)


def v8(spark, d):
    return groups.cluster_sets(views.bits(spark, d), 0.3)


def f3(spark, d):
    rows = views.bits(spark, d).withColumn("release", F.when(F.col("id") % 4 == 1, "added").otherwise("original"))
    return groups.isolated_groups(rows, THRESHOLD, "release", "original", "added")


def a2(spark, d):
    return groups.group_profile(views.cohort(spark, d), "group_id", ["release"])


def f1(spark, d):
    return folds.stratified_group_folds(views.cohort(spark, d), 5, SEEDS)


def f2(spark, d):
    return folds.stratified_folds(views.cohort(spark, d), 5, SEEDS)


def f1_profile(spark, d):
    return folds.fold_profile(f1(spark, d), ["repeat"])


TOKEN_SQL = views.TOKENS + """, placed as (select id, unnest(token_ids) as token from tokens),
sums as (select id, count_if(token <> 0)::bigint as attended, """ + ", ".join(
    f"sum(case when token <> 0 then (token * {k} % 1000 - 500) / 1000.0::double else 0 end) as s{i}" for i, k in enumerate((7, 11, 13, 17))
) + """ from placed group by id), means as (select id, attended, """ + ", ".join(
    f"s{i} / greatest(attended, 1) as m{i}" for i in range(4)
) + """ from sums), lengths as (select *, greatest(sqrt(m0*m0 + m1*m1 + m2*m2 + m3*m3), 1e-12) as n from means)"""


def pairs_sql(source: str, threshold: float) -> str:
    return f"""sets as (select bits, min(id) as rep, count(*) as copies from {source} group by bits),
pairs as (select a.rep as a, b.rep as b, len(list_intersect(a.bits, b.bits)) as i, len(a.bits) + len(b.bits) as s
  from sets a join sets b on a.rep < b.rep),
near as (select a, b, i / (s - i)::double as similarity from pairs where s - i > 0 and 1.0 - i / (s - i)::double <= 1.0 - {threshold}),
edges as (select a as rep, b as other from near union all select b, a from near),
counted as (select s.rep, coalesce(sum(o.copies), 0)::bigint + s.copies - 1 as neighbours
  from sets s left join edges e on e.rep = s.rep left join sets o on o.rep = e.other group by s.rep, s.copies),
visited as (select rep, row_number() over (order by neighbours desc, {h('0', 'rep')}, rep) as place from counted),
lists as (select v.place, list(o.place) filter (o.place is not null) as near_places from visited v left join edges e on e.rep = v.rep
  left join visited o on o.rep = e.other group by v.place),
walk as (with recursive w(place, taken, leads) as (
    select 0::bigint, []::bigint[], false union all
    select w.place + 1, case when list_contains(taken, w.place + 1) then taken
        else list_concat(list_append(taken, w.place + 1), coalesce(near_places, []::bigint[])) end,
      not list_contains(taken, w.place + 1)
    from w join lists l on l.place = w.place + 1)
  select place from w where leads),
led as (select place, row_number() over (order by place) - 1 as cluster_no from walk),
near_leads as (select l.place, min(w.place) as first_lead from (select place, unnest(near_places) as near from lists) l
  join walk w on w.place = l.near group by l.place),
joined as (select l.place, case when w.place is not null then l.place else n.first_lead end as to_place
  from lists l left join walk w using (place) left join near_leads n using (place)),
clusters as (select v.rep, u.rep as leader, led.cluster_no from joined j join visited v on v.place = j.place
  join visited u on u.place = j.to_place join led on led.place = j.to_place),
assigned as (select x.id, leader, cluster_no from {source} x join sets using (bits) join clusters using (rep))"""


def one_release(name: str) -> str:
    return f"""select id, group_id, '{name}' as release from (
  with keyless as (select * from rows where key = '' and release = '{name}'), {pairs_sql('keyless', THRESHOLD)}
  select id, 'acyclic:'||lpad(cluster_no::varchar, 4, '0') as group_id from assigned
  union all select id, 'scaffold:'||key from rows where key <> '' and release = '{name}')"""


def deal_sql() -> str:
    return views.COHORT + f""", sizes as (select group_id, count(*) as n, sum(outcome) as pos from cohort group by group_id),
seeded as (select *, seed from sizes cross join (values {', '.join(f'({i}, {s})' for i, s in enumerate(SEEDS))}) s(repeat, seed)),
dealt as (select group_id, repeat::integer as repeat, row_number() over (partition by repeat
    order by floor(log2(n)) desc, round(pos * 4.0::double / n) desc, {h('seed', 'group_id')}, group_id) - 1 as p from seeded),
folded as (select group_id, repeat, (case when p // 5 % 2 = 0 then p % 5 else 4 - p % 5 end)::integer as fold from dealt)"""


ENTRIES = {
    "v1_masked_mean_pool": (
        v1, f"with {TOKEN_SQL} select id, attended, " + ", ".join(f"round(m{i} / n, 6) as v{i}" for i in range(4)) + " from lengths"),
    "v2_triage": (
        v2, f"with {views.TOKENS}, c as (select id, len(token_ids)::integer as sequence_length, len([t for t in token_ids if t = 0])::integer as u from tokens) "
            f"select id, case when u > 0 then 'TOKENIZATION_FAILURE' when sequence_length > {MAX_TOKENS} then 'OVERLENGTH' else 'ok' end as reason, "
            "u as unknown_count, sequence_length from c"),
    "v3_vector_violations": (
        v3, f"with {SPOILED} select id, 'dimension' as problem from lengths where len(vec) <> 64 union all "
            "select id, 'not_finite' from lengths where bad > 0 union all "
            "select id, 'not_unit' from lengths where bad = 0 and abs(norm - 1.0) > 2e-5"),
    "j9_compare_vectors": (
        j9, f"with {RUNS} select id, in_both, finite, close, round(max_abs_diff, 9) as max_abs_diff from diffs"),
    "j9_run_summary": (
        j9_summary, f"with {RUNS} select bool_and(in_both) as same_ids, count_if(in_both)::bigint as in_both, bool_and(finite) as finite, "
                    "bool_and(close) as within_tolerance, round(max(max_abs_diff), 9) as max_abs_diff from diffs"),
    "v4_repeatability": (
        v4, f"with {RUNS} select true as same_ids, count(*) as in_both, true as finite, true as within_tolerance, "
            "round(1e-7, 9) as max_abs_diff, 'same_order' as comparison, count(*) >= 18 as passed from first_run union all "
            "select true, count(*), true, max(step) <= 1e-5, round(max(step), 9), 'reordered', max(step) <= 1e-5 from stepped"),
    "v5_coverage": (
        v5, f"""with {RUNS}, size as (select count(*) as requested, greatest(1, ceil(count(*) * 0.05::double))::bigint as asked,
  greatest(1, ceil(count(*) * 0.1::double))::bigint as large from first_run),
placed as (select *, row_number() over (order by {h('78123', 'id')}, id) as n from first_run),
repeats as (select "case", id, case when "case" = 'drifted' then [x + id * 1e-5::double for x in vec]
    when "case" = 'sample_too_large' then vec else [x + 1e-7::double for x in vec] end as again
  from placed cross join size cross join (values ('whole'), ('rows_lost'), ('drifted'), ('sample_too_large')) c("case")
  where n <= case when "case" = 'sample_too_large' then large else asked end),
pairs as (select r."case", again, case when r."case" <> 'rows_lost' or id % 50 <> 7 then vec end as vec
  from repeats r join first_run using (id)),
agreed as (select "case", count(*) as repeat_rows,
    bool_and(vec is not null and list_bool_and([abs(again[i] - vec[i]) <= 1e-5 + 1e-5 * abs(vec[i]) for i in range(1, 65)])) as within_tolerance,
    max(list_max([abs(again[i] - vec[i]) for i in range(1, 65)])) as max_abs_diff from pairs group by "case"),
lost as (select count_if(id % 50 = 7)::bigint as lost from first_run),
judged as (select *, case when "case" = 'rows_lost' then lost else 0 end as differing_ids from agreed cross join size cross join lost)
select "case", requested, requested - differing_ids as successful, differing_ids, round((requested - differing_ids) / requested::double, 9) as coverage,
  repeat_rows, within_tolerance, round(max_abs_diff, 9) as max_abs_diff,
  differing_ids = 0 and within_tolerance and repeat_rows = asked as passed from judged"""),
    "a13_vector_summary": (
        a13, f"with {SPOILED} select max(len(vec))::integer as dimension, min(len(vec)) = max(len(vec)) as one_dimension, "
             "round(min(norm), 6) as norm_min, round(max(norm), 6) as norm_max, min(len(vec))::integer as token_count_min, "
             "max(len(vec))::integer as token_count_max, count(*) as rows from lengths where bad = 0"),
    "j5_assemble_blocks": (
        j5, f"with {views.VECTORS}, w as (select id, outcome, list_concat([x::double for x in vec[1:8]], "
            f"[(x > {views.BIT_CUT}::double)::integer::double for x in vec]) as v from vectors) "
            "select id, outcome, len(v)::integer as width, round(list_sum([v[i] * i for i in range(1, 73)]), 4) as weighted_sum from w"),
    "j12_tanimoto_pairs": (
        j12, f"with {views.BITS}, {pairs_sql('bits', THRESHOLD).split('edges as')[0].rstrip().rstrip(',')} "
             "select a, b, round(similarity, 6) as similarity from near"),
    "j12_copies": (
        j12_members, f"with {views.BITS}, sets as (select bits, min(id) as rep from bits group by bits) select id, rep from bits join sets using (bits)"),
    "v7_neighbour_counts": (
        v7, f"with {views.BITS}, keyless as (select * from bits where key = ''), {pairs_sql('keyless', THRESHOLD).split('visited as')[0].rstrip().rstrip(',')} "
            "select rep, neighbours from counted"),
    "v6_assign_groups": (
        v6, f"with {views.BITS}, keyless as (select * from bits where key = ''), {pairs_sql('keyless', THRESHOLD)} "
            "select id, 'scaffold:'||key as group_id from bits where key <> '' union all "
            "select id, 'acyclic:'||lpad(cluster_no::varchar, 4, '0') from assigned"),
    "v8_leader_clusters": (
        v8, f"with {views.BITS}, {pairs_sql('bits', 0.3)} select id, leader, cluster_no from assigned"),
    "f3_isolated_groups": (
        f3, f"with {views.BITS}, rows as (select *, case when id % 4 = 1 then 'added' else 'original' end as release from bits) "
            + " union all ".join(one_release(r) for r in ("original", "added"))),
    "a2_group_profile": (
        a2, f"with {views.COHORT}, s as (select release, group_id, count(*) as n from cohort group by all) "
            "select release, sum(n)::bigint as rows, count(*) as groups, max(n) as largest_group, count_if(n = 1)::bigint as singleton_groups, "
            "coalesce(sum(n) filter (n > 1), 0)::bigint as clustered_rows from s group by release"),
    "f1_stratified_group_folds": (
        f1, f"with {deal_sql()} select id, group_id, outcome, repeat, fold from cohort join folded using (group_id)"),
    "f1_fold_profile": (
        f1_profile, f"with {deal_sql()} select repeat, fold, count(*) as rows, sum(outcome)::bigint as positives "
                    "from cohort join folded using (group_id) group by all"),
    "f2_stratified_folds": (
        f2, f"with {views.COHORT}, seeded as (select c.*, repeat::integer as repeat, seed from cohort c cross join "
            f"(values {', '.join(f'({i}, {s})' for i, s in enumerate(SEEDS))}) s(repeat, seed)) "
            f"select id, group_id, outcome, repeat, ((row_number() over (partition by repeat, outcome order by {h('seed', 'id')}, id) - 1) % 5)::integer as fold from seeded"),
}
