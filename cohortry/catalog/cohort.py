"""Sources, text rules, name resolution, curation, sampling and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry import views
from cohortry.catalog.scores import draws_sql, rounded, whole
from cohortry.functions import text
from cohortry.functions.fixed_values import FLAG_EQUIVALENT, FLAG_METAL, FLAG_NOT_EQUIVALENT, FLAG_PEPTIDE, FLAG_SALT
from cohortry.functions.hashing import stable_hash
from cohortry.operators import contracts, curate, ordering, resample, resolve
from cohortry.sources import readers, sinks

h = views.h
TOKEN_LISTS = {"METALLIC": ["steel", "ring"], "MOVING": ["gear", "wid"], "LONG": ["rod"]}
SPELLINGS = {"1-URGENT": "urgent", "2-HIGH": "high"}
SEED = 120812


def src1(spark, d):
    """Delimited lines made of orders; pending ones lack a field, finished ones have a bad key."""
    orders = views.table(spark, d, "orders")
    key = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("X"), "o_orderkey")).otherwise(F.concat(F.lit("LT"), "o_orderkey"))
    full = F.concat_ws("\t", key, "o_custkey", "o_orderpriority", F.lit(""))
    lines = orders.select(F.when(F.col("o_orderstatus") == "P", F.concat_ws("\t", key, "o_custkey")).otherwise(full).alias("value"))
    return readers.parse_delimited(lines, ["record_id", "customer", "priority", "comment"], "LT[0-9]+")


def src2(spark, d):
    path = sinks.scratch_path(spark, "customer-csv")
    views.table(spark, d, "customer").write.option("header", True).csv(path)
    schema = "c_custkey string, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return readers.read_csv(spark, path, schema)


def src3(spark, d):
    path = sinks.scratch_path(spark, "vectors")
    sinks.write_vectors(views.vectors(spark, d), path)
    df = readers.read_vectors(spark, path, 64)
    return rounded(df.select("id", F.size("vec").alias("dimension"), F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total")), 4)


def tuning(spark, d):
    fits = views.predictions(spark, d).select("model", "repeat", "outer_fold", "selected_c").distinct()

    roll = stable_hash(79, "model", "repeat", "outer_fold", "label") % 1000
    grid = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(str(c)).alias("label")) for c in views.C_GRID]))
    return fits.select("*", grid.alias("g")).select("*", "g.*").withColumns(
        {"inner_auroc": roll / F.lit(1000.0), "convergence_warnings": F.lit(0)}
    ).drop("g", "label")


def tuning_log(spark, d):
    """The same fits as one nested record each."""
    keys = ["model", "repeat", "outer_fold", "selected_c"]
    candidate = F.struct("c", "inner_auroc", "convergence_warnings")
    return tuning(spark, d).groupBy(*keys).agg(F.collect_list(candidate).alias("candidates"))


TUNING = views.PREDICTIONS + f""", candidates as (
  select distinct model, repeat, outer_fold, selected_c, c::double as c,
    {h('79', 'model', 'repeat', 'outer_fold', 'label')} % 1000 / 1000.0::double as inner_auroc, 0 as convergence_warnings
  from predictions cross join (values {', '.join(f"({c}, '{c}')" for c in views.C_GRID)}) g(c, label))"""


def src4(spark, d):
    path = sinks.scratch_path(spark, "tuning-json")
    tuning_log(spark, d).write.json(path)
    return readers.read_tuning_log(spark, path)


def src5(spark, d):
    wanted = resolve.name_candidates(views.names(spark, d), "name", views.REMOVABLE)
    cache = views.candidates(spark, d).select(
        "query_name", F.when(F.col("title") != "PROMO", F.col("title")).alias("stored")
    )
    return resolve.cache_misses(wanted.withColumnRenamed("query", "query_name"), cache, "query_name", "stored")


def snk1(spark, d):
    path = sinks.scratch_path(spark, "records")
    summary = sinks.write_with_summary(views.records(spark, d), path, "category")
    counts = spark.read.json(f"{path}.summary").select("category", F.col("rows").cast("bigint").alias("rows"))
    return counts.withColumn("all_rows", F.lit(summary["rows"]).cast("bigint"))


def snk2(spark, d):
    path = sinks.scratch_path(spark, "vectors-out")
    sinks.write_vectors(views.vectors(spark, d), path)
    return readers.read_vectors(spark, path, 64).select("id", F.element_at("vec", -1).cast("double").alias("last_value"))


def snk3(spark, d, resamples=20):
    path = sinks.scratch_path(spark, "draws")
    draws = resample.cluster_bootstrap(
        views.predictions(spark, d), "group_id", "model", "outcome", "probability", resamples, 120900
    )
    sinks.write_draws(draws, path, "primary")
    return rounded(spark.read.parquet(path).select("analysis", "resample", "stat"))


def p1(spark, d):
    return views.records(spark, d).select("id", text.normalise(F.col("priority"), SPELLINGS).alias("priority"))


def p2(spark, d):
    """Leading text of each document's first word, where it is a whole number."""
    docs = views.table(spark, d, "documents")
    return docs.select("doc_id", text.lenient_int(F.substring_index("text", " ", 1)).alias("first_number"),
                       text.lenient_int(F.substring("source", 4, 9)).alias("source_number"))


def p3(spark, d):
    prior = F.when(F.col("priority") != "1-URGENT", F.col("priority"))
    return views.records(spark, d).select("id", text.two_way(prior, "5-LOW", "added", "original").alias("release"))


def p4(spark, d):
    return views.records(spark, d).select("id", text.binarise(F.col("category"), ["F"], ["O"]).alias("outcome"))


def p5(spark, d):
    rows = views.records(spark, d).where(F.col("outcome").isNotNull())
    return curate.population(rows, "ends", "priority", {"ends": ["1-", "5-"]}).select("id", "priority", "outcome")


def p6(spark, d):
    return resolve.name_candidates(views.names(spark, d), "name", views.REMOVABLE)


def p7(spark, d):
    c = views.candidates(spark, d)
    return c.select("candidate_id", text.same_name(F.concat(F.lit("  "), "title"), F.col("query_name")).alias("same"))


def p8(spark, d):
    part = views.table(spark, d, "part")
    blank = F.when(F.col("p_type") == "PROMO", F.lit(None)).when(F.col("p_type") == "SMALL", "").otherwise(F.col("p_type"))
    second = F.when(F.col("p_size") < 10, "").otherwise(F.col("p_brand"))
    return part.select("p_partkey", text.first_nonempty(blank, second, F.col("p_name")).alias("value"))


def p9(spark, d):
    part = views.table(spark, d, "part")
    values = F.array("p_size", F.when(F.col("p_type") != "PROMO", F.col("p_partkey")), F.lit(7))
    return part.select("p_partkey", text.joined_list(values).alias("joined"))


def p10(spark, d):
    pages = views.table(spark, d, "pages")
    return pages.select("page_id", text.before(F.col("url")).alias("scheme"))


def p11(spark, d):
    part = views.table(spark, d, "part")
    return part.select("p_partkey", text.classify_by_tokens(F.upper("p_name"), TOKEN_LISTS, "UNKNOWN").alias("code"))


def p12(spark, d):
    return curate.select_present(views.table(spark, d, "part"), ["p_brand", "p_missing", "p_partkey", "p_size"])


def decided(spark, d):
    return curate.rule_cascade(views.facts(spark, d), RULES(), curate.salt_flag())


def RULES():
    return curate.structure_rules(1090.0, 48, 8, 1000.0)


CASCADE = """case when not source_present then 1 when not parse_ok then 2 when has_metal and n_organic_fragments > 1 then 3
  when not standardise_ok then 4 when n_heavy_atoms = 0 then 5 when not has_carbon then 6
  when mol_weight > 1090 or n_heavy_atoms > 48 then 7 when n_amide_bonds >= 8 and mol_weight >= 1000 then 8 else 0 end"""
CODES = """case rule when 1 then 'STRUCTURE_UNAVAILABLE' when 2 then 'STRUCTURE_PARSE_FAILURE'
  when 3 then 'POLYMER_OR_UNRESOLVED_INORGANIC' when 4 then 'STRUCTURE_PARSE_FAILURE'
  when 5 then 'POLYMER_OR_UNRESOLVED_INORGANIC' when 6 then 'POLYMER_OR_UNRESOLVED_INORGANIC'
  when 7 then 'BIOLOGIC_OR_MACROMOLECULE' when 8 then 'BIOLOGIC_OR_MACROMOLECULE' end"""
FLAGS = f"""case when rule = 3 then '{FLAG_METAL}' when rule = 8 then '{FLAG_PEPTIDE}' when rule > 0 then null
  when multi_component then '{FLAG_SALT}' else '' end"""
DECIDED = views.FACTS + f""", ruled as (select *, {CASCADE} as rule from facts),
decided as (select *, rule = 0 as eligibility, {CODES} as exclusion_code, {FLAGS} as curation_flags from ruled)"""


def p13(spark, d):
    return curate.blind_view(decided(spark, d), ["id", "parent_key"])


def p14(spark, d):
    return curate.with_review_columns(views.records(spark, d).select("id", "category"), "id")


def raw_paths(spark, d):
    """Page addresses as paths: some safe, some absolute, some with empty segments or mixed slashes."""
    pages = views.table(spark, d, "pages")
    tail = F.regexp_replace("url", "^https?://", "")
    host = F.split_part(tail, F.lit("/"), F.lit(1))
    path = F.regexp_replace(tail, "^[^/]*/", "")
    shaped = (
        F.when(F.startswith(F.col("url"), F.lit("https://m.")), F.concat(F.lit("/"), path))
        .when(F.startswith(F.col("url"), F.lit("https")), F.replace(path, F.lit("/"), F.lit("\\")))
        .when(host.contains("blog"), F.concat(F.lit("C:\\"), path))
        .otherwise(path)
    )
    return pages.select(shaped.alias("path"))


RAW_PATHS = """split as (select url, regexp_replace(url, '^https?://', '') as tail from pages),
paths as (select case when url like 'https://m.%' then '/'||regexp_replace(tail, '^[^/]*/', '')
    when url like 'https%' then replace(regexp_replace(tail, '^[^/]*/', ''), '/', chr(92))
    when split_part(tail, '/', 1) like '%blog%' then 'C:'||chr(92)||regexp_replace(tail, '^[^/]*/', '')
    else regexp_replace(tail, '^[^/]*/', '') end as path from split),
judged as (select path, replace(path, chr(92), '/') as canonical, case when path = '' then 'empty'
    when regexp_matches(replace(path, chr(92), '/'), '^[A-Za-z]:') then 'drive'
    when starts_with(replace(path, chr(92), '/'), '/') then 'absolute'
    when len([x for x in string_split(replace(path, chr(92), '/'), '/') if x in ('', '.', '..')]) > 0 then 'segment' end as problem
  from paths),
clash as (select canonical from judged where problem is null group by canonical having count(distinct path) > 1)"""


def p15(spark, d):
    ok, rejects = curate.canonical_paths(raw_paths(spark, d), "path")
    return contracts.concatenate([ok, rejects]).select("path", "canonical", "problem")


def p18(spark, d):
    docs = views.table(spark, d, "documents")
    return docs.where(text.matches_search("  SRC1 ", ["source", "lang"])).select("doc_id", "source", "lang")


def adjudicated(spark, d):
    queries = resolve.name_candidates(views.names(spark, d), "name", views.REMOVABLE).select("query")
    return resolve.adjudicate_candidates(queries, views.candidates(spark, d), payload=["payload"])


REMOVABLE_SQL = "regexp_replace(trim(name), '(?i)\\s+(" + "|".join(views.REMOVABLE) + ")$', '')"
TRIED = f"""{views.PART_NAMES}, {views.NAMES}, {views.CANDIDATES}, stripped as (select name, {REMOVABLE_SQL} as short from names),
tried as (select name, 0 as attempt, trim(name) as query, 'exact-name' as method from stripped
  union all select name, 1, short, 'salt-suffix-fallback' from stripped where lower(short) <> lower(trim(name)))"""
ADJUDICATED = TRIED + """, asked as (select lower(query) as key, min(query) as query from tried group by 1),
met as (select a.key, a.query, c.*, lower(trim(title)) = a.key as exact from asked a join candidates c on lower(trim(c.query_name)) = a.key),
sums as (select key, query, count(*) as candidate_count, count_if(exact) as exacts,
  max(candidate_id) filter (exact) as by_title, max(candidate_id) as any_id from met group by key, query),
adjudicated as (select s.key, s.query, s.candidate_count,
    case when exacts = 1 then 'exact-title-among-candidates' else 'unique-pubchem-name-result' end as adjudication,
    c.candidate_id, c.title, c.payload
  from sums s join candidates c on c.candidate_id = case when exacts = 1 then by_title else any_id end
  where exacts = 1 or s.candidate_count = 1)"""


def j1(spark, d):
    return adjudicated(spark, d)


def j1_rows(spark, d):
    queries = resolve.name_candidates(views.names(spark, d), "name", views.REMOVABLE).select("query")
    return resolve.candidate_rows(queries, views.candidates(spark, d), "query", "query_name").select("key", "candidate_id")


def j2(spark, d):
    return resolve.resolve_with_fallback(views.names(spark, d), adjudicated(spark, d), "name", views.REMOVABLE)


def active_facts(spark, d):
    """An alternative for every multi-component part; dear ones get another key."""
    key = F.when(F.col("mol_weight") > 1000, F.concat(F.lit("alt/"), "parent_key")).otherwise(F.col("parent_key"))
    return views.facts(spark, d).where("multi_component").withColumns(
        {"parent_key": key, "has_carbon": F.lit(True), "multi_component": F.lit(False)}
    )


ACTIVE = f"""active_facts as (select * replace (case when mol_weight > 1000 then 'alt/'||parent_key else parent_key end as parent_key,
  true as has_carbon, false as multi_component) from facts where multi_component),
active_ruled as (select *, {CASCADE} as rule from active_facts),
active as (select *, rule = 0 as eligibility, {CODES} as exclusion_code, {FLAGS} as curation_flags from active_ruled),
matched as (
  select e.id, coalesce(e.eligibility and a.eligibility and e.parent_key = a.parent_key, false) as used_active,
    case when used_active then a.eligibility else e.eligibility end as eligibility,
    case when used_active then a.exclusion_code else e.exclusion_code end as exclusion_code,
    case when used_active then '{FLAG_EQUIVALENT}' when a.id is not null and e.eligibility then '{FLAG_NOT_EQUIVALENT}'
      when a.id is not null then coalesce(e.curation_flags, '') else e.curation_flags end as curation_flags,
    case when used_active then a.parent_key else e.parent_key end as parent_key
  from decided e left join active a using (id))"""


def j4(spark, d):
    columns = ["id", *curate.DECISION, "parent_key"]
    active = curate.rule_cascade(active_facts(spark, d), RULES(), curate.salt_flag())
    return curate.adjudicate_equivalent(decided(spark, d).select(*columns), active.select(*columns))


def manual(spark, d):
    part = views.table(spark, d, "part").where("p_size = 50")
    return part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("MIXTURE_OR_COMBINATION: "), "p_name").alias("reason"))


def overrides(spark, d):
    """Replaced facts of the largest records, some of which are excluded as well."""
    return views.facts(spark, d).where("n_heavy_atoms >= 49").withColumns(
        {"n_heavy_atoms": F.lit(10), "parent_key": F.concat(F.lit("override/"), "parent_key")}
    )


def j3(spark, d):
    """Both manual tables beside every record, exclusion before replacement."""
    return curate.override_lookup(views.facts(spark, d).select("id"), manual(spark, d), overrides(spark, d), RULES())


def curated(spark, d):
    facts = views.facts(spark, d)
    records = facts.select(
        "id", "name", "outcome", F.when(F.col("n_heavy_atoms") <= 5, "unresolved").otherwise("resolved").alias("identity_status"),
        F.when(F.col("mol_weight") > 1000, "added").otherwise("original").alias("release"),
    )
    return curate.curate(records, facts, active_facts(spark, d), manual(spark, d), overrides(spark, d), TOKEN_LISTS, "IDENTITY_UNRESOLVED", RULES())


OVERRIDDEN = views.FACTS + f""", override_facts as (select * replace (10 as n_heavy_atoms, 'override/'||parent_key as parent_key)
  from facts where n_heavy_atoms >= 49), override_ruled as (select *, {CASCADE} as rule from override_facts),
overridden as (select *, rule = 0 as eligibility, {CODES} as exclusion_code from override_ruled)"""


CURATED = DECIDED + ", " + ACTIVE + f""", override_facts as (select * replace (10 as n_heavy_atoms, 'override/'||parent_key as parent_key)
  from facts where n_heavy_atoms >= 49), override_ruled as (select *, {CASCADE} as rule from override_facts),
overridden as (select *, rule = 0 as eligibility, {CODES} as exclusion_code from override_ruled),
curated as (
  select f.id, f.name, f.outcome, case when f.n_heavy_atoms <= 5 then 'unresolved' else 'resolved' end as identity_status,
    case when f.mol_weight > 1000 then 'added' else 'original' end as release,
    case when f.n_heavy_atoms = 50 then false when o.id is not null then o.eligibility when f.n_heavy_atoms <= 5 then false
      else m.eligibility end as eligibility,
    case when f.n_heavy_atoms = 50 then 'MIXTURE_OR_COMBINATION' when o.id is not null then o.exclusion_code
      when f.n_heavy_atoms <= 5 then case when regexp_matches(f.name, 'steel|ring') then 'METALLIC'
        when regexp_matches(f.name, 'gear|wid') then 'MOVING' when regexp_matches(f.name, 'rod') then 'LONG' else 'IDENTITY_UNRESOLVED' end
      else m.exclusion_code end as exclusion_code,
    case when f.n_heavy_atoms = 50 then 'MANUAL_REVIEW:MIXTURE_OR_COMBINATION: '||f.name
      when o.id is not null then 'MANUAL_ACTIVE_MOIETY_OVERRIDE' when f.n_heavy_atoms <= 5 then null else m.curation_flags end as curation_flags,
    case when f.n_heavy_atoms = 50 then null when o.id is not null then o.parent_key when f.n_heavy_atoms <= 5 then null
      else m.parent_key end as parent_key
  from facts f join matched m using (id) left join overridden o using (id)),
keyed as (select *, case when eligibility then parent_key end as k from curated),
spans as (select *, count(*) over (partition by k) as n, min(outcome) over (partition by k) as y0,
  max(outcome) over (partition by k) as y1, min(id) over (partition by k) as keeper from keyed),
settled as (select id, name, outcome, identity_status, release, curation_flags, parent_key,
  eligibility and not (k is not null and n > 1 and (y0 is distinct from y1 or id <> keeper)) as eligibility,
  case when k is not null and n > 1 and y0 is distinct from y1 then 'DUPLICATE_LABEL_CONFLICT'
    when k is not null and n > 1 and id <> keeper then 'DUPLICATE_PARENT' else exclusion_code end as exclusion_code
  from spans)"""


def c1(spark, d):
    return decided(spark, d).select("id", *curate.DECISION)


def c2(spark, d):
    return curated(spark, d)


def c3(spark, d):
    base = views.facts(spark, d).select("id", "name", "outcome", "parent_key")
    decisions = decided(spark, d).select(
        "id", "eligibility", F.when(F.col("eligibility"), F.concat(F.lit("kept/"), "parent_key")).alias("parent_key")
    )
    return curate.overlay(base, decisions)


def settled(spark, d):
    return curate.resolve_duplicates(curated(spark, d))


def w6(spark, d):
    return settled(spark, d)


def c4(spark, d):
    return curate.study_flow(settled(spark, d), "release", "outcome", "parent_key")


def s1(spark, d):
    return views.records(spark, d).select("id", "category").orderBy("id")


def s2(spark, d):
    return ordering.hash_sample(views.records(spark, d), 0.1, SEED).select("id", "category")


def s4(spark, d):
    """Records under two orders of the input: a hash sample must not differ, a column that shows the partitions must."""
    records = views.records(spark, d).select("id").repartition(3)
    sampled = ordering.order_differences(lambda rows: ordering.hash_sample(rows, 0.1, SEED), records)
    shown = ordering.order_differences(lambda rows: rows.withColumn("tasks", F.lit(rows.rdd.getNumPartitions())), records)
    return sampled.withColumn("tasks", F.lit(0)).unionByName(shown)


def s5(spark, d):
    out, routine, counts = ordering.review_packets(settled(spark, d), 0.1, SEED, "id", ["id", "absent", "exclusion_code"])
    tag = lambda df, name: df.select("id", "exclusion_code", F.lit(name).alias("packet"))
    totals = counts.select(F.col("sample_rows").alias("id"), F.lit("sample_rows").alias("exclusion_code"), F.lit("manifest").alias("packet"))
    return contracts.concatenate([tag(out, "exclusion"), tag(routine, "inclusion"), totals])


def w7(spark, d):
    return ordering.integer_islands(views.kept_ids(spark, d))


def w7_holes(spark, d):
    return ordering.integer_holes(views.kept_ids(spark, d))


def w8(spark, d):
    return ordering.groups_to_target(views.cohort(spark, d), "group_id", SEED).select(
        "group_id", "rows", F.col("upto").cast("bigint").alias("upto")
    )


def w9(spark, d):
    counts = ordering.category_counts(views.table(spark, d, "documents"), ["lang", "source"])
    return rounded(ordering.running_share(counts, "rows", ["rows", "lang", "source"]))


def a1(spark, d):
    return ordering.category_counts(views.table(spark, d, "documents"), ["lang", "source"])


def natural_cohort(spark, d):
    """Documents with labels: the natural imbalanced example, profiled by language."""
    docs = views.table(spark, d, "documents").join(views.table(spark, d, "labels"), "doc_id")
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic")
    )


KEPT = views.KEPT_IDS + ", values_once as (select distinct value from kept_ids)"
ORDERED_COUNTS = "counts as (select lang, source, count(*) as rows from documents group by all)"

ENTRIES = {
    "snk3_draw_sink_2000": (whole(snk3), None),
    "src1_noisy_delimited": (
        src1, "select 'LT'||o_orderkey as record_id, o_custkey::varchar as customer, o_orderpriority as priority, '' as comment "
              "from orders where o_orderstatus not in ('F', 'P')"),
    "src2_csv_scan": (src2, "select * replace (c_custkey::varchar as c_custkey) from customer"),
    "src3_vector_scan": (
        src3, f"with {views.VECTORS} select id, len(vec)::integer as dimension, round(list_sum([x::double for x in vec]), 4) as total from vectors"),
    "src4_tuning_log": (src4, f"with {TUNING} select model, repeat, outer_fold, selected_c, c, inner_auroc, convergence_warnings from candidates"),
    "src5_cache_misses": (
        src5, f"with {TRIED} select distinct lower(query) as key from tried where lower(query) not in "
              "(select lower(trim(query_name)) from candidates where title <> 'PROMO')"),
    "snk1_table_with_summary": (
        snk1, "select o_orderstatus as category, count(*) as rows, (select count(*) from orders) as all_rows from orders group by 1"),
    "snk2_vector_sink": (snk2, "select vec_id as id, embedding[-1]::double as last_value from embeddings"),
    "snk3_draw_sink": (
        snk3, f"with {views.PREDICTIONS}" + draws_sql("predictions", True, 120900, 20)
              + " select 'primary' as analysis, resample, round(delta, 6) as stat from draws"),
    "p1_spelling": (
        p1, f"with {views.RECORDS} select id, case priority when '1-URGENT' then 'urgent' when '2-HIGH' then 'high' else priority end as priority from records"),
    "p2_lenient_int": (
        p2, "select doc_id, try_cast(trim(split_part(text, ' ', 1)) as bigint) as first_number, "
            "try_cast(trim(substr(source, 4, 9)) as bigint) as source_number from documents"),
    "p3_two_way_group": (p3, f"with {views.RECORDS} select id, release from records"),
    "p4_binary_outcome": (p4, f"with {views.RECORDS} select id, outcome from records"),
    "p5_population": (
        p5, f"with {views.COHORT} select id, priority, outcome from cohort where priority like '1-%' or priority like '5-%'"),
    "p6_name_candidates": (p6, f"with {TRIED} select * from tried"),
    "p7_folded_equality": (
        p7, f"with {views.PART_NAMES}, {views.CANDIDATES} select candidate_id, lower(trim(title)) = lower(trim(query_name)) as same from candidates"),
    "p8_first_nonempty": (
        p8, "select p_partkey, case when p_type not in ('PROMO', 'SMALL') then p_type when p_size >= 10 then p_brand else p_name end as value from part"),
    "p9_joined_list": (
        p9, "select p_partkey, p_size||'|'||(case when p_type <> 'PROMO' then p_partkey::varchar else 'None' end)||'|7' as joined from part"),
    "p10_prefix": (p10, "select page_id, split_part(url, ':', 1) as scheme from pages"),
    "p11_token_classes": (
        p11, "select p_partkey, case when regexp_matches(p_name, 'steel|ring') then 'METALLIC' when regexp_matches(p_name, 'gear|wid') "
             "then 'MOVING' when regexp_matches(p_name, 'rod') then 'LONG' else 'UNKNOWN' end as code from part"),
    "p12_evidence_columns": (p12, "select p_brand, p_partkey, p_size from part"),
    "p13_blind_view": (p13, f"with {DECIDED} select id, parent_key from decided where eligibility"),
    "p14_review_columns": (
        p14, f"with {views.RECORDS} select id, category, id as record_id, 'rules-applied-pending-independent-review' as review_status from records"),
    "p15_canonical_paths": (
        p15, f"with {RAW_PATHS} select path, canonical, coalesce(problem, case when canonical in (select canonical from clash) "
             "then 'collision' end) as problem from judged"),
    "p18_search": (p18, "select doc_id, source, lang from documents where contains(lower(source||' '||lang), 'src1')"),
    "j1_adjudicate": (
        j1, f"with {ADJUDICATED} select key, query, candidate_count, adjudication, candidate_id, title, payload from adjudicated"),
    "j1_candidate_rows": (j1_rows, f"with {ADJUDICATED} select key, candidate_id from met"),
    "j2_resolve_with_fallback": (
        j2, f"with {ADJUDICATED} select s.name, case when e.key is not null or f.key is not null then 'resolved' else 'unresolved' end as identity_status, "
            "case when e.key is not null then 'exact-name' when f.key is not null then 'salt-suffix-fallback' else 'unresolved' end as resolution_method, "
            "case when e.key is not null then trim(s.name) when f.key is not null then s.short else s.name end as query, "
            "coalesce(e.candidate_id, f.candidate_id) as candidate_id, coalesce(e.title, f.title) as title, "
            "coalesce(e.candidate_count, f.candidate_count) as candidate_count, coalesce(e.adjudication, f.adjudication) as adjudication, "
            "case when f.key is not null then s.short end as active_query, f.candidate_id as active_candidate_id, f.title as active_title "
            "from stripped s left join adjudicated e on e.key = lower(trim(s.name)) "
            "left join adjudicated f on f.key = lower(s.short) and lower(s.short) <> lower(trim(s.name))"),
    "j3_override_lookup": (
        j3, f"""with {OVERRIDDEN} select f.id, case when f.n_heavy_atoms = 50 then 'exclusion' when o.id is not null then 'override' end as decided_by,
  case when f.n_heavy_atoms = 50 then false else o.eligibility end as eligibility,
  case when f.n_heavy_atoms = 50 then 'MIXTURE_OR_COMBINATION' else o.exclusion_code end as exclusion_code,
  case when f.n_heavy_atoms = 50 then 'MANUAL_REVIEW:MIXTURE_OR_COMBINATION: '||f.name
    when o.id is not null then 'MANUAL_ACTIVE_MOIETY_OVERRIDE' end as curation_flags,
  case when f.n_heavy_atoms <> 50 then o.parent_key end as parent_key
from facts f left join overridden o using (id)"""),
    "j4_adjudicate_equivalent": (
        j4, f"with {DECIDED}, {ACTIVE} select id, eligibility, exclusion_code, curation_flags, parent_key, used_active from matched"),
    "c1_rule_cascade": (c1, f"with {DECIDED} select id, eligibility, exclusion_code, curation_flags from decided"),
    "c2_decision_precedence": (
        c2, f"with {CURATED} select id, name, outcome, identity_status, release, eligibility, exclusion_code, curation_flags, parent_key from curated"),
    "c3_overlay": (
        c3, f"with {DECIDED} select id, name, outcome, case when eligibility then 'kept/'||parent_key else parent_key end as parent_key, eligibility from decided"),
    "c4_study_flow": (
        c4, f"with {CURATED} select 'considered' as measure, 'all' as value, count(*) as rows from settled "
            "union all select case when eligibility then 'eligible' else 'excluded' end, 'all', count(*) from settled group by eligibility "
            "union all select 'excluded_by_code', exclusion_code, count(*) from settled where not eligibility group by exclusion_code "
            "union all select 'eligible_by_release', release, count(*) from settled where eligibility group by release "
            "union all select 'eligible_by_outcome', outcome::varchar, count(*) from settled where eligibility group by outcome "
            "union all select 'groups', 'all', count(distinct parent_key) from settled where eligibility "
            "union all select 'groups', release, count(distinct parent_key) from settled where eligibility group by release"),
    "w6_resolve_duplicates": (w6, f"with {CURATED} select * from settled"),
    "s1_total_sort": (s1, f"with {views.RECORDS} select id, category from records order by id"),
    "s2_hash_sample": (
        s2, f"with {views.RECORDS} select id, category from records qualify row_number() over (order by {h(str(SEED), 'id')}, id) "
            "<= greatest(1, ceil(0.1 * (select count(*) from records)))"),
    "s4_order_differences": (s4, f"with {views.RECORDS} select id, tasks::integer as tasks from records cross join (values (3), (7)) t(tasks)"),
    "s5_review_packets": (
        s5, f"with {CURATED}, eligible as (select * from settled where eligibility), size as (select greatest(1, ceil(0.1 * count(*)))::bigint as n from eligible) "
            "select id, exclusion_code, 'exclusion' as packet from settled where not eligibility union all "
            "(select id, exclusion_code, 'inclusion' from eligible qualify row_number() over "
            f"(order by {h(str(SEED), 'id')}, id) <= (select n from size)) union all select n, 'sample_rows', 'manifest' from size"),
    "w7_integer_islands": (
        w7, f"with {KEPT}, g as (select value, value - row_number() over (order by value) as k from values_once) "
            "select min(value) as start_value, max(value) as end_value, count(*) as members from g group by k"),
    "w7_integer_holes": (
        w7_holes, f"with {KEPT}, g as (select value, lead(value) over (order by value) as next from values_once) "
                  "select value + 1 as start_value, next - 1 as end_value, next - value - 1 as missing from g where next > value + 1"),
    "w8_groups_to_target": (
        w8, f"with {views.COHORT}, sizes as (select group_id, count(*) as rows from cohort group by group_id), "
            f"u as (select *, sum(rows) over (order by {h(str(SEED), 'group_id')}, group_id)::bigint as upto from sizes) "
            "select group_id, rows, upto from u where upto - rows < (select count(*) // 2 from cohort)"),
    "w9_running_share": (
        w9, f"with {ORDERED_COUNTS}, u as (select *, sum(rows) over (order by rows, lang, source) as upto, sum(rows) over () as total from counts) "
            "select lang, source, rows, round((upto - rows) / total::double, 6) as share_start, round(upto / total::double, 6) as share_end from u"),
    "a1_category_counts": (a1, "select lang, source, count(*) as rows from documents group by all"),
    "labelled_documents": (
        natural_cohort, "select lang, count(*) as rows, sum(quality)::bigint as good, sum(toxic)::bigint as toxic "
                        "from documents join labels using (doc_id) group by lang"),
}
