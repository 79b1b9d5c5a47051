"""Queries over amending documents, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.operators import amendments, hybrid, timeline
from codicil.plans.catalog_core import D, day
from codicil.plans.catalog_hybrid import HYBRID, corpus
from codicil.plans.catalog_search import TRIGRAMS
from codicil.plans.catalog_text import KEYED
from codicil.plans.views import Views, pick, with_views

QUERIES, SQL = {}, {}


def query(name: str, sql: str, views: bool = True):
    def add(build):
        QUERIES[name] = lambda spark, directory: build(Views(spark, directory))
        SQL[name] = with_views(sql) if views else sql
        return build

    return add


def relations(v: Views) -> DataFrame:
    """Relations of uploads to policies: some unconfirmed, some for clauses only."""
    k = F.col("o_orderkey")
    clauses = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array((k % 7 + 1).cast("string"))).when(k % 4 == 2, F.array(F.concat(k % 7 + 1, F.lit(".2")), F.lit("3"))).otherwise(F.lit(None).cast("array<string>"))
    return v.table("orders").select(
        k.alias("source_document_id"), F.concat(F.lit("Circular "), k).alias("title"), (F.col("o_custkey") % 40 + 1).alias("policy_id"), pick(k, "AMENDS", "REPLACES", "MENTIONS", "CLARIFIES", "SUPERSEDES").alias("relation_type"),
        F.when(k % 6 == 0, "proposed").otherwise("confirmed").alias("status"), (k % 11 != 0).alias("ready"), clauses.alias("clauses"), F.to_date("o_orderdate").alias("effective_from"),
        (F.col("o_custkey") % 5).alias("organization_id"), F.when(k % 3 == 0, F.col("o_custkey") % 25).alias("branch_id"), F.col("o_custkey").alias("own_policy_id"),
    )


def items(v: Views) -> DataFrame:
    """Passages of forty policies' sections, asked for by a few users on days that some leave open."""
    own = v.versions().filter("policy_id <= 40").select("policy_id", "version_id")
    rows = v.sections().join(own, "version_id")
    n = F.col("number")
    return rows.select(
        (F.col("version_id") % 30 + 1).alias("query_id"), (F.col("version_id") % 30 + 1).alias("user_id"), (F.col("version_id") * 10 + n).alias("item_id"), F.col("version_id").alias("document_id"), "policy_id",
        F.when(n % 5 != 0, F.concat(n, F.lit("."), F.col("version_id") % 4)).alias("number"), F.when(F.col("version_id") % 2 == 0, F.lit("1998-06-15").cast("date")).alias("as_of"), F.concat(F.lit("Policy "), "policy_id").alias("policy_name"), (F.col("version_id") * 10 + n).alias("place"),
    )


RELATIONS = f"""
, relations as (
  select o_orderkey as source_document_id, 'Circular ' || o_orderkey as title, o_custkey % 40 + 1 as policy_id, ['AMENDS', 'REPLACES', 'MENTIONS', 'CLARIFIES', 'SUPERSEDES'][o_orderkey % 5 + 1] as relation_type,
    case when o_orderkey % 6 = 0 then 'proposed' else 'confirmed' end as status, o_orderkey % 11 <> 0 as ready, case o_orderkey % 4 when 0 then [] when 1 then [(o_orderkey % 7 + 1)::varchar] when 2 then [(o_orderkey % 7 + 1) || '.2', '3'] end as clauses,
    cast(o_orderdate as date) as effective_from, o_custkey % 5 as organization_id, case when o_orderkey % 3 = 0 then o_custkey % 25 end as branch_id, o_custkey as own_policy_id from orders),
items as (
  select version_id % 30 + 1 as query_id, version_id % 30 + 1 as user_id, version_id * 10 + number as item_id, version_id as document_id, policy_id, case when number % 5 <> 0 then number || '.' || (version_id % 4) end as number,
    case when version_id % 2 = 0 then date '1998-06-15' end as as_of, 'Policy ' || policy_id as policy_name, version_id * 10 + number as place from sections join versions using (version_id) where policy_id <= 40),
amending as (select * from relations where status = 'confirmed' and ready and relation_type in {amendments.AMENDING}),
touched as (
  select distinct query_id, user_id, item_id, r.* from items i join amending r using (policy_id)
  where (i.as_of is null or r.effective_from <= i.as_of) and (clauses is null or len(clauses) = 0 or len(list_filter(clauses, lambda c: i.number = c or starts_with(i.number, c || '.'))) > 0)),
attached as (select distinct query_id, item_id, source_document_id, title, relation_type, effective_from from touched)"""


@query("attach_amendments", f"{RELATIONS} select * from attached")
def attach_amendments(v: Views) -> DataFrame:
    return amendments.attach_amendments(items(v), relations(v))


@query("attach_visible_amendments", f"""{RELATIONS}
select distinct query_id, item_id, source_document_id, title, relation_type, effective_from from touched t join principals p on p.user_id = t.user_id
where t.organization_id = p.organization_id and (p.role = 'admin' or t.branch_id is null or t.branch_id = p.branch_id)
  and (p.role <> 'user' or exists (select 1 from assignments a where a.user_id = t.user_id and a.policy_id = t.own_policy_id))""")
def attach_visible_amendments(v: Views) -> DataFrame:
    return amendments.attach_amendments(items(v), relations(v), v.principals(), v.assignments())


@query("amended_conflicts", f"""{RELATIONS},
lasts as (select query_id, document_id, max(item_id) as amending_id from items group by all),
rows as (
  select a.*, i.place, policy_name, number, amending_id from attached a join items i using (query_id, item_id) left join lasts l on l.query_id = a.query_id and l.document_id = a.source_document_id
  qualify row_number() over (partition by a.query_id, least(a.item_id, amending_id), greatest(a.item_id, amending_id) order by i.place, a.effective_from, source_document_id, relation_type) = 1)
select query_id, cast(row_number() over (partition by query_id order by place, effective_from, source_document_id, relation_type) as int) as n, item_id, amending_id,
  regexp_replace(policy_name || ' section ' || coalesce(number, '') || ' is ' || lower(relation_type) || ' by ''' || title || ''' (effective ' || strftime(effective_from, '%Y-%m-%d') || ').', '  +', ' ', 'g') as description
from rows qualify n <= {amendments.MOST_CONFLICTS}""")
def amended_conflicts(v: Views) -> DataFrame:
    found = items(v)
    return amendments.amended_conflicts(found, amendments.attach_amendments(found, relations(v)))


KEY = lambda c: KEYED.replace("lower(t)", f"lower({c})")


@query("amendment_targets", f"""
, refs as (
  select o_orderkey as ref_id, case o_orderkey % 3 when 0 then 'PN-' || o_custkey when 1 then 'the ' || c_mktsegment || ' Guide ' || (o_custkey % 60) else 'Guide' end as target, case when o_orderkey % 5 <> 0 then cast(o_orderdate as date) end as effective_date from orders join customer on c_custkey = o_custkey),
named as (select policy_id, 'PN-' || policy_id as number, {KEY("category || ' guide ' || (policy_id % 60)")} as title from policies),
keyed as (select ref_id, upper(trim(target)) as number, {KEY("target")} as title, coalesce(effective_date, {D}) as day from refs),
grams as (select title, {TRIGRAMS.format("title")} as g from (select title from named union select title from keyed)),
alike as (select a.title as x, b.title as y, round(len(list_intersect(a.g, b.g))::double / len(list_distinct(a.g || b.g)), 6) as similarity from grams a, grams b where a.title in (select title from keyed) and b.title in (select title from named)),
firsts as (select title, min(policy_id) as policy_id from named group by title),
met as (
  select ref_id, f.policy_id, similarity from keyed k join alike on x = k.title and similarity >= {amendments.LEAST_ALIKE} join firsts f on f.title = y where k.title <> ''
  union all select ref_id, n.policy_id, case when similarity >= {amendments.LEAST_ALIKE} then similarity else 0 end from keyed k join named n using (number) join alike on x = k.title and y = n.title where k.title <> ''),
best as (select * from met qualify row_number() over (partition by ref_id order by similarity desc, policy_id) = 1)
select b.ref_id, b.policy_id, t.version_id, round(similarity, 2) as confidence from best b join keyed k using (ref_id) left join timeline t on t.policy_id = b.policy_id and t.effective_from <= k.day and (t.effective_to is null or t.effective_to > k.day)""")
def amendment_targets(v: Views) -> DataFrame:
    k = F.col("o_orderkey")
    people = v.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    target = F.when(k % 3 == 0, F.concat(F.lit("PN-"), "o_custkey")).when(k % 3 == 1, F.concat(F.lit("the "), "c_mktsegment", F.lit(" Guide "), F.col("o_custkey") % 60)).otherwise("Guide")
    refs = v.table("orders").join(people, "o_custkey").select(k.alias("ref_id"), target.alias("target"), F.when(k % 5 != 0, F.to_date("o_orderdate")).alias("effective_date"))
    named = v.policies().select("policy_id", F.concat(F.lit("PN-"), "policy_id").alias("number"), F.concat("category", F.lit(" guide "), F.col("policy_id") % 60).alias("name"))
    return amendments.amendment_targets(refs, named, timeline.build_timeline(v.versions()), day())


@query("amendment_candidates", f"""with {HYBRID},
changes as (select doc_id as document_id, doc_id * 7 % greatest(1, (select count(*) // 4 from documents)) as policy_id from documents where doc_id % 9 = 0),
wanted as (
  select distinct k.query_id, c.document_id from (select query_id, policy_id from keyword where rank <= 8) k join changes c using (policy_id)
  where not exists (select 1 from keyword x where x.rank <= 8 and x.query_id = k.query_id and x.document_id = c.document_id)),
cut as (select * from wanted qualify row_number() over (partition by query_id order by document_id) <= {amendments.MOST_DOCUMENTS}),
near as (
  select p.query_id, p.chunk_id, p.document_id, p.policy_id, w.whole as words, round(coalesce(list_cosine_similarity(q.vector, c.vector), 0), 6) as alike
  from cut join permitted p using (query_id, document_id) join chunks c using (chunk_id) join plans q on q.query_id = p.query_id left join scored w on w.query_id = p.query_id and w.chunk_id = p.chunk_id),
fused as (
  select *, round(case when words is null then 0 else 1.0::double / (60 + row_number() over (partition by query_id order by words desc nulls last, chunk_id)) end + 1.0::double / (60 + row_number() over (partition by query_id order by alike desc, chunk_id)), 7) as fused from near)
select query_id, chunk_id, document_id, policy_id, fused from fused qualify row_number() over (partition by query_id, document_id order by fused desc, chunk_id) = 1""", False)
def amendment_candidates(v: Views) -> DataFrame:
    c, _ = corpus(v)
    chosen = hybrid.keyword_lane(c).filter("rank <= 8").select("query_id", "document_id", "policy_id")
    n = v.table("documents").agg(F.greatest(F.lit(1), F.floor(F.count("*") / 4)).alias("n"))
    amending = v.table("documents").filter("doc_id % 9 = 0").crossJoin(F.broadcast(n)).select(F.col("doc_id").alias("source_document_id"), (F.col("doc_id") * 7 % F.col("n")).alias("policy_id"), F.lit("AMENDS").alias("relation_type"), F.lit("confirmed").alias("status"), F.lit(True).alias("ready"))
    return amendments.amendment_candidates(c, chosen, amending, c.today)
