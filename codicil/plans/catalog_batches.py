"""Queries over batches of uploads, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.operators import batches
from codicil.plans.catalog_match import NORM, W
from codicil.plans.catalog_search import TRIGRAMS
from codicil.plans.catalog_text import KEYED
from codicil.plans.views import Views

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(build):
        QUERIES[name] = lambda spark, directory: build(Views(spark, directory))
        SQL[name] = sql
        return build

    return add


@query("plan_dates", """
with recursive rows as (
  select o_custkey as batch_id, cast(row_number() over (partition by o_custkey order by o_orderkey) as int) as place, case when o_orderkey % 5 = 0 then cast(o_orderdate as date) end as entered,
    case when o_orderkey % 3 = 0 then cast(o_orderdate as date) + 30 end as stated, cast(o_orderdate as date) as uploaded_on, row_number() over (partition by o_custkey order by o_orderkey desc) as k from orders),
steps(batch_id, place, k, effective_from, source, forced) as (
  select batch_id, place, k, coalesce(entered, stated, uploaded_on), case when entered is not null then 'entered' when stated is not null then 'detected' else 'upload_date' end, false from rows where k = 1
  union all
  select r.batch_id, r.place, r.k, case when entered is not null then entered when stated < s.effective_from then stated else s.effective_from - 1 end,
    case when entered is not null then 'entered' when stated < s.effective_from then 'detected' else 'inferred' end, entered is null and stated is not null and stated >= s.effective_from
  from steps s join rows r on r.batch_id = s.batch_id and r.k = s.k + 1)
select batch_id, place, effective_from, source, forced from steps""")
def plan_dates(v: Views) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = v.table("orders").select(F.col("o_custkey").alias("batch_id"), place.alias("place"), F.when(k % 5 == 0, day).alias("entered"), F.when(k % 3 == 0, F.date_add(day, 30)).alias("stated"), day.alias("uploaded_on"))
    return batches.plan_dates(rows)


KEY = lambda c: KEYED.replace("lower(t)", f"lower({c})")
HAS = lambda c: f"({NORM.format('u_' + c)} <> '' and {NORM.format('p_' + c)} <> '')"
SAME = lambda c: f"({HAS(c)} and {NORM.format('u_' + c)} = {NORM.format('p_' + c)})"


@query("existing_policy", f"""
with recs as (select c_custkey as policy_id, 'PN-' || (c_custkey % 700) as p_number, case when c_custkey % 2 = 0 then 'D' || c_custkey end as p_document_number, c_mktsegment || ' rules ' || (c_custkey % 90) as p_title, c_mktsegment as p_category from customer),
ups as (
  select o_orderkey as document_id, case when o_orderkey % 3 = 0 then 'pn ' || (o_custkey % 700) end as u_number, case when o_orderkey % 4 <> 0 then 'd-' || (o_custkey + o_orderkey % 2) end as u_document_number,
    case when o_orderkey % 5 = 0 then null else c_mktsegment || ' rule ' || (o_custkey % 90) end as u_title, c_mktsegment as u_category, case when o_orderkey % 7 = 0 then o_custkey end as intended_policy_id from orders join customer on c_custkey = o_custkey),
ut as (select *, {KEY("coalesce(u_title, '')")} as uk, {TRIGRAMS.format(KEY("coalesce(u_title, '')"))} as ug from ups), pt as (select *, {KEY("p_title")} as pk, {TRIGRAMS.format(KEY("p_title"))} as pg from recs),
titles as (select uk, pk, round(len(list_intersect(ug, pg))::double / len(list_distinct(ug || pg)), 6) as similarity from (select distinct uk, ug from ut where uk <> '') u, (select distinct pk, pg from pt) p),
met as (
  select document_id, policy_id, 0.0::double as similarity from ups join recs on {SAME("number")} union all select document_id, policy_id, 0.0 from ups join recs on {SAME("document_number")}
  union all select document_id, policy_id, similarity from titles t join ut using (uk) join pt using (pk) where similarity >= {batches.NAME_MATCH}),
every as (select document_id, policy_id, max(similarity) as similarity from met group by all),
best as (select e.* from every e join ups using (document_id) where intended_policy_id is null or intended_policy_id = policy_id qualify row_number() over (partition by document_id order by similarity desc, policy_id) <= {batches.CANDIDATES}),
graded as (
  select *, case when lower(u_title) = lower(p_title) then 1.0::double else round(coalesce(len(list_intersect(g, h))::double / nullif(len(list_distinct(g || h)), 0), 0), 6) end as alike
  from (select b.similarity, u.*, p.*, {TRIGRAMS.format("coalesce(u_title, '')")} as g, {TRIGRAMS.format("p_title")} as h from best b join ups u using (document_id) join recs p using (policy_id))),
scored as (
  select document_id, policy_id, round(greatest(0, least(0.99::double, case when {SAME("number")} then {W["number"]}::double when {HAS("number")} then {W["number_differs"]}::double else 0 end + {W["document"]}::double * {SAME("document_number")}::int + {W["title"]}::double * alike + {W["category"]}::double * (u_category = p_category)::int)), 3) as score,
    case when {SAME("number")} then 'policy_number' when {HAS("number")} then null when {SAME("document_number")} then 'document_number' when similarity >= {batches.NAME_MATCH} then 'title' end as reason from graded)
select * from scored where reason is not null qualify row_number() over (partition by document_id order by score desc, policy_id) = 1""")
def existing_policy(v: Views) -> DataFrame:
    c, k, o = v.table("customer"), F.col("c_custkey"), F.col("o_orderkey")
    none = lambda kind: F.lit(None).cast(kind)
    recs = c.select(k.alias("policy_id"), F.concat(F.lit("PN-"), k % 700).alias("p_number"), F.when(k % 2 == 0, F.concat(F.lit("D"), k)).alias("p_document_number"), F.concat("c_mktsegment", F.lit(" rules "), k % 90).alias("p_title"), F.col("c_mktsegment").alias("p_category"), none("string").alias("p_issuer"), none("long").alias("p_simhash"), none("array<string>").alias("p_keys"))
    ups = v.table("orders").join(c, F.col("o_custkey") == k).select(
        o.alias("document_id"), F.when(o % 3 == 0, F.concat(F.lit("pn "), k % 700)).alias("u_number"), F.when(o % 4 != 0, F.concat(F.lit("d-"), k + o % 2)).alias("u_document_number"), F.when(o % 5 != 0, F.concat("c_mktsegment", F.lit(" rule "), k % 90)).alias("u_title"),
        F.col("c_mktsegment").alias("u_category"), none("string").alias("u_issuer"), none("long").alias("u_simhash"), none("array<string>").alias("u_keys"), F.when(o % 7 == 0, k).alias("intended_policy_id"),
    )
    return batches.existing_policy(ups, recs)


@query("index_self_check", """
with chunks as (select vec_id as chunk_id, vec_id % 20 as document_id, case when vec_id % 40 = 37 then first_value(embedding) over (order by vec_id) else embedding end::double[] as vector from embeddings),
drawn as (select * from chunks where vector is not null qualify row_number() over (partition by document_id order by md5(chunk_id::varchar), chunk_id) <= 5),
near as (select d.document_id, d.chunk_id as asked, c.chunk_id, round(list_cosine_similarity(d.vector, c.vector), 6) as c from drawn d join chunks c using (document_id) where c.vector is not null),
best as (select * from near qualify row_number() over (partition by document_id, asked order by c desc, chunk_id) = 1)
select document_id, count(*) as n_sampled, count(*) filter (asked = chunk_id) as n_hits from best group by document_id""")
def index_self_check(v: Views) -> DataFrame:
    rows = v.table("embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % 20).alias("document_id"), F.col("embedding").cast("array<double>").alias("vector"))
    same = rows.orderBy("chunk_id").limit(1).select(F.col("vector").alias("copied"))
    return batches.index_self_check(rows.crossJoin(F.broadcast(same)).withColumn("vector", F.when(F.col("chunk_id") % 40 == 37, F.col("copied")).otherwise(F.col("vector"))))
