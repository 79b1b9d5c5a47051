"""Queries of hybrid search: questions of `benchmark` over the lines of `documents`, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.functions import dates
from codicil.functions import questions as Q
from codicil.operators import hybrid
from codicil.plans.catalog_search import TOKENS
from codicil.plans.catalog_text import MONTH, first_date
from codicil.plans.views import Views, pick

QUERIES, SQL = {}, {}
TODAY = "date '2022-06-01'"


def query(name: str, sql: str):
    def add(build):
        QUERIES[name] = lambda spark, directory: build(Views(spark, directory))
        SQL[name] = sql
        return build

    return add


def questions(v: Views) -> DataFrame:
    """Passages with an ending that names versions, days or structure; asked by a user with the same number."""
    i = F.col("item_id")
    quoted = F.concat(F.lit(' "'), F.array_join(F.slice(F.split("text", " "), 3, 4), " "), F.lit('" in 2021'))
    endings = [
        F.lit(""), F.lit(" What does version 2 say?"), F.lit(" Compare version 1.0 and v3."), F.concat(F.lit(" As of 2020-06-15, for PN-"), (i % 50).cast("string")), F.lit(" How has it changed over time?"),
        F.lit(" What changed in version 3?"), F.lit(" Compare 15 June 2020 with March 2022: see clause 3.2, chapter 4 and page 2."), F.lit(" What is new in the latest version? Credit guide 7, code BNK-12, pages 3-4."), quoted,
    ]
    vectors = v.table("embeddings").select(F.col("vec_id").alias("at"), F.col("embedding").cast("array<double>").alias("vector"))
    said = v.table("benchmark").select(i.alias("query_id"), i.alias("user_id"), (i * 3 % 500).alias("at"), F.concat("text", F.element_at(F.array(*endings), (i % 9 + 1).cast("int"))).alias("text"))
    return said.join(vectors, "at", "left").drop("at")


def library(v: Views) -> tuple[DataFrame, DataFrame]:
    """Lines of documents as chunks in their scopes, and the policies: four documents are versions of one."""
    d = v.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    i, k = F.col("i"), F.col("doc_id")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "content")).withColumn("i", F.col("p") + 1).filter("trim(content) <> ''")
    of = F.floor(k / 4)
    versions = d.select(
        of.alias("policy_id"), k.alias("version_id"), F.date_add(F.lit("2019-01-01").cast("date"), (k % 4 * 400).cast("int")).alias("effective_from"), F.lit("entered").alias("date_source"),
        F.when(k % 31 == 0, "withdrawn").otherwise("active").alias("status"), F.concat(F.lit("v"), k % 4 + 1, F.lit(".0")).alias("version_label"),
    )
    policies = d.select(of.alias("policy_id")).distinct().select("policy_id", (F.col("policy_id") % 3).alias("organization_id"), F.when(F.col("policy_id") % 5 != 0, F.col("policy_id") % 4).alias("branch_id"), F.concat(F.lit("PN-"), "policy_id").alias("number"), F.concat(F.lit("Credit Guide "), "policy_id").alias("name"))
    periods = hybrid.version_periods(versions).withColumn("document_id", F.col("version_id")).join(policies.select("policy_id", "organization_id", "branch_id"), "policy_id").select(*hybrid.SCOPE)
    vectors = v.table("embeddings").select(F.col("vec_id").alias("at"), F.col("embedding").cast("array<double>").alias("vector")).filter("at < 500")  # chunks ask for no others
    chunks = lines.select(
        (k * 1000000 + i).alias("chunk_id"), (k * 1000000 + F.floor(i / 4)).alias("section_id"), i.alias("chunk_index"), F.concat(k % 7 + 1, F.lit("."), i % 9 + 1).alias("number"), F.concat(F.lit("Chapter "), k % 7 + 1, F.lit(" > Part "), i).alias("path"),
        F.concat(F.lit("Rule BNK-"), k % 50).alias("title"), "content", (F.floor(i / 3) + 1).cast("int").alias("page_start"), (F.floor(i / 3) + 1 + F.when(i % 5 == 0, 1).otherwise(0)).cast("int").alias("page_end"), ((k * 7 + i) % 500).alias("at"), k.alias("document_id"),
    )
    return chunks.join(periods, "document_id").join(F.broadcast(vectors), "at", "left").drop("at"), policies


def corpus(v: Views) -> tuple[hybrid.Corpus, DataFrame]:
    today = F.lit("2022-06-01").cast("date")
    asked, (chunks, policies) = questions(v), library(v)
    plans = hybrid.classify_queries(asked, today).join(asked.select("query_id", "user_id", "vector"), "query_id")
    user = F.col("query_id")
    people = asked.select("user_id", (user % 3).alias("organization_id"), (user % 4).alias("branch_id"), pick(user, "admin", "manager", "user", "user").alias("role"))
    mine = people.select("user_id", (F.col("user_id") % 5).alias("r")).join(policies.select("policy_id", (F.col("policy_id") % 5).alias("r")), "r").select("user_id", "policy_id")
    return hybrid.Corpus(chunks, plans, people, mine, today), policies


quoted = lambda pattern: pattern.replace("'", "''")
says = lambda pattern: f"regexp_matches(text, '{quoted(pattern)}')"
month_end = lambda t: f"last_day(try_cast(regexp_extract({t}, '{dates.MONTH_YEAR}', 2) || '-' || lpad({MONTH.format(m=f'''regexp_extract({t}, '{dates.MONTH_YEAR}', 1)''')}::varchar, 2, '0') || '-01' as date))"
LABELS = "list_transform(({raw})[1:{n}], lambda l: regexp_replace(l, '(\\.0+)+$', ''))"
PLANS = f"""
questions as (
  select item_id as query_id, item_id as user_id, text || ['', ' What does version 2 say?', ' Compare version 1.0 and v3.', ' As of 2020-06-15, for PN-' || (item_id % 50), ' How has it changed over time?', ' What changed in version 3?',
    ' Compare 15 June 2020 with March 2022: see clause 3.2, chapter 4 and page 2.', ' What is new in the latest version? Credit guide 7, code BNK-12, pages 3-4.', ' "' || array_to_string(string_split(text, ' ')[3:6], ' ') || '" in 2021'][item_id % 9 + 1] as text,
    embedding::double[] as vector from benchmark left join embeddings on vec_id = item_id * 3 % 500),
read as (
  select *, list_distinct(regexp_extract_all(text, '{Q.VERSION_REF}', 1)) as raw_set, list_filter(regexp_extract_all(text, '{Q.VERSION_REF}', 1), lambda x, i: list_position(regexp_extract_all(text, '{Q.VERSION_REF}', 1), x) = i) as raw,
    list_filter(list_transform(regexp_extract_all(text, '{Q.ANY_DATE}'), lambda x: {first_date("x")}) || list_transform(regexp_extract_all(regexp_replace(text, '{Q.ANY_DATE}', ' ', 'g'), '{dates.MONTH_YEAR}'), lambda x: {month_end("x")}), lambda x: x is not null) as d0,
    coalesce({first_date("text")}, case when regexp_matches(text, '{dates.MONTH_YEAR}') then {month_end("text")} end,
      case when not {says(Q.YEAR_RANGE)} and {says(Q.YEAR)} then make_date(regexp_extract(text, '{Q.YEAR}', 1)::int, 12, 31) end) as day0 from questions),
dated as (select *, list_filter(d0, lambda x, i: list_position(d0, x) = i) as d1 from read),
ruled as (
  select *, case when len(raw) = 0 and not {says(Q.WHICH_PERIOD)} then case when len(d1) = 1 and {says(Q.AGAINST_NOW)} and d1[1] <> {TODAY} then d1 || [{TODAY}] else d1 end else [] end as days0, case when len(raw) = 0 then day0 end as day from dated),
plans as (
  select query_id, user_id, text, vector,
    case when len(raw) >= 2 or (len(raw) > 0 and {says(Q.COMPARE)}) or len(days0) >= 2 then 'comparison'
      when len(raw) = 0 and ({says(Q.WHEN_INTRODUCED)} or {says(Q.ACROSS)} or ({says(Q.OVER_TIME)} and not ({says(Q.COMPARE)} and {says(Q.VERSION_CONTEXT)})) or {says(Q.WHICH_PERIOD)}) then 'across_versions'
      when len(raw) = 0 and {says(Q.COMPARE)} and {says(Q.VERSION_CONTEXT)} then 'comparison' when len(raw) > 0 then 'specific_version' when day < {TODAY} then 'historical' else 'current' end as query_class,
    case when query_class in ('comparison', 'specific_version') then 'versions' when query_class = 'across_versions' then 'all' else 'as_of' end as mode,
    case when mode = 'as_of' then coalesce(day, {TODAY}) end as as_of,
    case when query_class = 'comparison' then {LABELS.format(raw="raw", n=5)} when query_class = 'specific_version' then {LABELS.format(raw="raw", n=1)} else [] end as labels,
    case when query_class = 'comparison' and len(raw) = 0 and len(days0) >= 2 then days0[1:5] else [] end as days from ruled)"""


@query("classify_queries", f"with {PLANS} select query_id, query_class, mode, as_of, array_to_string(labels, ',') as labels, array_to_string(list_transform(days, lambda d: strftime(d, '%Y-%m-%d')), ',') as days from plans")
def classify_queries(v: Views) -> DataFrame:
    found = hybrid.classify_queries(questions(v), F.lit("2022-06-01").cast("date"))
    return found.select("query_id", "query_class", "mode", "as_of", F.array_join("labels", ",").alias("labels"), F.array_join(F.transform("days", lambda d: d.cast("string")), ",").alias("days"))


live = lambda day: f"(effective_from <= {day} and (effective_to is null or effective_to > {day}))"
part = lambda weight: f"cast(sum(cast(round({weight} * tf::double / (tf::double + 1), 6) as decimal(18, 6))) as double)"
keep = lambda name, source, order, k: f"{name} as (select *, cast(row_number() over (partition by query_id order by {order} desc, chunk_id) as int) as rank from {source} qualify rank <= {k})"
BODY = "title || ' ' || content"
HYBRID = f"""{PLANS},
asked_by as (select p.*, query_id % 3 as p_org, query_id % 4 as p_branch, ['admin', 'manager', 'user', 'user'][query_id % 4 + 1] as p_role from plans p),
lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
vers as (select doc_id // 4 as policy_id, doc_id as version_id, date '2019-01-01' + (doc_id % 4 * 400)::int as effective_from, (doc_id % 4 + 1)::varchar as label from documents where doc_id % 31 <> 0),
ended as (select *, lead(effective_from) over w as effective_to, lead(label) over w as next_label from vers window w as (partition by policy_id order by effective_from, version_id)),
periods as (select *, lead(effective_to) over (partition by policy_id order by effective_from, version_id) as next_to from ended),
chunks as (
  select doc_id * 1000000 + i as chunk_id, doc_id * 1000000 + i // 4 as section_id, (doc_id % 7 + 1) || '.' || (i % 9 + 1) as number, 'Chapter ' || (doc_id % 7 + 1) || ' > Part ' || i as path, 'Rule BNK-' || (doc_id % 50) as title, content,
    i // 3 + 1 as page_start, i // 3 + 1 + case when i % 5 = 0 then 1 else 0 end as page_end, embedding::double[] as vector, doc_id as document_id, p.*, policy_id % 3 as organization_id, case when policy_id % 5 <> 0 then policy_id % 4 end as branch_id
  from lines join periods p on version_id = doc_id left join embeddings on vec_id = (doc_id * 7 + i) % 500 where trim(content) <> ''),
permitted as materialized (
  select q.query_id, c.chunk_id, c.document_id, c.policy_id from asked_by q join chunks c on c.organization_id = q.p_org
  where (q.p_role = 'admin' or c.branch_id is null or c.branch_id = q.p_branch) and (q.p_role <> 'user' or c.policy_id % 5 = q.user_id % 5)
    and case when mode = 'all' then true when mode = 'as_of' then {live("as_of")} when len(days) > 0 then len(list_filter(days, lambda d: {live("d")})) > 0
      when len(labels) > 0 then list_contains(labels, label) or (query_class = 'comparison' and len(labels) = 1 and coalesce(next_label = labels[1], false))
      else {live(TODAY)} or (coalesce(effective_to <= {TODAY}, false) and (next_to is null or next_to > {TODAY})) end),
asked as (select query_id, unnest(list_distinct({TOKENS.format("text")})) as term from plans),
posts as (
  select chunk_id, section_id, term, sum(w) as tf from (
    select chunk_id, section_id, unnest({TOKENS.format("title")}) as term, 1.0::decimal(10, 1) as w from chunks union all select chunk_id, section_id, unnest({TOKENS.format("content")}), 0.4::decimal(10, 1) from chunks)
  where term in (select term from asked) group by all),
freq as (select term, least(count(*), 20000) as df from posts group by term), total as (select count(*) as n from chunks),
placed as (select a.query_id, a.term, df, n, row_number() over (partition by query_id order by df, a.term) as k, count(*) filter (df < least(20000, n * 0.2)) over (partition by query_id) as rare from asked a join freq using (term), total),
terms as (select query_id, term, round(ln(1 + (greatest(n, df)::double - df + 0.5) / (df + 0.5)), 6) as weight from placed where n < 2000 or (k <= 10 and df < least(20000, n * 0.2)) or (rare = 0 and k <= 3)),
scored as (select query_id, chunk_id, {part("1.0::double")} as cheap, {part("weight")} as whole from posts join terms using (term) group by all),
pre as (select s.*, document_id, policy_id from scored s join permitted using (query_id, chunk_id) qualify row_number() over (partition by query_id order by cheap desc, chunk_id) <= {hybrid.PRESELECT}),
{keep("keyword", "(select query_id, chunk_id, document_id, policy_id, round(whole + cheap, 6) as score from pre)", "score", 50)},
by_section as (select query_id, section_id, term, sum(tf) as tf, any_value(weight) as weight from posts join terms using (term) group by all),
sections as (select query_id, section_id, {part("weight")} as s from by_section group by query_id, section_id qualify row_number() over (partition by query_id order by s desc, section_id) <= {hybrid.SECTIONS}),
{keep("section", f"(select s.query_id, c.chunk_id, m.document_id, m.policy_id, round(0.6 * s + 0.4 * coalesce(whole, 0), 6) as score from sections s join chunks c using (section_id) left join scored w on w.query_id = s.query_id and w.chunk_id = c.chunk_id join permitted m on m.query_id = s.query_id and m.chunk_id = c.chunk_id)", "score", 30)},
policies as (select distinct doc_id // 4 as policy_id from documents),
words as (select query_id, {TOKENS.format("text")} as t from plans),
named as (
  select query_id, policy_id from (select query_id, unnest(list_transform(regexp_extract_all(text, '{Q.IDENTIFIER}', 1), lambda x: upper(x))) as key from plans) join policies on key = 'PN-' || policy_id
  union select query_id, policy_id from (select query_id, unnest(flatten(list_transform(range(1, len(t) + 1), lambda i: [array_to_string(t[i:i + 1], ' '), array_to_string(t[i:i + 2], ' ')]))) as key from words) join policies on key = array_to_string({TOKENS.format("'Credit Guide ' || policy_id")}, ' ')),
pages as (
  select query_id, unnest(range(lo, case when hi < lo or hi - lo >= {hybrid.MOST_PAGES} then lo else hi end + 1)) as key from (
    select query_id, regexp_extract(m, '{Q.PAGE}', 1)::int as lo, coalesce(nullif(regexp_extract(m, '{Q.PAGE}', 2), '')::int, lo) as hi from (select query_id, unnest(regexp_extract_all(text, '{Q.PAGE}')) as m from plans))),
divisions as (select distinct query_id, lower(unnest(regexp_extract_all(text, '{Q.DIVISION}', 1))) as key from plans),
codes as (select distinct query_id, lower(unnest(regexp_extract_all(text, '{Q.CODE}', 1))) as key from plans),
clauses as (select distinct query_id, unnest(regexp_extract_all(text, '{Q.CLAUSE}', 1)) as key from plans),
phrases as (select distinct query_id, unnest(regexp_extract_all(text, '{Q.PHRASE}', 1)) as key from plans),
numbered as (
  select distinct chunk_id, unnest(list_transform(range(1, len(string_split(number, '.')) + 1), lambda n: array_to_string(string_split(number, '.')[1:n], '.'))
    || list_filter(regexp_extract_all(content, '(?:^|[^0-9.])(\\d{{1,2}}(?:\\.\\d{{1,3}}){{1,4}})(?:[^0-9]|$)', 1), lambda x: regexp_replace(x, '\\.\\d+$', '') = number)) as key from chunks),
hits as (
  select query_id, chunk_id, 'phrase' as kind, key from phrases join chunks on contains(lower({BODY}), lower(key))
  union all select query_id, chunk_id, 'heading', key from divisions join chunks on lower(string_split(path, ' > ')[1]) = key
  union all select query_id, chunk_id, 'division', key from divisions join (select distinct chunk_id, lower(unnest(regexp_extract_all({BODY}, '{Q.DIVISION}', 1))) as key from chunks) using (key)
  union all select distinct query_id, chunk_id, 'page', key::varchar from pages join chunks on key between page_start and page_end
  union all select query_id, chunk_id, 'code', key from codes join (select distinct chunk_id, lower(unnest(regexp_extract_all({BODY}, '{Q.CODE}', 1))) as key from chunks) using (key)
  union all select query_id, chunk_id, 'clause', key from clauses join numbered using (key)),
kept as (
  select h.*, document_id, policy_id from hits h join permitted m using (query_id, chunk_id)
  where kind <> 'clause' or query_id not in (select query_id from named) or exists (select 1 from named n where n.query_id = h.query_id and n.policy_id = m.policy_id)
  qualify row_number() over (partition by query_id, kind, key order by chunk_id) <= case kind when 'phrase' then 10 when 'heading' then 3 when 'page' then 12 when 'code' then 20 when 'division' then 8 else 10 end),
{keep("exact", "(select query_id, chunk_id, document_id, policy_id, max(case kind when 'phrase' then 2.0 when 'heading' then 1.9 when 'page' then 1.8 when 'code' then 1.8 when 'division' then 1.7 else 1.5 end)::double as score from kept group by all)", "score", 20)},
products as (select p.query_id, p.chunk_id, p.document_id, p.policy_id, round(coalesce(list_cosine_similarity(q.vector, c.vector), 0), 6) as score from permitted p join plans q using (query_id) join chunks c using (chunk_id) where q.vector is not null and c.vector is not null),
{keep("vector", "products", "score", 50)}"""
LED = f"""{HYBRID},
leads as (
  select query_id, document_id from (
    select query_id, document_id, 1.5 as w, rank from exact union all select query_id, document_id, 1.0, rank from keyword union all select query_id, document_id, 1.0, rank from vector union all select query_id, document_id, 0.6, rank from section)
  group by query_id, document_id qualify row_number() over (partition by query_id order by sum(cast(round(w::double / (60 + rank), 9) as decimal(18, 9))) desc, document_id) <= {hybrid.ROUTED}),
again as (select p.* from products p join leads using (query_id, document_id) qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 50),
{keep("routed", "(select * exclude (rank) from vector union select * from again)", "score", 50)}"""


@query("routed_vector", f"with {LED} select query_id, chunk_id, document_id, score, rank from routed")
def routed_vector(v: Views) -> DataFrame:
    c, policies = corpus(v)
    named = hybrid.referenced_policies(c.plans, policies)
    lanes = {"exact": hybrid.exact_lane(c, named), "keyword": hybrid.keyword_lane(c), "vector": hybrid.vector_lane(c), "section": hybrid.section_lane(c)}
    return hybrid.routed_vector(c, {name: hybrid.stored(lane, name) for name, lane in lanes.items()}).select("query_id", "chunk_id", "document_id", "score", "rank")


@query("referenced_policies", f"with {HYBRID} select query_id, policy_id from named")
def referenced_policies(v: Views) -> DataFrame:
    return hybrid.referenced_policies(questions(v), library(v)[1])


@query("exact_classes", f"with {HYBRID} select query_id, chunk_id, document_id, score, rank from exact")
def exact_classes(v: Views) -> DataFrame:
    c, policies = corpus(v)
    return hybrid.exact_lane(c, hybrid.referenced_policies(c.plans, policies)).select("query_id", "chunk_id", "document_id", F.col("score").cast("double").alias("score"), "rank")


@query("weighted_keyword_lane", f"with {HYBRID} select query_id, chunk_id, score, rank from keyword")
def weighted_keyword_lane(v: Views) -> DataFrame:
    return hybrid.keyword_lane(corpus(v)[0]).select("query_id", "chunk_id", "score", "rank")


@query("hybrid_search", f"""with {LED},
parts as (
  select query_id, chunk_id, document_id, policy_id, 'exact' as lane, 1.5 as w, rank from exact union all select query_id, chunk_id, document_id, policy_id, 'keyword', 1.0, rank from keyword
  union all select query_id, chunk_id, document_id, policy_id, 'vector', 1.0, rank from routed union all select query_id, chunk_id, document_id, policy_id, 'section', 0.6, rank from section),
fused as (
  select query_id, chunk_id, document_id, policy_id, sum(cast(round(w::double / (60 + rank), 9) as decimal(18, 9))) as s, max(rank) filter (lane = 'exact') as exact_rank, max(rank) filter (lane = 'keyword') as keyword_rank,
    max(rank) filter (lane = 'vector') as vector_rank, max(rank) filter (lane = 'section') as section_rank from parts group by query_id, chunk_id, document_id, policy_id),
boosted as (select f.* exclude (s), round(case when n.policy_id is not null then s * 1.3::decimal(3, 1) else s end::double, 7) as fused from fused f left join named n on n.query_id = f.query_id and n.policy_id = f.policy_id)
select *, cast(row_number() over (partition by query_id order by fused desc, chunk_id) as int) as rank from boosted qualify rank <= 60""")
def hybrid_search(v: Views) -> DataFrame:
    c, policies = corpus(v)
    return hybrid.hybrid_search(c, hybrid.referenced_policies(c.plans, policies))
