"""Queries over differences, evidence, grades and streams, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.operators import compare, evidence, retrieval
from codicil.plans.catalog_search import POSTINGS, asked, docs
from codicil.plans.alignment import aligned_sql
from codicil.plans.views import Views, with_views
from codicil.streaming import streams

QUERIES, SQL = {}, {}
N = compare.NUMBER
PARTS = {  # what each kind sees: the content with more specific kinds blanked
    "date": "{c}",
    "amount": "regexp_replace({c}, '\\d{{4}}-\\d{{2}}-\\d{{2}}', ' ', 'g')",
}
PARTS["percent"] = f"regexp_replace({PARTS['amount']}, '(?i)\\b(?:rs\\.?|inr|rupees)\\s*(?:{N.replace('{', '{{').replace('}', '}}')})', ' ', 'g')"
PARTS["duration"] = f"regexp_replace({PARTS['percent']}, '(?:{N.replace('{', '{{').replace('}', '}}')})\\s*%', ' ', 'g')"


def facts_sql(table: str, keys: str, column: str) -> str:
    out = []
    for kind, pattern in compare.PATTERNS.items():
        found = f"regexp_extract_all({PARTS[kind].format(c=column)}, '{pattern}', 1)"
        value = "regexp_replace(regexp_replace(lower(v), ',', '', 'g'), '^(\\S+)\\s+(\\w+?)s?$', '\\1 \\2')" if kind == "duration" else "regexp_replace(v, ',', '', 'g')"
        out.append(f"select {keys}, '{kind}' as kind, {value} as value, cast(place as int) as place from (select {keys}, unnest({found}) as v, generate_subscripts({found}, 1) as place from {table})")
    return " union all ".join(out)


DIFF = f"""{aligned_sql(", whole as (select version_id, number as place, number, 1 as level, title, content from sections)")},
diff as (
  select a.old_id, a.new_id, coalesce(n.number, o.number) as number, o.title as old_title, o.content as old_content, n.title as new_title, n.content as new_content,
    case when "by" in ('added', 'removed') then "by" when o.content = n.content and o.title = n.title then 'unchanged' else 'modified' end as change
  from aligned a left join whole o on o.version_id = a.old_id and o.place = old_place left join whole n on n.version_id = a.new_id and n.place = new_place),
modified as (select * from diff where change = 'modified')"""
FACTS = f"""{DIFF},
old_facts as (select *, row_number() over (partition by old_id, new_id, number, kind, value order by place) as k from ({facts_sql("modified", "old_id, new_id, number", "old_content")})),
new_facts as (select *, row_number() over (partition by old_id, new_id, number, kind, value order by place) as k from ({facts_sql("modified", "old_id, new_id, number", "new_content")})),
gone as (select old_id, new_id, number, kind, value as old_value, row_number() over (partition by old_id, new_id, number, kind order by place) as j from old_facts anti join new_facts using (old_id, new_id, number, kind, value, k)),
come as (select old_id, new_id, number, kind, value as new_value, row_number() over (partition by old_id, new_id, number, kind order by place) as j from new_facts anti join old_facts using (old_id, new_id, number, kind, value, k)),
changes as (select old_id, new_id, number, kind, old_value, new_value from gone full join come using (old_id, new_id, number, kind, j))"""


def query(name: str, sql: str | None, views: bool = True):
    def add(build):
        QUERIES[name] = lambda spark, directory: build(Views(spark, directory))
        if sql:
            SQL[name] = with_views(sql) if views else sql
        return build

    return add


def diff(v: Views) -> DataFrame:
    return compare.compare_versions(v.sections(), compare.consecutive(v.versions()))


@query("numeric_facts", facts_sql("sections", "version_id, number", "content"))
def facts(v: Views) -> DataFrame:
    return compare.numeric_facts(v.sections(), ["version_id", "number"])


@query("compare_versions", f"{DIFF} select old_id, new_id, change, count(*) as n, min(number) as first_number from diff group by all")
def versions(v: Views) -> DataFrame:
    return diff(v).groupBy("old_id", "new_id", "change").agg(F.count("*").alias("n"), F.min("number").alias("first_number"))


@query("numeric_changes", f"{FACTS} select * from changes")
def changes(v: Views) -> DataFrame:
    return compare.numeric_changes(diff(v))


@query("summary_lines", f"""{FACTS}
select old_id, new_id, number, 'Changed: ' || number || ' ' || array_to_string(list_sort(list(kind || ' (' || coalesce(old_value, 'none') || ' → ' || coalesce(new_value, 'none') || ')')), ', ') as line from changes group by old_id, new_id, number""")
def lines(v: Views) -> DataFrame:
    return compare.summary_lines(compare.numeric_changes(diff(v)))


SENTENCES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace({c}, '([.;!?])\\s+', '\\1' || chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')"
ONLY = "array_to_string(list_filter({a}, lambda x, i: not list_contains({b}, x) and list_position({a}, x) = i)[1:4], ' | ')"


@query("changed_sentences", f"""{DIFF},
sides as (select old_id, new_id, number, {SENTENCES.format(c="old_content")} as o, {SENTENCES.format(c="new_content")} as n from modified)
select old_id, new_id, number, {ONLY.format(a="o", b="n")} as removed, {ONLY.format(a="n", b="o")} as added from sides""")
def sentences(v: Views) -> DataFrame:
    return compare.changed_sentences(diff(v))


@query("section_similarity", f"""{DIFF},
oc as (select old_id, new_id, number, ch, count(*) as o from (select old_id, new_id, number, unnest(string_split(old_content, '')) as ch from modified) group by all),
nc as (select old_id, new_id, number, ch, count(*) as n from (select old_id, new_id, number, unnest(string_split(new_content, '')) as ch from modified) group by all)
select old_id, new_id, number, round(2 * sum(least(coalesce(o, 0), coalesce(n, 0)))::double / sum(coalesce(o, 0) + coalesce(n, 0))::double, 6) as ratio
from oc full join nc using (old_id, new_id, number, ch) group by all""")
def similarity(v: Views) -> DataFrame:
    return compare.section_similarity(diff(v))


@query("version_extremes", f"""
, facts as ({facts_sql("sections", "version_id, number", "content")})
select number, min(value::double) as lowest, first(version_id order by value::double, version_id) as lowest_in, max(value::double) as highest, first(version_id order by value::double desc, version_id) as highest_in
from facts where kind = 'percent' group by number""")
def extremes(v: Views) -> DataFrame:
    return compare.version_extremes(compare.numeric_facts(v.sections(), ["version_id", "number"]), ["number"])


@query("figure_delta", f"""
, facts as ({facts_sql("sections", "version_id, number", "content")}), owned as (select f.*, o_custkey as policy_id from facts f join orders on o_orderkey = version_id where kind = 'percent' and place = 1),
d as (select policy_id, number, version_id, value::double - lag(value::double) over (partition by policy_id, number order by version_id) as delta from owned)
select *, case when delta > 0 then 'up' when delta < 0 then 'down' else 'same' end as direction from d where delta is not null""")
def delta(v: Views) -> DataFrame:
    owner = v.table("orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("policy_id"))
    found = compare.figure_delta(compare.numeric_facts(v.sections(), ["version_id", "number"]).join(owner, "version_id"), ["policy_id", "number"], "version_id")
    return found.select("policy_id", "number", "version_id", "delta", "direction")


@query("numeric_conflicts", f"""
, facts as ({facts_sql("sections", "version_id, number", "content")}), per as (select number, kind, value, count(distinct version_id) as owners from facts group by all)
select number, kind, count(*) as n_values, cast(sum(owners) as bigint) as n_owners, min(value) as first_value, max(value) as last_value from per group by all having count(*) > 1""")
def conflicts(v: Views) -> DataFrame:
    return evidence.numeric_conflicts(compare.numeric_facts(v.sections(), ["version_id", "number"]), ["number"], "version_id")


DOC_TERMS = POSTINGS + """,
sizes as (select query_id, count(*) as nq from asked group by 1), shared as (select k.query_id, k.doc_id, count(*) as c from keyword k join asked a using (query_id) join posts p on p.doc_id = k.doc_id and p.term = a.term group by all),
covered as (select k.*, round(coalesce(c, 0)::double / nq, 6) as coverage from keyword k join sizes using (query_id) left join shared using (query_id, doc_id))"""


def candidates(v: Views) -> DataFrame:
    return evidence.coverage(asked(v), docs(v), retrieval.keyword_lane(asked(v), docs(v)))


@query("coverage_blend", f"with {DOC_TERMS} select query_id, doc_id, rank, coverage, round(0.5 * coverage + 0.5 * score / max(score) over (partition by query_id), 6) as blended from covered", False)
def blended(v: Views) -> DataFrame:
    return evidence.blend(candidates(v)).select("query_id", "doc_id", "rank", "coverage", "blended")


@query("evidence_gate", f"""with {DOC_TERMS}, per as (select query_id, count(doc_id) as n_items, max(score) as best, max(coverage) as covered from covered group by 1)
select *, case when n_items = 0 then 'no_items' when best < 0.18 then 'low_score' when covered < 0.4 then 'low_coverage' else 'ok' end as reason from per""", False)
def gate(v: Views) -> DataFrame:
    return evidence.gate(candidates(v))


@query("select_evidence", f"""with {POSTINGS}, k as (select keyword.*, source from keyword join documents using (doc_id)),
l as (select *, cast(row_number() over (partition by query_id, source order by rank) > 3 as int) as late from k)
select query_id, doc_id, source, rank, cast(row_number() over (partition by query_id order by late, rank) as int) as place from l qualify place <= 14""", False)
def chosen(v: Views) -> DataFrame:
    cands = retrieval.keyword_lane(asked(v), docs(v)).join(v.table("documents").select("doc_id", "source"), "doc_id")
    return evidence.select_evidence(cands, "source").select("query_id", "doc_id", "source", "rank", "place")


@query("distinct_passages", f"""with {POSTINGS}, k as (select keyword.*, md5(regexp_replace(lower(text), '\\s+', ' ', 'g')) as same from keyword join documents using (doc_id))
select query_id, doc_id, rank from k qualify row_number() over (partition by query_id, same order by rank) = 1""", False)
def passages(v: Views) -> DataFrame:
    return evidence.distinct_passages(retrieval.keyword_lane(asked(v), docs(v)), docs(v)).select("query_id", "doc_id", "rank")


@query("key_rank", f"with {POSTINGS} select query_id, cast(min(keyword.rank) as int) as key_rank from exact left join keyword using (query_id, doc_id) group by query_id", False)
def key_rank(v: Views) -> DataFrame:
    return evidence.key_rank(retrieval.keyword_lane(asked(v), docs(v)), retrieval.exact_lane(asked(v), docs(v)).select("query_id", "doc_id"))


RANKS = "select l_shipdate, l_returnflag as category, l_extendedprice as seconds, case when l_linestatus = 'F' then 'n/a' when l_quantity < 5 then null else cast(l_linenumber as varchar) end as key_rank from lineitem"


def ranks(v: Views) -> DataFrame:
    rank = F.when(F.col("l_linestatus") == "F", "n/a").when(F.col("l_quantity") < 5, None).otherwise(F.col("l_linenumber").cast("string"))
    return v.table("lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_extendedprice").alias("seconds"), rank.alias("key_rank"))


@query("retrieval_metrics", f"""
with ranks as ({RANKS}), r as (select category, try_cast(key_rank as int) as r from ranks where key_rank is null or key_rank <> 'n/a')
select category, count(*) as n, {", ".join(f"round(avg(case when r <= {k} then 1.0::double else 0.0 end), 6) as recall_{k}" for k in (1, 3, 5, 10))}, round(avg(coalesce(1.0::double / r, 0)), 6) as mrr from r group by category""", False)
def metrics(v: Views) -> DataFrame:
    return evidence.retrieval_metrics(ranks(v), "category")


@query("latency", f"""
with ranks as ({RANKS}), o as (select category, seconds, row_number() over (partition by category order by seconds) - 1 as i, count(*) over (partition by category) as n from ranks)
select category, {", ".join(f"max(case when i = least(n - 1, floor({q}::double * n)) then seconds end) as p{round(q * 100)}" for q in (0.5, 0.95, 0.99))} from o group by category""", False)
def latency(v: Views) -> DataFrame:
    return evidence.latency(ranks(v), "category", "seconds")


@query("grade_summary", "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as F, count(*) filter (o_orderstatus = 'O') as O, count(*) filter (o_orderstatus = 'P') as P from orders group by 1", False)
def grades(v: Views) -> DataFrame:
    return evidence.grade_summary(v.table("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("consistency", "select o_custkey, count(distinct o_orderstatus) as n_verdicts, count(distinct o_orderstatus) = 1 as consistent from orders group by 1", False)
def consistency(v: Views) -> DataFrame:
    return evidence.consistency(v.table("orders"), "o_custkey", "o_orderstatus")


PROBES = ["license", "http", "the", "que"]


@query("pattern_counts", "select source, " + ", ".join(f"count(*) filter (contains(lower(text), '{p}')) as probe_{i}" for i, p in enumerate(PROBES)) + " from documents group by source", False)
def probes(v: Views) -> DataFrame:
    return evidence.pattern_counts(v.table("documents"), "source", "text", PROBES)


def events(v: Views) -> DataFrame:
    raw = streams.read_stream(v.spark, v.directory, "events")
    return raw.select(
        "event_id", F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("service"), F.concat(F.lit("model-"), F.col("user_id") % 4).alias("model"), "user_id",
        F.floor("value").cast("long").alias("input_tokens"), F.floor(F.col("value") / 2).cast("long").alias("output_tokens"), (F.col("event_type") == "error").alias("failed"),
    )


@query("usage_stream", "select cast(created_at as date) as day, service, model, count(*) as calls, sum(input_tokens) as input_tokens, sum(output_tokens) as output_tokens from usage where not failed group by all")
def usage_stream(v: Views) -> DataFrame:
    return streams.drained(streams.usage_stream(events(v)), "complete")


@query("rate_limit", None)
def rate_limit(v: Views) -> DataFrame:
    return streams.drained(streams.rate_limit(events(v), 5, 24 * 3600.0))


@query("notify_stream", "select distinct user_id, service from usage")
def notify(v: Views) -> DataFrame:
    return streams.drained(streams.notify_stream(events(v).select("created_at", "user_id", "service"), ["user_id", "service"], "60 days")).select("user_id", "service")
