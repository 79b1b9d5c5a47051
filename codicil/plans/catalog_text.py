"""Queries over what documents say of themselves and the words they use, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.functions import dates, text
from codicil.operators import evidence, fingerprints, metadata, retrieval, timeline
from codicil.plans.catalog_core import D, day
from codicil.plans.catalog_search import NORMALISED, POSTINGS, TOKENS, asked, docs
from codicil.plans.views import Views, pick, with_views

QUERIES, SQL = {}, {}


def query(name: str, sql: str, views: bool = True):
    def add(build):
        QUERIES[name] = lambda spark, directory: build(Views(spark, directory))
        SQL[name] = with_views(sql) if views else sql
        return build

    return add


FORMS = ("%Y-%m-%d", "%d/%m/%Y", "%-d %B %Y", "%B %-d, %Y")
OPENINGS = """
, openings as (
  select o_orderkey as doc_id, 'Policy No: pn-' || o_custkey || '/' || (o_orderkey % 90) || ' Version ' || (o_orderkey % 7) || '.' || (o_orderkey % 3 * 5) || '. Issued by the ' || ['Credit Office', 'Audit Team', 'Board of Rules'][o_orderkey % 3 + 1] || '. '
    || case when o_orderkey % 10 = 0 then '' else 'Effective from ' || case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d/%m/%Y') when 2 then strftime(o_orderdate, '%-d') || 'th ' || strftime(o_orderdate, '%B %Y') else strftime(o_orderdate, '%B %-d, %Y') end || '. ' end
    || case when o_orderkey % 2 = 0 then 'It amends clause ' || (o_orderkey % 9 + 1) || '.2 and clause 7 of HL-' || o_custkey || '. ' else 'It is due by ' || strftime(o_orderdate, '%B %Y') || ' for ' || (o_orderkey % 40) || '.5 lakhs or 1,20,000 thousand. ' end as text from orders)"""


def openings(v: Views) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    spelled = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(d, "dd/MM/yyyy")).when(k % 4 == 2, F.concat(F.date_format(d, "d"), F.lit("th "), F.date_format(d, "MMMM yyyy"))).otherwise(F.date_format(d, "MMMM d, yyyy"))
    last = F.when(k % 2 == 0, F.concat(F.lit("It amends clause "), k % 9 + 1, F.lit(".2 and clause 7 of HL-"), "o_custkey", F.lit(". "))).otherwise(
        F.concat(F.lit("It is due by "), F.date_format(d, "MMMM yyyy"), F.lit(" for "), k % 40, F.lit(".5 lakhs or 1,20,000 thousand. "))
    )
    head = F.concat(F.lit("Policy No: pn-"), "o_custkey", F.lit("/"), k % 90, F.lit(" Version "), k % 7, F.lit("."), k % 3 * 5, F.lit(". Issued by the "), pick(k, "Credit Office", "Audit Team", "Board of Rules"), F.lit(". "))
    return v.table("orders").select(k.alias("doc_id"), F.concat(head, F.when(k % 10 == 0, "").otherwise(F.concat(F.lit("Effective from "), spelled, F.lit(". "))), last).alias("text"))


MONTH = f"list_position({dates.SHORT_MONTHS}, lower(substr({{m}}, 1, 3)))"


def first_date(t: str) -> str:
    found = []
    for pattern, (y, m, d) in dates.FORMS:
        part = lambda g, p=pattern: f"regexp_extract({t}, '{p}', {g})"
        month = f"case when regexp_full_match({part(m)}, '\\d+') then try_cast({part(m)} as int) else {MONTH.format(m=part(m))} end"
        dd = f"try_cast({part(d)} as int)"
        a, b = f"case when ({month}) > 12 and {dd} <= 12 then {dd} else ({month}) end", f"case when ({month}) > 12 and {dd} <= 12 then ({month}) else {dd} end"
        iso = f"try_cast({part(y)} || '-' || lpad(({a})::varchar, 2, '0') || '-' || lpad(({b})::varchar, 2, '0') as date)"
        found.append(f"case when regexp_matches({t}, '{pattern}') and year({iso}) between 1900 and 2200 then {{'at': strpos({t}, regexp_extract({t}, '{pattern}')), 'day': {iso}}} end")
    return f"list_min(list_filter([{', '.join(found)}], lambda x: x is not null)).day"


@query("metadata", f"""{OPENINGS}, got as (
  select doc_id, upper(trim(regexp_extract(text, '{metadata.NUMBER}', 1))) as number, trim(regexp_extract(text, '{metadata.VERSION}', 1)) as version, trim(regexp_extract(text, '{metadata.ISSUER}', 1)) as issuer,
    case when regexp_matches(text, '{metadata.EFFECTIVE}') then trim(regexp_extract(text, '{metadata.EFFECTIVE}', 1)) end as said from openings)
select doc_id, number, version, regexp_replace(version, '(\\.0)+$', '') as version_key, issuer, {first_date("said")} as effective from got""")
def metadata_(v: Views) -> DataFrame:
    return metadata.extract_metadata(openings(v))


@query("amendment_refs", f"""{OPENINGS}, said as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '{metadata.AMENDS}'))) as said from openings)
select doc_id, upper(regexp_extract(said, '{metadata.AMENDS}', 1)) as relation, nullif(upper(regexp_extract(said, '\\b([A-Za-z]{{1,10}}-\\d[A-Za-z0-9]*)', 1)), '') as target, array_to_string(regexp_extract_all(said, '{metadata.CLAUSES}', 1), ',') as clauses from said""")
def amendments(v: Views) -> DataFrame:
    return metadata.amendment_refs(openings(v))


@query("month_ends", f"""{OPENINGS}
select doc_id, last_day(try_cast(regexp_extract(text, '{dates.MONTH_YEAR}', 2) || '-' || lpad({MONTH.format(m=f"regexp_extract(text, '{dates.MONTH_YEAR}', 1)")}::varchar, 2, '0') || '-01' as date)) as month_end from openings where regexp_matches(text, '{dates.MONTH_YEAR}')""")
def month_ends(v: Views) -> DataFrame:
    return openings(v).select("doc_id", dates.month_end(F.col("text")).alias("month_end")).filter("month_end is not null")


FACTOR = "case lower({w}) " + " ".join(f"when '{k}' then {n}" for k, n in dates.MULTIPLIERS.items()) + " end"


@query("multiplied_figures", f"""{OPENINGS},
said as (select doc_id, unnest(regexp_extract_all(text, '{dates.FIGURE}')) as w, generate_subscripts(regexp_extract_all(text, '{dates.FIGURE}'), 1) as place from openings)
select doc_id, cast(place - 1 as int) as place, (replace(regexp_extract(w, '{dates.FIGURE}', 1), ',', '')::decimal(18, 4) * {FACTOR.format(w=f"regexp_extract(w, '{dates.FIGURE}', 2)")})::double as value from said""")
def multiplied_figures(v: Views) -> DataFrame:
    return openings(v).select("doc_id", F.posexplode(dates.multiplied(F.col("text"))).alias("place", "value"))


SMALL = ", ".join(f"'{w}'" for w in metadata.SMALL)
CASED = f"array_to_string(list_transform(string_split(t, ' '), lambda w, i: case when regexp_matches(w, '\\d|^[A-Z]{{{{2,5}}}}$') then w when i > 1 and lower(w) in ({SMALL}) then lower(w) else upper(w[1]) || lower(w[2:]) end), ' ')".replace("{{", "{").replace("}}", "}")
INITIALS = f"upper(array_to_string(list_transform(list_filter(string_split(t, ' '), lambda w: lower(w) not in ({SMALL}) and regexp_matches(w, '^[A-Za-z]')), lambda w: w[1]), ''))"
NAMES = "(select p_partkey, 'rules FOR the ' || p_type || ' of ' || p_name as t from part)"


def names(v: Views) -> DataFrame:
    return v.table("part").select("p_partkey", F.concat(F.lit("rules FOR the "), "p_type", F.lit(" of "), "p_name").alias("t"))


@query("titles", f"""
select p_partkey, {CASED} as title, {INITIALS} as initials from {NAMES}""", False)
def titles(v: Views) -> DataFrame:
    return names(v).select("p_partkey", metadata.smart_title(F.col("t")).alias("title"), metadata.initials(F.col("t")).alias("initials"))


ALIASES = f"""named as (select c_custkey as policy_id, c_name || ' of ' || c_mktsegment || ' ' || n_name as t, 'pn-' || c_custkey as number from customer join nation on n_nationkey = c_nationkey),
spelled as (
  select policy_id, unnest(list_distinct(list_filter(list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda w: length(w) >= 5) || [case when length({INITIALS}) >= 3 then lower({INITIALS}) end, number], lambda a: a is not null))) as alias from named),
aliases as (select alias, min(policy_id) as policy_id from spelled group by alias having min(policy_id) = max(policy_id))"""


def aliases(v: Views) -> DataFrame:
    nation = v.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    named = v.table("customer").join(nation, "c_nationkey").select(F.col("c_custkey").alias("policy_id"), F.concat("c_name", F.lit(" of "), "c_mktsegment", F.lit(" "), "n_name").alias("title"), F.concat(F.lit("PN-"), "c_custkey").alias("number"))
    return metadata.alias_catalogue(named)


@query("alias_catalogue", f"with {ALIASES} select * from aliases", False)
def alias_catalogue(v: Views) -> DataFrame:
    return aliases(v)


@query("policy_mentions", f"""with {ALIASES}, said as (select event_id as query_id, unnest(list_distinct(regexp_extract_all(lower('What of PN-' || user_id || ' or pn-' || event_id || '?'), '[a-z0-9]+(?:-[a-z0-9]+)*'))) as alias from events)
select distinct query_id, policy_id from said join aliases using (alias)""", False)
def policy_mentions(v: Views) -> DataFrame:
    said = v.table("events").select(F.col("event_id").alias("query_id"), F.concat(F.lit("What of PN-"), "user_id", F.lit(" or pn-"), "event_id", F.lit("?")).alias("text"))
    return metadata.policy_mentions(said, aliases(v))


@query("fallback_title", f"""
with t as (select doc_id, {TOKENS.format("text")} as t from documents), pairs as (select doc_id, t[i] || ' ' || t[i + 1] as pair from t, lateral (select unnest(range(1, len(t))) as i)),
counts as (select doc_id, pair, count(*) as n from pairs group by all)
select doc_id, pair as title, n from counts qualify row_number() over (partition by doc_id order by n desc, pair) = 1""", False)
def fallback_title(v: Views) -> DataFrame:
    return metadata.fallback_title(docs(v))


@query("suggest_words", f"""with {POSTINGS}, vocabulary as (select term, count(*) as n from posts group by term), lost as (select distinct term as word from asked where term not in (select term from vocabulary) and length(term) > 3),
near as (select word, term, n from lost join vocabulary on abs(length(word) - length(term)) <= 1 and length(term) > 2 and levenshtein(word, term) <= 1)
select * from near qualify row_number() over (partition by word order by n desc, term) = 1""", False)
def suggest_words(v: Views) -> DataFrame:
    vocabulary = retrieval.postings(docs(v)).groupBy("term").agg(F.count("*").alias("n"))
    return metadata.suggest_words(retrieval.query_terms(asked(v)).withColumnRenamed("term", "word"), vocabulary)


@query("hash_embedding", f"""
with t as (select doc_id, {TOKENS.format("text")} as t from documents),
features as (
  select doc_id, unnest(t) as f, 1.0 as w from t
  union all select doc_id, t[i] || ' ' || t[i + 1], 0.7 from t, lateral (select unnest(range(1, len(t))) as i)
  union all select doc_id, '#' || substr(x, i, 3), 0.3 from (select doc_id, unnest(list_filter(t, lambda x: length(x) > 4)) as x from t), lateral (select unnest(range(1, length(x) - 1)) as i)),
counts as (select doc_id, f, w, count(*) as n from features group by all),
sums as (select doc_id, cast(('0x' || substr(md5(f), 1, 8))::bigint % 64 as int) as place, sum(case when ('0x' || substr(md5(f), 9, 1))::int % 2 = 1 then w * n else -w * n end)::double as v from counts group by all)
select doc_id, place, round(v / sqrt(sum(v * v) over (partition by doc_id)), 6) as value from sums where v <> 0""", False)
def hash_embedding(v: Views) -> DataFrame:
    return metadata.hash_embedding(docs(v))


@query("visible_doc_freq", f"""
, live as (select c.chunk_id, content from chunks c join uploads u using (document_id) join timeline t on t.version_id = u.version_id where u.status = 'ready' and effective_from <= {D} and (effective_to is null or effective_to > {D})),
words as (select chunk_id, unnest(list_distinct({TOKENS.format("content")})) as term from live), df as (select term, count(*) as df from words group by term),
said as (select p_partkey as query_id, unnest(['the', 'rate', 'months', 'unknown' || (p_partkey % 3), 'rs']) as term from part)
select query_id, s.term, case when s.term = 'the' then -1 else coalesce(df, 0) end as df from said s left join df using (term)""")
def visible_doc_freq(v: Views) -> DataFrame:
    chunks = retrieval.searchable(v.chunks(), v.uploads(), v.versions(), v.policies(), day())
    words = F.explode(F.array(F.lit("the"), F.lit("rate"), F.lit("months"), F.concat(F.lit("unknown"), F.col("p_partkey") % 3), F.lit("rs")))
    return metadata.visible_doc_freq(v.table("part").select(F.col("p_partkey").alias("query_id"), words.alias("term")), chunks, text.STOP_WORDS)


@query("duplicate_check", f"""
with h as (select doc_id, source, sha256(array_to_string({NORMALISED}, ' ')) as content_hash from documents)
select a.doc_id as asked_id, case when bool_or(b.source = 'src0') then min(b.doc_id) filter (b.source = 'src0') end as doc_id, not bool_or(coalesce(b.source = 'src0', false)) as hidden from h a join h b using (content_hash) where b.source is not null group by a.doc_id""", False)
def duplicate_check(v: Views) -> DataFrame:
    hashes = fingerprints.content_hash(v.table("documents").select("doc_id", "text")).join(v.table("documents").select("doc_id", "source"), "doc_id")
    return fingerprints.check_duplicates(hashes.select(F.col("doc_id").alias("asked_id"), "content_hash"), hashes.filter("source is not null"), F.col("source") == "src0")


@query("default_dates", """
select o_orderkey as document_id, coalesce(case when o_orderkey % 3 = 0 then cast(o_orderdate as date) + 10 end, case when o_orderkey % 4 = 0 then cast(o_orderdate as date) - 5 end, cast(o_orderdate as date)) as default_date,
  case when o_orderkey % 3 = 0 or o_orderkey % 4 = 0 then 'detected' else 'upload_date' end as default_source from orders""", False)
def default_dates(v: Views) -> DataFrame:
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = v.table("orders").select(k.alias("document_id"), F.when(k % 3 == 0, F.date_add(d, 10)).alias("effective_date"), F.when(k % 4 == 0, F.date_sub(d, 5)).alias("issue_date"), F.col("o_orderdate").alias("created_at"))
    return timeline.default_dates(rows).select("document_id", "default_date", "default_source")


@query("true_periods", f"""
, items as (select policy_id, version_id, effective_from, effective_to from timeline where effective_from <= {D}),
later as (select i.version_id, min(v.effective_from) as next_from from items i join versions v on v.policy_id = i.policy_id and v.effective_from > i.effective_from group by 1)
select policy_id, version_id, effective_from, least(effective_to, next_from) as true_to from items left join later using (version_id)""")
def true_periods(v: Views) -> DataFrame:
    items = timeline.build_timeline(v.versions()).filter(F.col("effective_from") <= day()).select("policy_id", "version_id", "effective_from", "effective_to")
    newer = items.join(v.versions().select("policy_id", F.col("effective_from").alias("newer_from")), "policy_id").filter("newer_from > effective_from")
    return timeline.true_periods(items, newer)


NUMBERS = "list_distinct(regexp_extract_all({}, '\\d+(?:\\.\\d+)?'))"


@query("grounded_texts", f"""
, rows as (select version_id, number, content as source, case when number % 2 = 0 then title || ' ' || content else content || ' 17.5' end as claim from sections)
select version_id, number, len(list_filter({NUMBERS.format("claim")}, lambda x: not list_contains({NUMBERS.format("source")}, x))) = 0 as grounded from rows""")
def grounded_texts(v: Views) -> DataFrame:
    claim = F.when(F.col("number") % 2 == 0, F.concat_ws(" ", "title", "content")).otherwise(F.concat(F.col("content"), F.lit(" 17.5")))
    return evidence.grounded(v.sections().select("version_id", "number", F.col("content").alias("source"), claim.alias("claim")), ["version_id", "number"])


KEYED = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '\\b(?:version|ver|v)\\s*\\.?\\s*\\d+(?:\\.\\d+)*\\b', ' ', 'g'), '\\b(?:19|20)\\d\\d\\b', ' ', 'g'), '\\b(?:draft|final|revised|updated|copy)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query("title_keys", f"""
with t as (select o_orderkey, o_custkey, 'Final Policy-' || o_custkey || ' (Revised) Version ' || (o_orderkey % 5) || '.0 of 1998' as t from orders)
select o_orderkey, {KEYED} as title_key, regexp_replace(o_orderkey::varchar, '(\\d)((?:\\d\\d)*)(\\d{{3}})$', '\\1|\\2|\\3') is not null as grouped, greatest(0, 1 - bit_count(xor(o_orderkey, o_custkey)) / 32.0::double) as similarity from t""", False)
def title_keys(v: Views) -> DataFrame:
    t = F.concat(F.lit("Final Policy-"), "o_custkey", F.lit(" (Revised) Version "), F.col("o_orderkey") % 5, F.lit(".0 of 1998"))
    grouped = F.regexp_replace(text.indian_digits(F.col("o_orderkey")), ",", "") == F.col("o_orderkey").cast("string")
    return v.table("orders").select("o_orderkey", text.title_key(t).alias("title_key"), grouped.alias("grouped"), text.content_similarity(F.col("o_orderkey"), F.col("o_custkey")).alias("similarity"))
