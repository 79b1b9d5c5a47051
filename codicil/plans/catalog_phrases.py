"""Queries over phrases, acronyms, stems and extracts, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.functions import stems
from codicil.operators import phrases
from codicil.plans.catalog_answers import POOL, pool
from codicil.plans.catalog_checks import SENTENCES
from codicil.plans.catalog_search import TOKENS, asked, docs
from codicil.plans.views import Views, pick, with_views

QUERIES, SQL = {}, {}


def query(name: str, sql: str, views: bool = False):
    def add(build):
        QUERIES[name] = lambda spark, directory: build(Views(spark, directory))
        SQL[name] = with_views(sql) if views else sql
        return build

    return add


words = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
FW, JOIN, GENERIC = words(phrases.FUNCTION_WORDS), words(phrases.JOINERS), words(phrases.GENERIC)


@query("key_phrases", f"""
with parts as (select doc_id, regexp_extract_all(lower(source || ' ' || coalesce(text, '')[1:40]), '[a-z0-9]+') as named, unnest(regexp_split_to_array(lower(coalesce(text, '')), '{phrases.CLAUSE_END}')) as c from documents),
clauses as (select doc_id, named, regexp_extract_all(c, '[a-z]+') as t from parts),
grams as (select doc_id, named, unnest(flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, len(t) - n + 2), lambda i: t[i:i + n - 1])))) as g from clauses),
fine as (
  select doc_id, named, g, list_filter(g, lambda w: w not in {tuple(phrases.FUNCTION_WORDS)} and w not in {tuple(phrases.GENERIC)}) as s from grams
  where not list_contains({FW}, g[1]) and not list_contains({FW}, g[-1]) and len(list_filter(g, lambda w: (list_contains({FW}, w) or length(w) < 3) and not list_contains({JOIN}, w))) = 0),
counts as (select doc_id, array_to_string(g, ' ') as phrase, count(*) as n from fine where len(s) > 0 and 2 * len(list_filter(s, lambda w: list_contains(named, w))) <= len(s) group by all having count(*) >= {phrases.LEAST_COUNT}),
folded as (
  select doc_id, list_reduce(list([{{'p': phrase, 'n': n}}] order by -n * len(string_split(phrase, ' ')), phrase),
    lambda acc, x: case when len(acc) >= 3 or len(list_filter(acc, lambda y: contains(y.p, x[1].p) or contains(x[1].p, y.p))) > 0 then acc else list_concat(acc, x) end) as picked from counts group by doc_id)
select doc_id, cast(generate_subscripts(picked, 1) as int) as place, unnest(list_transform(picked, lambda x: x.p)) as phrase, unnest(list_transform(picked, lambda x: x.n)) as n from folded""")
def key_phrases(v: Views) -> DataFrame:
    named = F.concat("source", F.lit(" "), F.substring(F.coalesce("text", F.lit("")), 1, 40))
    return phrases.key_phrases(v.table("documents").select("doc_id", "text", named.alias("name")))


DEFINED = (
    "HVDC - High Voltage Direct Current", "Acronym: EMI | Expansion: Equated Monthly Instalment | 3", "LTV\nLoan To Value ratio\nEMI: is used for EMI", "The State Transmission Utilities (STUs) and the Central Board (XB) met.",
    "TBCB | Under Bidding 2028-29", "KYC  Know Your Customer norms", "Rates of the Non Performing Assets (NPA) and of Key Facts Statements ( KFSs ).", "No such thing (here) A", "HVDC: High Volume Data Centre of Delhi",
)
literal = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
UPPER = "[A-Z][A-Z0-9&-]{1,9}"
CARRYING = "list_filter(regexp_extract_all({e}, '[A-Za-z][A-Za-z-]*'), lambda w: not list_contains(" + words(phrases.CONNECTORS) + ", lower(w)))"


def spells(a: str, e: str) -> str:
    carrying = CARRYING.format(e=e)
    return (
        f"(len(regexp_extract_all({e}, '[A-Za-z][A-Za-z-]*')) between 2 and 12 and length({e}) <= 160 and len({carrying}) > 0 and not list_contains(list_transform(regexp_extract_all({e}, '\\w+'), lambda w: upper(w)), upper({a}))"
        f" and regexp_matches(regexp_replace(lower(array_to_string({carrying}, '')), '[^a-z]', '', 'g'), '^' || array_to_string(string_split(regexp_replace(lower({a}), '[^a-z]', '', 'g'), ''), '.*')))"
    )


INLINE = rf"([^()]{{1,160}})\(\s*({UPPER}?)(s?)\s*\)"
ACRONYMS = f"""
chunks as (select o_orderkey as chunk_id, [{", ".join(map(literal, DEFINED))}][o_orderkey % {len(DEFINED)} + 1] || chr(10) || [{", ".join(map(literal, DEFINED))}][o_custkey % {len(DEFINED)} + 1] as text from orders),
l as (select chunk_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as l from chunks),
lines as (select chunk_id, l, unnest(l) as line, generate_subscripts(l, 1) as i from l),
celled as (select *, list_transform(string_split(line, ' | '), lambda c: trim(regexp_replace(trim(c), '^[^:|]{{1,40}}:\\s*', ''))) as cells from lines),
told as (
  select chunk_id, case when len(cells) >= 2 and regexp_full_match(cells[1], '{UPPER}') then {{'way': 'row', 'a': cells[1], 'e': cells[2]}} when regexp_matches(line, '^({UPPER})\\s*(?:[-—–:]\\s*|\\s{{2,}})(.+)$')
    then {{'way': 'line', 'a': regexp_extract(line, '^({UPPER})\\s*(?:[-—–:]\\s*|\\s{{2,}})(.+)$', 1), 'e': trim(regexp_extract(line, '^({UPPER})\\s*(?:[-—–:]\\s*|\\s{{2,}})(.+)$', 2))}} when regexp_full_match(line, '{UPPER}') then {{'way': 'stack', 'a': line, 'e': l[i + 1]}} end as d from celled),
found as (select chunk_id, unnest(regexp_extract_all(text, '{INLINE}')) as m from chunks),
split as (select chunk_id, regexp_extract(m, '{INLINE}', 2) as a, regexp_extract(m, '{INLINE}', 3) as many, regexp_extract_all(regexp_extract(m, '{INLINE}', 1), '[A-Za-z][\\w&-]*') as w from found),
tails as (select chunk_id, a, many, unnest(list_transform(range(2, least(12, len(w)) + 1), lambda n: array_to_string(w[len(w) - n + 1:], ' '))) as e, unnest(range(2, least(12, len(w)) + 1)) as n, m from (select *, row_number() over () as m from split)),
firsts as (select * from tails where regexp_matches(e, '^[A-Z]') and {spells("a", "e")} qualify row_number() over (partition by m order by n) = 1),
defined as (
  select distinct * from (
    select chunk_id, d.a as acronym, d.e as expansion, d.way as way from told where d.e is not null and {spells("d.a", "d.e")}
    union all select chunk_id, a, case when many = '' then e when regexp_matches(e, '(?i)ies$') then regexp_replace(e, '(?i)ies$', 'y') when regexp_matches(e, '(?i)[^s]s$') then regexp_replace(e, '(?i)s$', '') else e end, 'text' from firsts))"""


def defining(v: Views) -> DataFrame:
    return v.table("orders").select(F.col("o_orderkey").alias("chunk_id"), F.concat(pick(F.col("o_orderkey"), *DEFINED), F.lit("\n"), pick(F.col("o_custkey"), *DEFINED)).alias("text"))


@query("acronyms", f"with {ACRONYMS} select * from defined")
def acronyms(v: Views) -> DataFrame:
    return phrases.acronyms(defining(v))


@query("glossary", f"""with {ACRONYMS}
select acronym, expansion, chunk_id from defined join chunks using (chunk_id) qualify row_number() over (partition by acronym order by length(text), chunk_id, expansion) = 1""")
def glossary(v: Views) -> DataFrame:
    chunks = defining(v)
    return phrases.glossary(phrases.acronyms(chunks), chunks)


def stem_sql(w: str) -> str:
    cut = lambda ending, new: f"{w}[1:length({w}) - {len(ending)}] || '{new}'"
    single = lambda s: f"case when ({s})[-1] = ({s})[-2] and contains('{stems.DOUBLED}', ({s})[-1]) then ({s})[1:-2] else {s} end"
    irregular = " ".join(f"when '{a}' then '{b}'" for a, b in stems.IRREGULAR.items())
    out = [f"when {w} = '' then ''", f"when {w} in {tuple(stems.IRREGULAR)} then case {w} {irregular} end", f"when regexp_matches({w}, '\\d') or {w} in {tuple(stems.NOT_PLURAL)} then {w}", f"when length({w}) > 4 and ends_with({w}, 'ies') then {cut('ies', 'y')}"]
    out += [f"when ends_with({w}, '{e}') and length({w}) >= {len(e) + 3} then {single(cut(e, new)) if e == 's' else cut(e, new)}" for e, new in stems.PLURAL_ENDINGS]
    out += [f"when length({w}) > 5 and ends_with({w}, '{e}') and length({w}) >= {len(e) + 3} then {single(cut(e, new))}" for e, new in stems.VERB_ENDINGS]
    return f"case {' '.join(out)} else {w} end"


STEMS = f"""
said as (select doc_id, term, count(*) as tf from (select doc_id, unnest({TOKENS.format("text")}) as term from documents) group by all),
vocabulary as (select term, {stem_sql("w")} as stem from (select term, trim(lower(term), '.''’') as w from (select distinct term from said union select unnest({TOKENS.format("text")}) from benchmark)))"""


@query("stems", f"with {STEMS} select term, stem from vocabulary where term in (select term from said)")
def stem_table(v: Views) -> DataFrame:
    terms = docs(v).select(F.explode(phrases.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", stems.stem(F.col("term")).alias("stem"))


@query("stem_postings", f"with {STEMS} select doc_id, stem as term, sum(tf)::bigint as tf from said join vocabulary using (term) group by all")
def stem_postings(v: Views) -> DataFrame:
    return phrases.stem_postings(docs(v))


@query("stem_coverage", f"""with {POOL},
parts as (select query_id, whole, unnest(string_split_regex(whole, '[-./]')) as term from (select item_id as query_id, unnest(list_distinct({TOKENS.format("text")})) as whole from benchmark)),
held as (select distinct query_id, unnest(string_split_regex(whole, '[-./]')) as term from (select query_id, unnest({TOKENS.format("text")}) as whole from pool)),
asked_stems as (select query_id, whole, {stem_sql("w")} as term from (select query_id, whole, trim(lower(term), '.''’') as w from parts where term <> '')),
held_stems as (select distinct query_id, {stem_sql("w")} as term from (select query_id, trim(lower(term), '.''’') as w from held where term <> '')),
starts as (select distinct query_id, term[1:5] as start from held_stems where length(term) >= 5 and not regexp_matches(term, '\\d')),
met as (
  select a.query_id, whole, h.term is not null or s.start is not null as said from asked_stems a left join held_stems h on h.query_id = a.query_id and h.term = a.term
    left join starts s on s.query_id = a.query_id and s.start = a.term[1:5] and length(a.term) >= 5 and not regexp_matches(a.term, '\\d')),
wholes as (select query_id, whole, bool_and(said) as said from met group by all)
select item_id as query_id, coalesce(round(count(*) filter (said)::double / nullif(count(whole), 0), 6), 1.0) as coverage, coalesce(string_agg(whole, ' ' order by whole) filter (not said), '') as missing from benchmark left join wholes on query_id = item_id group by item_id""")
def stem_coverage(v: Views) -> DataFrame:
    return phrases.stem_coverage(asked(v), pool(v))


@query("extractive_summary", f"""
, told as (select version_id as doc_id, number as place, number, case when number % 3 = 1 then 'Scope of ' || title else title end as title, content || ' Loans are exempt unless the branch must report them. Apply now.' as text from sections),
quoted as (select doc_id, place, number, title, unnest({SENTENCES.format(c="text")}) as s, generate_subscripts({SENTENCES.format(c="text")}, 1) as i from told),
fine as (select * from quoted where len(regexp_split_to_array(trim(s), '\\s+')) >= 5),
kinds as (
  select *, 'overview' as kind from fine union all select *, 'purpose' from fine where regexp_matches(title, '{phrases.PURPOSE}') union all select *, 'rule' from fine where regexp_matches(s, '{phrases.RULE}')
  union all select *, 'action' from fine where regexp_matches(s, '{phrases.ACTION}') union all select *, 'exception' from fine where regexp_matches(s, '{phrases.EXCEPTION}'))
select doc_id, kind, cast(row_number() over (partition by doc_id, kind order by place, i) as int) as n, number, s as sentence from kinds
qualify n <= case kind when 'overview' then 2 when 'purpose' then 1 when 'rule' then 8 else 5 end""", True)
def extractive_summary(v: Views) -> DataFrame:
    n = F.col("number")
    rows = v.sections().select(F.col("version_id").alias("doc_id"), n.alias("place"), "number", F.when(n % 3 == 1, F.concat(F.lit("Scope of "), "title")).otherwise(F.col("title")).alias("title"), F.concat("content", F.lit(" Loans are exempt unless the branch must report them. Apply now.")).alias("text"))
    return phrases.extractive_summary(rows)
