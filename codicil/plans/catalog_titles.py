"""Queries that find and mend titles, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.operators import metadata, titles
from codicil.plans.catalog_text import KEYED
from codicil.plans.views import Views, pick

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(build):
        QUERIES[name] = lambda spark, directory: build(Views(spark, directory))
        SQL[name] = sql
        return build

    return add


#: lines of first pages: for each remainder of the order's key, (text, size, bold) with {k} for the key
PAGES = (
    (("Circular {k}", 10, False), ("HOME LOAN", 20, True), ("CREDIT POLICY", 19.8, True), ("Part B", 14, False), ("Version 2", 12, False)),
    (("", 30, True), ("Policy on", 14, True), ("‘Microfinance Loans’", 14, True), ("Read the manual of the bank before use.", 10, False)),
    (("Guidelines for the", 14, True), ("Branches", 11, True), ("Page 1 of 3", 24, False)),
    (("text without any of it", 10, False), ("Procedure for", 12, False), ("Cash and", 12, False), ("Gold {k}", 12, False), ("of the", 12, False)),
    (("Policy No: PN-{k}", 22, True), ("SOP", 11, False), ("Effective from 2024-01-01", 12, False)),
    (),
    (("Notice", 16, True), ("x", 9, False), ("NOTICE", 16, True)),
)
FILE_TITLES = ("Home Loan Credit Policy", "policy_final.pdf", None, "Guide of Gold", "Notice")
OPENINGS = ("Home loan credit policy. The home loan credit policy is this.", "", "notice of notice", None)


def pages(v: Views) -> tuple[DataFrame, DataFrame]:
    k = F.col("o_orderkey")
    line = lambda t, s, b: F.struct(F.concat(F.lit(t.split("{k}")[0]), (k if "{k}" in t else F.lit("")).cast("string")).alias("text"), F.lit(float(s)).alias("size"), F.lit(b).alias("bold"))
    every = F.lit(None).cast("array<struct<text:string,size:double,bold:boolean>>")
    for i, page in enumerate(PAGES):
        every = F.when(k % len(PAGES) == i, F.array(*[line(*x) for x in page]) if page else None).otherwise(every)
    orders = v.table("orders")
    lines = orders.select(k.alias("doc_id"), F.posexplode(every).alias("line_no", "l")).select("doc_id", "line_no", "l.*")
    choose = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    return lines, orders.select(k.alias("doc_id"), choose(OPENINGS, F.col("o_custkey")).alias("text"), F.when(k % 3 != 0, 10.0).alias("body"), choose(FILE_TITLES, F.col("o_custkey")).alias("pdf_title"))


literal = lambda t: "null" if t is None else "'" + str(t).replace("'", "''") + "'"
KEY = lambda c: KEYED.replace("lower(t)", f"lower({c})")
small = "list_contains({}, lower({{}}))".format(list(titles.JOINING))
opened = lambda t: small.format(f"regexp_extract({t}, '(\\S+)$', 1)")
bare = lambda t: f"regexp_replace(trim({t}), '^[‘’“”\"'']+|[‘’“”\"'']+$', '', 'g')"
STEPS = "".join(
    f"""
s{n} as (
  select s.*, case when good and not done and {opened(f"p")} then {bare("y.text")} end as piece, good and not done and {opened("p")} as goes,
    y.size is not null and s.size > 0 and abs(y.size - s.size) <= s.size * (1 - {titles.ALIKE_SIZE}) and y.bold = s.bold and {bare("y.text")} <> '' as fits, y.i is not null as there
  from t{n - 1} s left join l y on y.doc_id = s.doc_id and y.i = s.i + {n}),
t{n} as (select * exclude (piece, goes, fits, there, p, parts, good, done), case when goes and fits then piece else p end as p, case when goes and fits then parts || ' ' || piece else parts end as parts, case when goes and there and not fits then false else good end as good, done or (there and not (goes and fits)) as done from s{n}),"""
    for n in (1, 2, 3)
)
FOUND = f"""
raw as (
  select o_orderkey as doc_id, unnest(case o_orderkey % {len(PAGES)} {" ".join(f"when {i} then [" + ", ".join(f"{{'i': {j}, 'text': " + literal(t).replace("{k}'", "' || o_orderkey") + f", 'size': {float(s)}::double, 'bold': {str(b).lower()}}}" for j, (t, s, b) in enumerate(page)) + "]" for i, page in enumerate(PAGES) if page)} end, recursive := true) from orders),
l as (select doc_id, row_number() over (partition by doc_id order by i) as i, text, size, bold from raw where trim(text) <> '' qualify row_number() over (partition by doc_id order by i) <= 40),
o as (select o_orderkey as doc_id, coalesce([{", ".join(map(literal, OPENINGS))}][o_custkey % {len(OPENINGS)} + 1], '') as opening, case when o_orderkey % 3 <> 0 then 10.0 else 0 end as body, [{", ".join(map(literal, FILE_TITLES))}][o_custkey % {len(FILE_TITLES)} + 1] as pdf_title from orders),
tops as (select doc_id, max(size) as top from l group by 1),
big as (select l.*, top, size >= top * {titles.ALIKE_SIZE} as is_big, min(case when size >= top * {titles.ALIKE_SIZE} then i end) over (partition by doc_id) as first_big from l join tops using (doc_id)),
ends as (select doc_id, top, first_big, coalesce(min(i) filter (not is_big and i > first_big), max(i) + 1) as stop from big group by all),
block as (select e.doc_id, top, stop, string_agg(l.text, ' ' order by i) as t from ends e join l on l.doc_id = e.doc_id and i >= first_big and i < stop group by all),
largest as (select b.doc_id, t || case when regexp_matches(trim(l.text), '{titles.SUBTITLE}') then ' – ' || trim(l.text) else '' end as text, 0.55 as score, 'largest_font' as source from block b join o using (doc_id) left join l on l.doc_id = b.doc_id and l.i = stop where top > 0 and (body = 0 or top >= body * {titles.LARGER})),
heads as (select * from l where i <= 15 and regexp_matches(text, '{titles.TYPE_WORDS}') and len(regexp_split_to_array(trim(text), '\\s+')) <= 12 and not ends_with(rtrim(text), '.')),
t0 as (select *, trim(text) as p, trim(text) as parts, true as good, false as done from heads),{STEPS}
offers as (
  select doc_id, text, score, source from largest union all select doc_id, text, 0.35, 'heading_keyword' from heads
  union all select doc_id, parts, 0.45, 'heading_keyword' from t3 where good and parts <> trim(text) and not {opened("p")}
  union all select doc_id, pdf_title, 0.4, 'pdf_metadata' from o where pdf_title is not null and not regexp_matches(pdf_title, '{titles.FILE_LIKE}')),
tidy as (select doc_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '^[ :-]+|[ :-]+$', '', 'g') as text, score, source from offers where text is not null),
fine as (
  select *, {KEY("text")} as key, round(score + case when regexp_matches(text, '{titles.TYPE_WORDS}') then 0.2 else 0 end + case when regexp_full_match(text, '[^a-z]*') or regexp_full_match(text, '[^A-Za-z]*(?:[A-Z][a-z]*[^A-Za-z]+)*(?:[A-Z][a-z]*)?') then 0.1 else 0 end, 4) as s
  from tidy where length(text) between 3 and 150 and regexp_matches(text, '[A-Za-z]{{3}}') and not regexp_matches(text, '{metadata.NUMBER}') and not regexp_matches(text, '{titles.ONLY_VERSION}') and not regexp_matches(text, '{titles.ONLY_PAGE}') and not regexp_matches(text, '{metadata.EFFECTIVE}')),
keyed as (select doc_id, key, text, source, s from fine where key <> '' qualify row_number() over (partition by doc_id, key order by s desc, text desc, source desc) = 1),
scored as (
  select k.doc_id, text, source, round(s + case when (length({KEY("opening")}) - length(replace({KEY("opening")}, key, ''))) / length(key) >= 2 then 0.1 else 0 end + case when {KEY("pdf_title")} = key then 0.15 else 0 end, 4) as s from keyed k join o using (doc_id)),
best as (select * from scored qualify row_number() over (partition by doc_id order by s desc, text desc, source desc) = 1)"""


@query("detect_title", f"with {FOUND} select doc_id, round(least(s, 0.99), 2)::double as confidence, source, text as found from best")
def detect_title(v: Views) -> DataFrame:
    return titles.detect_title(*pages(v)).drop("title")


DAMAGED = ("OUR CODE OF E HICS", "Our Code of Ethis", "annul report on manul handling", "THE CODE", "Loan Gidlines of T H E KYC", "Prcdure for loan", "")
TEXTS = ("code of ethics. The code, the ethics and the annual report: manual and annual, manual guidelines for loans and loans. procedure, procedure", "ethics ethic ethics code code ours ours guidelines guidelines loan loan", None)


@query("repair_titles", f"""
with t as (select o_orderkey as doc_id, [{", ".join(map(literal, DAMAGED))}][o_orderkey % {len(DAMAGED)} + 1] as title, coalesce([{", ".join(map(literal, TEXTS))}][o_custkey % {len(TEXTS)} + 1], '') as text from orders),
vocabulary as (select doc_id, term, count(*) as n from (select doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as term from t) group by all),
own as (select doc_id, term, count(*) as m from (select doc_id, lower(unnest(regexp_extract_all(title, '[A-Za-z]+'))) as term from t) group by all),
words as (select doc_id, unnest(string_split(title, ' ')) as w, generate_subscripts(string_split(title, ' '), 1) as i from t),
bared as (select *, lower(regexp_replace(w, '[^A-Za-z]', '', 'g')) as bare from words),
flagged as (select b.*, not (bare = '' or list_contains({[*titles.JOINING, "a", "i", "kyc"]}, bare)) and (length(bare) = 1 or coalesce(n, 0) <= coalesce(m, 0)) as lost from bared b left join vocabulary v on v.doc_id = b.doc_id and v.term = bare left join own o on o.doc_id = b.doc_id and o.term = bare),
numbered as (select *, sum(case when lost then 0 else 1 end) over (partition by doc_id order by i) as run from flagged),
runs as (select doc_id, run, min(i) as at, string_agg(bare, '' order by i) as whole, string_agg(w, '' order by i) as written from numbered where lost group by all),
near as (
  select b.doc_id, b.word, v.term from (select doc_id, whole as word from runs union select doc_id, bare from numbered where lost) b join vocabulary v on v.doc_id = b.doc_id and n >= 2 and length(word) >= 3
    and length(term) > length(word) and length(term) <= length(word) + case when length(word) >= 8 then 2 else 1 end and levenshtein(term, word) <= case when length(word) >= 8 then 2 else 1 end and term <> word || 's' and term <> word || 'es'
  qualify row_number() over (partition by b.doc_id, word order by n desc, term desc) = 1),
mended as (
  select n.doc_id, i, case when not lost then w when h.term is not null then case when i = r.at then case when regexp_full_match(regexp_replace(written, '[^A-Za-z]', '', 'g'), '[A-Z]+') then upper(h.term) when regexp_matches(regexp_replace(written, '[^A-Za-z]', '', 'g'), '^[A-Z]') then upper(h.term[1]) || h.term[2:] else h.term end end
    when e.term is not null then case when regexp_full_match(regexp_replace(w, '[^A-Za-z]', '', 'g'), '[A-Z]+') then upper(e.term) when regexp_matches(regexp_replace(w, '[^A-Za-z]', '', 'g'), '^[A-Z]') then upper(e.term[1]) || e.term[2:] else e.term end else w end as p
  from numbered n left join runs r on r.doc_id = n.doc_id and r.run = n.run and lost left join near h on h.doc_id = n.doc_id and h.word = r.whole left join near e on e.doc_id = n.doc_id and e.word = bare)
select t.doc_id, title, string_agg(p, ' ' order by i) as repaired from t join mended m on m.doc_id = t.doc_id group by all""")
def repair_titles(v: Views) -> DataFrame:
    rows = v.table("orders").select(F.col("o_orderkey").alias("doc_id"), pick(F.col("o_orderkey"), *DAMAGED).alias("title"), F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (F.col("o_custkey") % len(TEXTS) + 1).cast("int")).alias("text"))
    return titles.repair_titles(rows.select("doc_id", "title"), rows.select("doc_id", "text"), ["KYC"])
