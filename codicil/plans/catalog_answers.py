"""Queries over answers, claims and passages, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.operators import answers, fingerprints, retrieval
from codicil.plans.catalog_checks import facts_sql
from codicil.plans.catalog_core import D, day
from codicil.plans.catalog_search import POSTINGS, SIMHASH, TOKENS, asked, docs
from codicil.plans.views import Views, pick, with_views
from codicil.sources.scratch import stored

QUERIES, SQL = {}, {}


def query(name: str, sql: str, views: bool = True):
    def add(build):
        QUERIES[name] = lambda spark, directory: build(Views(spark, directory))
        SQL[name] = with_views(sql) if views else sql
        return build

    return add


def plain(text: str) -> str:
    t = f"regexp_replace(replace(replace(replace(lower(coalesce({text}, '')), '₹', 'rs '), 'rs.', 'rs '), '–', '-'), '(\\d),(\\d)', '\\1\\2', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({t}, '(\\d),(\\d)', '\\1\\2', 'g'), '(\\d)\\s+%', '\\1%', 'g'), '\\s+', ' ', 'g')"


def figures(text: str) -> str:
    t = f"regexp_replace(regexp_replace({text}, '\\bv\\d+(\\.\\d+)?\\b', ' ', 'g'), '\\b\\d{{1,2}}-[a-z]{{3}}-\\d{{4}}\\b', ' ', 'g')"
    return f"list_distinct(list_transform(regexp_extract_all({t}, '\\d+(?:\\.\\d+)?%?'), lambda f: regexp_replace(regexp_replace(f, '(\\.\\d*?)0+(%?)$', '\\1\\2'), '\\.(%?)$', '\\1')))"


def sentences(text: str) -> str:
    """The marks that end a sentence are followed by a line feed first, as the engine has no look-behind."""
    cut = f"string_split(regexp_replace(regexp_replace({text}, '([.;!?])\\s+', '\\1' || chr(10), 'g'), '\\n+', chr(10), 'g'), chr(10))"
    return f"list_filter(list_transform({cut}, lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '')"


BEHAVIORS, STATUSES = ("answer", "abstain", "answer_absent", "correct_premise", "answer", "answer"), ("answered", "no_answer", "answered", "answered", "CRASH", "answered", "answered")
EXAMS = f"""
, exams as (
  select version_id * 10 + number as id, {list(BEHAVIORS)}[(version_id + number) % {len(BEHAVIORS)} + 1] as behavior, case when version_id % 3 = 0 then title else content end as expected, version_id, number, content, title from sections),
records as (
  select id, {list(STATUSES)}[(id // 3) % {len(STATUSES)} + 1] as status,
    case when id % 6 = 0 then 'That is not mentioned.' when id % 6 = 1 then 'That is wrong: ' || content || ' ' || title when id % 6 = 2 then lead(content) over (partition by version_id order by number) else content || ' ' || title end as answer from exams where number <> 5),
old_records as (select id, status, case when id % 4 = 0 then '' else answer end as answer from records)"""


def verdicts(records: str) -> str:
    refuses = f"regexp_matches(a, '{answers.REFUSAL.replace(chr(39), chr(39) * 2)}')"
    small = ", ".join(f"'{w}'" for w in answers.SMALL_WORDS)
    some = "case when hits > 0 then 'PARTIAL' else 'WRONG' end"
    return f"""(
  with met as (select id, behavior, status, {plain("answer")} as a, {plain("expected")} as e from exams left join {records} using (id)),
  f as (select *, {figures("e")} as wanted, {figures("a")} as said, list_filter(regexp_extract_all(e, '[a-z][a-z-]{{3,}}'), lambda w: w not in ({small})) as words from met),
  h as (select *, case when len(wanted) > 0 then len(wanted) else len(words) end as n,
    case when len(wanted) > 0 then len(list_filter(wanted, lambda x: list_contains(said, x) or list_contains(said, x || '%'))) else len(list_filter(words, lambda w: contains(a, w))) end as hits from f)
  select id, case when status = 'CRASH' then 'ERROR' when behavior = 'abstain' then case when status = 'no_answer' or {refuses} then 'CORRECT' else 'WRONG' end
    when behavior = 'answer_absent' and status = 'no_answer' then 'PARTIAL' when behavior = 'answer_absent' then case when {refuses} or regexp_matches(a, '\\bno\\b') then 'CORRECT' else 'WRONG' end
    when status is distinct from 'answered' or regexp_matches(a, '{answers.OPEN}') then 'NO ANSWER' when behavior = 'correct_premise' and not regexp_matches(a, '{answers.CORRECTION}') then {some}
    when n > 0 and hits = n then 'CORRECT' else {some} end as verdict from h)"""


def exams(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = v.sections().withColumn("id", F.col("version_id") * 10 + F.col("number"))
    expected = F.when(F.col("version_id") % 3 == 0, F.col("title")).otherwise(F.col("content"))
    questions = rows.select("id", pick(F.col("version_id") + F.col("number"), *BEHAVIORS).alias("behavior"), expected.alias("expected"))
    full, k = F.concat_ws(" ", "content", "title"), F.col("id") % 6
    after = F.lead("content").over(Window.partitionBy("version_id").orderBy("number"))
    answer = F.when(k == 0, "That is not mentioned.").when(k == 1, F.concat(F.lit("That is wrong: "), full)).when(k == 2, after).otherwise(full)
    records = rows.filter("number <> 5").select("id", pick(F.floor(F.col("id") / 3), *STATUSES).alias("status"), answer.alias("answer"))
    return questions, records, records.withColumn("answer", F.when(F.col("id") % 4 == 0, "").otherwise(F.col("answer")))


@query("grade_answers", f"{EXAMS} select * from {verdicts('records')}")
def grade_answers(v: Views) -> DataFrame:
    questions, records, _ = exams(v)
    return answers.grade(questions, records)


@query("grade_diff", f"""{EXAMS}, before as {verdicts("old_records")}, after as {verdicts("records")},
places(verdict, place) as (values {", ".join(f"('{x}', {i})" for i, x in enumerate(answers.VERDICTS))})
select id, b.verdict as old, a.verdict as new, case when q.place > p.place then 'improved' else 'regressed' end as change
from before b join after a using (id) join places p on p.verdict = b.verdict join places q on q.verdict = a.verdict where b.verdict <> a.verdict""")
def grade_diff(v: Views) -> DataFrame:
    questions, records, old = exams(v)
    return answers.grade_diff(answers.grade(questions, old), answers.grade(questions, records))


def pool(v: Views) -> DataFrame:
    """Candidates of each query with their texts."""
    found = retrieval.keyword_lane(asked(v), docs(v), 20)
    return stored(found.join(docs(v), "doc_id").select("query_id", F.col("doc_id").alias("item_id"), "rank", "text"), "pool")


POOL = POSTINGS + ", pool as (select query_id, doc_id as item_id, rank, text from keyword join documents using (doc_id) where rank <= 20)"


@query("evidence_sentences", f"""with {POOL},
cut as (select query_id, item_id, rank, list_filter({sentences("text")}, lambda s: len(string_split(s, ' ')) >= 4)[1:15] as s from pool),
rows as (select query_id, item_id, rank, unnest(s) as sentence, generate_subscripts(s, 1) as place from cut)
select query_id, item_id, cast(row_number() over (partition by query_id order by rank, item_id, place) as int) as n, sentence from rows qualify n <= 80""", False)
def evidence_sentences(v: Views) -> DataFrame:
    return answers.evidence_sentences(pool(v))


@query("extractive_answers", f"""with {POOL},
words as (select item_id as query_id, list_distinct({TOKENS.format("text")}) as q from benchmark),
cut as (select query_id, item_id, rank, {sentences("text")} as s from pool),
rows as (select query_id, item_id, rank, unnest(s) as sentence, generate_subscripts(s, 1) as place from cut),
met as (select r.*, len(list_intersect(q, list_distinct({TOKENS.format("sentence")}))) as overlap from rows r join words using (query_id)),
best as (select * from met where overlap > 0 qualify row_number() over (partition by query_id, sentence order by overlap desc, rank, item_id, place) = 1)
select query_id, cast(row_number() over (partition by query_id order by overlap desc, rank, item_id, place) as int) as n, item_id, sentence from best qualify n <= 3""", False)
def extractive_answers(v: Views) -> DataFrame:
    return answers.extractive_answers(asked(v), pool(v))


WORD = "'[a-z0-9]+'"


#: the lexical score of every row of a table `pool` (query_id, item_id, text)
RERANK = f"""
phrased as (select item_id as query_id, list_distinct({TOKENS.format("text")}) as q, array_to_string(regexp_extract_all(lower(text), {WORD}), ' ') as phrase from benchmark),
rows as (select p.*, q, phrase, {TOKENS.format("text")} as t, count(*) over (partition by query_id) as n from pool p join phrased using (query_id)),
held as (select *, list_intersect(q, list_distinct(t)) as held from rows),
df as (select query_id, term, count(*) as df from (select query_id, unnest(held) as term from held) group by all),
terms as (select query_id, term, round(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 6)::decimal(18, 6) as idf from (select query_id, unnest(q) as term from phrased) left join df using (query_id, term) join (select query_id, any_value(n) as n from rows group by 1) using (query_id)),
totals as (select query_id, sum(idf) as total from terms group by 1),
got as (select query_id, item_id, sum(idf) as got from (select query_id, item_id, unnest(held) as term from held) join terms using (query_id, term) group by all),
spots as (select *, list_filter(list_transform(t, lambda x, i: case when list_contains(q, x) then i end), lambda i: i is not null) as places from held),
reranked as (
select query_id, item_id, round(least(1.0, 0.75 * case when total > 0 then coalesce(got, 0)::double / total::double else 0 end
  + 0.15 * case when len(held) > 1 then least(1.0::double, len(held) * 3 / (list_max(places) - list_min(places) + 1)) else 0 end
  + case when length(phrase) > 8 and contains(array_to_string(regexp_extract_all(lower(text), {WORD}), ' '), phrase) then 0.15 else 0 end), 4) as score
from spots join totals using (query_id) left join got using (query_id, item_id))"""


@query("lexical_rerank", f"with {POOL}, {RERANK} select query_id, item_id, score from reranked", False)
def lexical_rerank(v: Views) -> DataFrame:
    return answers.rerank(asked(v), pool(v).drop("rank"))


@query("salient_coverage", f"""with {POOL},
weights as (select term, round(ln(1 + (greatest(n, df)::double - df + 0.5) / (df + 0.5)), 6)::decimal(18, 6) as weight from freq, total),
held as (select distinct query_id, unnest({TOKENS.format("text")}) as term from pool),
met as (select a.query_id, weight, h.term is not null as held from asked a join weights using (term) left join held h on h.query_id = a.query_id and h.term = a.term)
select query_id, round(coalesce(sum(weight) filter (held), 0)::double / sum(weight)::double, 6) as salient from met group by query_id""", False)
def salient_coverage(v: Views) -> DataFrame:
    weights = retrieval.term_weights(retrieval.doc_freq(retrieval.postings(docs(v), only=retrieval.query_terms(asked(v)))), docs(v).agg(F.count("*").alias("n")))
    return answers.salient_coverage(asked(v), pool(v), weights)


@query("one_copy", f"""with {POSTINGS}, {SIMHASH.strip()},
rows as (select k.query_id, k.doc_id, k.rank, simhash, source as family from keyword k join prints using (doc_id) join documents using (doc_id)),
gone as (select distinct b.query_id, b.doc_id from rows a join rows b on a.query_id = b.query_id and a.rank < b.rank and bit_count(xor(a.simhash, b.simhash)) <= 3 and a.family is distinct from b.family)
select query_id, doc_id, rank from keyword anti join gone using (query_id, doc_id)""", False)
def one_copy(v: Views) -> DataFrame:
    cands = stored(retrieval.keyword_lane(asked(v), docs(v)).select("query_id", "doc_id", "rank"), "candidates")
    found = docs(v).join(cands.select("doc_id").distinct(), "doc_id", "left_semi")
    return answers.one_copy(cands, stored(fingerprints.simhash(found), "prints"), v.table("documents").select("doc_id", F.col("source").alias("family")))


CLAIMS = """
, items as (select version_id as query_id, number as item_id, content as text from sections),
claims as (
  select version_id as query_id, number as claim_id, number + case when version_id % 7 = 0 then 10 else 0 end as item_id,
    case when version_id % 4 = 0 then 'The rate shall not exceed 6%.' when version_id % 4 = 1 then content when version_id % 4 = 2 then 'Nothing but other words here, on months.' else 'Months: ' || title end as text from sections)
"""


def claims(v: Views) -> tuple[DataFrame, DataFrame]:
    rows, k = v.sections(), F.col("version_id") % 4
    text = F.when(k == 0, "The rate shall not exceed 6%.").when(k == 1, F.col("content")).when(k == 2, "Nothing but other words here, on months.").otherwise(F.concat(F.lit("Months: "), F.col("title")))
    cited = F.col("number") + F.when(F.col("version_id") % 7 == 0, 10).otherwise(0)
    return rows.select(F.col("version_id").alias("query_id"), F.col("number").alias("claim_id"), cited.alias("item_id"), text.alias("text")), rows.select(F.col("version_id").alias("query_id"), F.col("number").alias("item_id"), F.col("content").alias("text"))


@query("check_claims", f"""{CLAIMS},
met as (select c.*, i.text as source, list_distinct({TOKENS.format("c.text")}) as w from claims c left join items i using (query_id, item_id))
select query_id, claim_id, item_id, case when source is null then 'unknown_citation' when len(list_filter({figures(plain("text"))}, lambda f: not list_contains({figures(plain("source"))}, f))) > 0 then 'figure'
  when len(w) > 0 and len(list_intersect(w, list_distinct({TOKENS.format("source")})))::double / len(w) < 0.35 then 'support' else 'ok' end as problem from met""")
def check_claims(v: Views) -> DataFrame:
    return answers.check_claims(*claims(v))


@query("unbound_figures", f"""{CLAIMS},
own as (select query_id, claim_id, item_id, list_filter({TOKENS.format("text")}, lambda w: regexp_matches(w, '^[a-z]')) as words, unnest({figures(plain("text"))}) as figure from claims),
spread as (select query_id, item_id, unnest({sentences("text")}) as s from items),
said as (select query_id, item_id, {figures(plain("s"))} as f, {TOKENS.format("s")} as w from spread),
bound as (select distinct query_id, claim_id, figure from own join said using (query_id, item_id) where list_contains(f, figure) and list_has_any(w, words))
select query_id, claim_id, figure from own semi join items using (query_id, item_id) anti join bound using (query_id, claim_id, figure)""")
def unbound_figures(v: Views) -> DataFrame:
    return answers.unbound_figures(*claims(v))


@query("dedupe_claims", f"""{CLAIMS},
rows as (select query_id, claim_id, item_id, list_sort({figures(plain("text"))}) as f, list_distinct({TOKENS.format("text")}) as w from claims),
firsts as (select b.query_id, b.claim_id, min(a.claim_id) as kept_id from rows a join rows b on a.query_id = b.query_id and a.f = b.f and a.claim_id < b.claim_id where len(list_filter(b.w, lambda x: not list_contains(a.w, x))) = 0 group by all),
owned as (select c.query_id, coalesce(kept_id, c.claim_id) as claim_id, c.item_id from claims c left join firsts using (query_id, claim_id))
select query_id, claim_id, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as cited from owned group by query_id, claim_id""")
def dedupe_claims(v: Views) -> DataFrame:
    return answers.dedupe_claims(claims(v)[0])


@query("verify_citations", """
, cited as (select policy_id as query_id, chunk_id as item_id, page_end as page from chunks join uploads using (document_id) where policy_id is not null),
seen as (select chunk_id as item_id from chunks join uploads using (document_id) where status = 'ready'), sizes as (select chunk_id as item_id, page_count from chunks join uploads using (document_id))
select query_id, c.item_id, (s.item_id is not null and coalesce(page between 1 and page_count, false)) as valid from cited c left join seen s using (item_id) left join sizes p using (item_id)""")
def verify_citations(v: Views) -> DataFrame:
    met = v.chunks().join(v.uploads().select("document_id", "policy_id", "status", "page_count"), "document_id").withColumnRenamed("chunk_id", "item_id")
    cited = met.filter("policy_id is not null").select(F.col("policy_id").alias("query_id"), "item_id", F.col("page_end").alias("page"))
    return answers.verify_citations(cited, met.filter("status = 'ready'"), met)


@query("apply_rules", f"""
, facts as ({facts_sql("sections", "version_id, number", "content")}),
wanted as (select c_custkey as query_id, c_custkey * 3 + 1 as version_id, c_acctbal as amount from customer)
select query_id, version_id * 10 + number as rule_id, kind, case when kind = 'amount' then amount::decimal(18, 4) > value::decimal(18, 4) end as above,
  case when kind = 'percent' then round(amount::decimal(18, 4) * value::decimal(18, 4) / 100, 4)::double end as part
from wanted join facts using (version_id) where kind in ('amount', 'percent')""")
def apply_rules(v: Views) -> DataFrame:
    from codicil.operators import compare

    facts = compare.numeric_facts(v.sections(), ["version_id", "number"]).select((F.col("version_id") * 10 + F.col("number")).alias("rule_id"), "version_id", "kind", "value")
    wanted = v.table("customer").select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") * 3 + 1).alias("version_id"), F.col("c_acctbal").alias("amount"))
    wanted = wanted.join(facts.select("version_id", "rule_id").distinct(), "version_id").select("query_id", "rule_id", "amount")
    return answers.apply_rules(wanted, facts.drop("version_id"))


SAID = """select event_id as query_id, ['What is the maximum salary for  housing?', 'probation rules for staff leave days', 'HL-12 interest limit on house', 'interest', 'Is the LTV, and the interest, for version 2 fixed?'][event_id % 5 + 1]
  || case when event_id % 3 = 0 then ' for ' || event_type else '' end as text from events"""
SWAPS = ", ".join(f"array_to_string(list_transform(string_split(normal, ' '), lambda w: case when lower(regexp_replace(w, '^[.,?!:;()\\[\\]]+|[.,?!:;()\\[\\]]+$', '', 'g')) = '{s}' then '{r}' else w end), ' ')" for s, r in answers.SYNONYMS.items())


@query("query_variants", f"""
with said as ({SAID}), n as (select query_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as normal from said),
every as (select query_id, case when regexp_matches(normal, '{answers.IDENTIFIER}') or len({TOKENS.format("normal")}) < 3 then [normal] else [normal, {SWAPS}] end as all_ from n),
rows as (select query_id, unnest(all_) as text, generate_subscripts(all_, 1) as i from every), firsts as (select query_id, text, min(i) as i from rows group by all)
select query_id, cast(row_number() over (partition by query_id order by i) - 1 as int) as variant, text from firsts qualify variant < 3""", False)
def query_variants(v: Views) -> DataFrame:
    text = pick(F.col("event_id"), "What is the maximum salary for  housing?", "probation rules for staff leave days", "HL-12 interest limit on house", "interest", "Is the LTV, and the interest, for version 2 fixed?")
    more = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" for "), F.col("event_type"))).otherwise("")
    return answers.query_variants(v.table("events").select(F.col("event_id").alias("query_id"), F.concat(text, more).alias("text")))


@query("fused_variants", f"""with {POSTINGS},
results as (select query_id, 0 as variant, doc_id, rank from keyword union all select query_id, 1, doc_id, rank from exact),
fused as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) as fused from results group by all)
select *, cast(row_number() over (partition by query_id order by fused desc, doc_id) as int) as rank from fused qualify rank <= 20""", False)
def fused_variants(v: Views) -> DataFrame:
    lane = lambda df, k: df.select("query_id", F.lit(k).alias("variant"), "doc_id", "rank")
    return answers.fuse_variants(lane(retrieval.keyword_lane(asked(v), docs(v)), 0).unionByName(lane(retrieval.exact_lane(asked(v), docs(v)), 1)))


TITLED = """
, asked_by as (select c_custkey as query_id, c_custkey as user_id, p_name || ' exceed months' as text from customer join part on p_partkey = c_custkey),
terms as (select query_id, unnest(list_distinct({tokens_q})) as term from asked_by),
scope_live as (select u.document_id, t.policy_id, p.organization_id, p.branch_id from uploads u join timeline t using (version_id) join policies p on p.policy_id = t.policy_id
  where u.status = 'ready' and t.effective_from <= {day} and (t.effective_to is null or t.effective_to > {day})),
open_chunks as (select chunk_id, title || ' ' || content as text, s.* from chunks c join scope_live s using (document_id)),
posts as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest({tokens}) as term from open_chunks) group by all), freq as (select term, count(*) as df from posts group by term), total as (select count(*) as n from open_chunks),
weighted as (select query_id, term, round(ln(1 + (greatest(n, df)::double - df + 0.5) / (df + 0.5)), 6) as weight from terms join freq using (term), total),
scored as (select query_id, chunk_id, cast(sum((2 * cast(round(weight * 1000000) as bigint) * tf + tf + 1) // (2 * (tf + 1))) as double) / 1000000 as score from posts join weighted using (term) group by all),
allowed as (
  select s.* from scored s join asked_by q using (query_id) join principals p on p.user_id = q.user_id join open_chunks r using (chunk_id)
  where r.organization_id = p.organization_id and (p.role = 'admin' or r.branch_id is null or r.branch_id = p.branch_id) and (p.role <> 'user' or exists (select 1 from assignments a where a.user_id = p.user_id and a.policy_id = r.policy_id)))
select query_id, chunk_id, score, cast(row_number() over (partition by query_id order by score desc, chunk_id) as int) as rank from allowed qualify rank <= 50"""


@query("scoped_search", TITLED.format(tokens=TOKENS.format("text"), tokens_q=TOKENS.format("text"), day=D))
def scoped_search(v: Views) -> DataFrame:
    chunks = retrieval.searchable(v.chunks().withColumn("content", F.concat_ws(" ", "title", "content")), v.uploads(), v.versions(), v.policies(), day())
    names = v.table("part").select(F.col("p_partkey").alias("query_id"), F.concat("p_name", F.lit(" exceed months")).alias("text"))
    asked_by = v.table("customer").select(F.col("c_custkey").alias("query_id"), F.col("c_custkey").alias("user_id")).join(names, "query_id")
    return retrieval.scoped_lane(asked_by, chunks, v.principals(), v.assignments())


@query("section_lane", f"""
with units as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
posts as (select doc_id, term, count(*) as tf from (select doc_id, unnest({TOKENS.format("text")}) as term from documents) group by all), freq as (select term, least(count(*), 20000) as df from posts group by term), total as (select count(*) as n from documents),
asked as (select item_id as query_id, unnest(list_distinct({TOKENS.format("text")})) as term from benchmark),
weighted as (select query_id, term, round(ln(1 + (greatest(n, df)::double - df + 0.5) / (df + 0.5)), 6) as weight from asked join freq using (term), total),
best as (select query_id, doc_id as section_id, cast(sum((2 * cast(round(weight * 1000000) as bigint) * tf + tf + 1) // (2 * (tf + 1))) as double) / 1000000 as section_score from posts join weighted using (term) group by query_id, doc_id),
top_sections as (select * from best qualify row_number() over (partition by query_id order by section_score desc, section_id) <= 200),
parts as (select doc_id * 100000 + i as chunk_id, term, count(*) as tf from (select doc_id, i, unnest({TOKENS.format("text")}) as term from units) group by all),
own as (select query_id, chunk_id, cast(sum((2 * cast(round(weight * 1000000) as bigint) * tf + tf + 1) // (2 * (tf + 1))) as double) / 1000000 as chunk_score from parts join weighted using (term) group by all),
met as (select b.query_id, section_id, doc_id * 100000 + i as chunk_id, section_score from top_sections b join units u on u.doc_id = b.section_id)
select m.query_id, section_id, m.chunk_id, round(0.6 * section_score + 0.4 * coalesce(chunk_score, 0), 6) as score, cast(row_number() over (partition by m.query_id order by round(0.6 * section_score + 0.4 * coalesce(chunk_score, 0), 6) desc, m.chunk_id) as int) as rank
from met m left join own o on o.query_id = m.query_id and o.chunk_id = m.chunk_id qualify rank <= 30""", False)
def section_lane(v: Views) -> DataFrame:
    units = docs(v).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "text"))
    chunks = units.select(F.col("doc_id").alias("section_id"), (F.col("doc_id") * 100000 + F.col("i") + 1).alias("chunk_id"), "text")
    return retrieval.section_lane(asked(v), docs(v).withColumnRenamed("doc_id", "section_id"), chunks)
