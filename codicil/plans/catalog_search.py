"""Queries over texts, vectors and fingerprints, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.functions import text
from codicil.operators import fingerprints, retrieval
from codicil.plans.views import Views
from codicil.sources import tables
from codicil.sources.scratch import stored

QUERIES, SQL = {}, {}
STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
TOKENS = f"list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '{text.TOKEN}'), lambda t: length(t) > 1 and t not in ({STOP}))"
NORMALISED = "list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z%.]+'), lambda w: trim(w, '.')), lambda w: w <> '')"
POSTINGS = f"""
posts as (select doc_id, term, count(*) as tf from (select doc_id, unnest({TOKENS.format("text")}) as term from documents) group by all),
freq as (select term, least(count(*), 20000) as df from posts group by term),
total as (select count(*) as n from documents),
asked as (select item_id as query_id, unnest(list_distinct({TOKENS.format("text")})) as term from benchmark),
chosen as (
  select query_id, term, df from (
    select a.query_id, a.term, f.df, n, row_number() over (partition by query_id order by f.df, a.term) as k, count(*) filter (f.df < least(20000, n * 0.2)) over (partition by query_id) as rare
    from asked a join freq f using (term), total)
  where n < 2000 or (k <= 10 and df < least(20000, n * 0.2)) or (rare = 0 and k <= 3)),
scored as (
  select query_id, doc_id, cast(sum(cast(round(round(ln(1 + (greatest(n, df)::double - df + 0.5) / (df + 0.5)), 6) * tf / (tf + 1), 6) as decimal(18, 6))) as double) as score, count(*) as n_terms
  from posts join chosen using (term), total group by query_id, doc_id),
keyword as (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank from scored qualify rank <= 50),
exact as (
  select item_id as query_id, doc_id, cast(row_number() over (partition by item_id order by doc_id) as int) as rank
  from benchmark b join documents d on contains(lower(d.text), lower(b.text)) qualify rank <= 20)"""


def query(name: str, sql: str | None):
    def add(build):
        QUERIES[name] = lambda spark, directory: build(Views(spark, directory))
        if sql:
            SQL[name] = sql
        return build

    return add


def asked(v: Views) -> DataFrame:
    return v.table("benchmark").select(F.col("item_id").alias("query_id"), "text")


def docs(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", "text")


@query("keyword_lane", f"with {POSTINGS} select * from keyword")
def keyword(v: Views) -> DataFrame:
    return retrieval.keyword_lane(asked(v), docs(v))


@query("exact_lane", f"with {POSTINGS} select * from exact")
def exact(v: Views) -> DataFrame:
    return retrieval.exact_lane(asked(v), docs(v))


@query("fused_search", f"""with {POSTINGS}, parts as (
  select query_id, doc_id, 1.5::double / (60 + rank) as part from exact union all select query_id, doc_id, 1.0::double / (60 + rank) from keyword),
fused as (select query_id, doc_id, round(sum(part), 5) as fused, cast(count(*) as int) as n_lanes from parts group by all)
select *, cast(row_number() over (partition by query_id order by fused desc, doc_id) as int) as rank from fused qualify rank <= 20""")
def fused(v: Views) -> DataFrame:
    return retrieval.fuse({"exact": retrieval.exact_lane(asked(v), docs(v)), "keyword": retrieval.keyword_lane(asked(v), docs(v))})


@query("doc_freq", f"with {POSTINGS} select term, df, round(ln(1 + (greatest(n, df)::double - df + 0.5) / (df + 0.5)), 6) as weight from freq, total")
def freq(v: Views) -> DataFrame:
    return retrieval.term_weights(retrieval.doc_freq(retrieval.postings(docs(v))), docs(v).agg(F.count("*").alias("n")))


@query("selective_terms", f"with {POSTINGS} select query_id, term, df from chosen")
def selective(v: Views) -> DataFrame:
    posts = retrieval.doc_freq(retrieval.postings(docs(v)))
    return retrieval.selective_terms(retrieval.query_terms(asked(v)), posts, docs(v).agg(F.count("*").alias("n")))


@query("unseen_terms", f"with {POSTINGS} select distinct query_id, term from asked where term not in (select term from freq)")
def unseen(v: Views) -> DataFrame:
    return retrieval.unseen_terms(asked(v), retrieval.doc_freq(retrieval.postings(docs(v))))


@query("vector_lane", """
with pairs as (
  select q.vec_id as query_id, r.vec_id as row_id, round(list_cosine_similarity(q.embedding::double[], r.embedding::double[]), 6) as cosine
  from embeddings q, embeddings r where q.vec_id % 20 = 0)
select *, cast(row_number() over (partition by query_id order by cosine desc, row_id) as int) as rank from pairs qualify rank <= 50""")
def vectors(v: Views) -> DataFrame:
    rows = v.table("embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("v"))
    return retrieval.vector_lane(rows.filter("row_id % 20 = 0").withColumnRenamed("row_id", "query_id"), rows)


@query("content_hash", f"select doc_id, sha256(array_to_string({NORMALISED}, ' ')) as content_hash from documents")
def hashes(v: Views) -> DataFrame:
    return fingerprints.content_hash(docs(v))


@query("exact_duplicates", f"""
with h as (select doc_id, sha256(array_to_string({NORMALISED}, ' ')) as content_hash from documents)
select doc_id, original_id from (select doc_id, min(doc_id) over (partition by content_hash) as original_id from h) where doc_id <> original_id""")
def duplicates(v: Views) -> DataFrame:
    return fingerprints.exact_duplicates(stored(fingerprints.content_hash(docs(v)), "hashes"))


HALF = " + ".join(f"(case when sum((({{0}} >> {b}) & 1) * 2 - 1) > 0 then {1 << b} else 0 end)::bigint" for b in range(32))
SIMHASH = f"""
words as (select doc_id, {NORMALISED} as w from documents),
shingles as (
  select doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [null] end) as s from words),
halves as (select doc_id, ('0x' || substr(md5(s), 1, 8))::bigint as hi, ('0x' || substr(md5(s), 9, 8))::bigint as lo from shingles),
parts as (select doc_id, {HALF.format("hi")} as hi, {HALF.format("lo")} as lo from halves group by doc_id),
prints as (select doc_id, (case when hi >= 2147483648 then hi - 4294967296 else hi end) * 4294967296 + lo as simhash from parts)"""


@query("simhash", f"with {SIMHASH} select doc_id, simhash from prints")
def simhash(v: Views) -> DataFrame:
    return fingerprints.simhash(docs(v))


@query("near_fingerprints", f"""with {SIMHASH}, groups as (select simhash, min(doc_id) as doc_id, count(*) as n from prints group by simhash)
select a.doc_id, b.doc_id as other_id, a.n as n_copies, b.n as n_other, cast(bit_count(xor(a.simhash, b.simhash)) as int) as distance
from groups a join groups b on a.doc_id < b.doc_id and bit_count(xor(a.simhash, b.simhash)) <= 3""")
def near(v: Views) -> DataFrame:
    return fingerprints.near_fingerprints(fingerprints.simhash(docs(v)))


TRIGRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("title_matches", f"""
with a as (select lower(trim(p_name)) as title, min(p_partkey) as left_id from part group by 1), g as (select left_id, {TRIGRAMS.format("title")} as g from a), s as (select left_id, len(g) as n, unnest(g) as t from g),
c as (select x.left_id, y.left_id as right_id, x.n as nx, y.n as ny, count(*) as c from s x join s y using (t) group by all)
select left_id, right_id, round(c::double / (nx + ny - c), 6) as similarity from c where round(c::double / (nx + ny - c), 6) >= 0.3""")
def titles(v: Views) -> DataFrame:
    part = v.table("part").select(F.col("p_partkey").alias("left_id"), F.col("p_name").alias("title"))
    return retrieval.match_candidates(part, part.withColumnRenamed("left_id", "right_id"), 0.3)


REDACTED = "text"
for pattern, mask in text.SECRETS:
    REDACTED = f"regexp_replace({REDACTED}, '{pattern.replace(chr(39), chr(39) * 2)}', '\\1{mask}', 'g')"
FOUND = " + ".join("len(regexp_extract_all(text, '{}'))".format(p.replace("'", "''")) for p, _ in text.SECRETS)


@query("redaction", f"select doc_id, source, {FOUND} as n_secrets, md5({REDACTED}) as redacted_md5 from documents")
def redaction(v: Views) -> DataFrame:
    body = F.col("text")
    return v.table("documents").select("doc_id", "source", text.secret_count(body).cast("long").alias("n_secrets"), F.md5(text.redacted(body)).alias("redacted_md5"))


@query("page_lines", """
with blocks as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) as body, generate_subscripts(string_split(coalesce(text, ''), chr(10) || chr(10)), 1) - 1 as block from documents),
lines as (select doc_id, block, unnest(string_split(body, chr(10))) as line, generate_subscripts(string_split(body, chr(10)), 1) - 1 as line_no from blocks)
select doc_id, count(*) as n_lines, max(block) as last_block, max(line_no) as last_line, sum(length(trim(line))) as n_chars from lines where trim(line) <> '' group by doc_id""")
def lines(v: Views) -> DataFrame:
    found = tables.page_lines(docs(v))
    return found.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.max("block").cast("long").alias("last_block"), F.max("line_no").cast("long").alias("last_line"), F.sum(F.length("line")).alias("n_chars")
    )


@query("token_estimate", "select doc_id, cast(greatest(1, ceil(length(text) / 4.0)) as int) as n_tokens from documents")
def estimate(v: Views) -> DataFrame:
    return docs(v).select("doc_id", text.token_estimate(F.col("text")).alias("n_tokens"))
