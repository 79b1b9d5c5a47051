"""Registered queries of the training-data operators, with their production parameters, and SQL where it can say them."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.llm import hilbert, hmm, imatch, jaccard_join, mixing, permutation, pieces, rans, repeats, residues, runs, url_filter
from codicil.llm import toxicity as toxicity_
from codicil.llm.common import crc32_text

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.document_tree(), mixing.DOCUMENT_WEIGHTS, percent=150, max_epochs=4, seed=7)


def public_file(name: str, variable: str) -> str:
    """File of a public tokenizer; the environment variable overrides it."""
    if variable in os.environ:
        return os.environ[variable]
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(read(spark, sf_dir, "documents"), public_file("byte_bpe_50k.json", "BYTE_TOKENIZER"), end_id=2)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprint_with_edits(read(spark, sf_dir, "documents"))


def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = hilbert.shard_by_curve(docs, 24, hilbert.document_dimensions())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents"), public_file("piece_bpe_32k.model", "PIECE_MODEL"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_components(read(spark, sf_dir, "documents"))


def op11_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(read(spark, sf_dir, "documents"))


def with_periods(docs: DataFrame) -> DataFrame:
    """Texts of which, where crc32(doc_id) ends in 0, the words from some place on repeat the first few of them."""
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = crc32_text(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    docs = docs.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    left = F.col("n") - F.col("a")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(left / F.col("p")).cast("int"))), F.lit(1), left)
    edited = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return docs.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), edited).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_periods(read(spark, sf_dir, "documents").select("doc_id", "text")))
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    best = F.expr(f"aggregate(runs, cast(null as {kind}), (b, r) -> case when b is null or r.length * b.period > b.length * r.period then r else b end)")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    out = found.withColumn("best", best).select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", lines.alias("lines"), "collapsed")
    milli = F.expr("1000 * length div period")
    return out.select("doc_id", "n_runs", "start", "length", "period", milli.alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_residues(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return residues.hard_negatives(vectors, vectors.filter("vec_id % 100 = 0"), label=label)


QUERIES = {"op1_mixing": op1_mixing, "op2_rans": op2_rans, "op3_toxicity": op3_toxicity, "op4_permutation": op4_permutation, "op8_repeats": op8_repeats, "op9_pieces": op9_pieces, "op10_jaccard_join": op10_jaccard_join, "op5_imatch": op5_imatch, "op6_hilbert": op6_hilbert, "op7_url_filter": op7_url_filter}
QUERIES |= {"op11_hmm": op11_hmm, "op12_runs": op12_runs, "op13_residues": op13_residues}

SQL: dict[str, str] = {}

SQL["op7_url_filter"] = """
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substring(url, strpos(url, '://') + 3) end as rest from pages),
split as (
  select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2), '') as path from parts),
rules(r_host, r_path, r_verdict) as (values %s),
met as (
  select s.*, r_host || r_path as rule, r_verdict,
    row_number() over (partition by page_id order by length(r_host) + length(r_path) desc, length(r_host) desc, r_verdict desc) as k
  from split s left join rules r on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
select page_id, host, path, rule, coalesce(r_verdict, 'allow') as verdict from met where k = 1
""" % ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

SPLIT = r"[\x09-\x0D\x20\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"  # white space and ASCII punctuation
KEPT = [f"('0x' || substr(md5('{k}:' || term), 1, 4))::int < {int(keep * 65536)}" if k else "true" for k, keep in enumerate(imatch.KEEPS)]
NO_TERMS = "repeat('=' || substr(md5(case when array_to_string(list_sort(terms), ' ') = '' then text else array_to_string(list_sort(terms), ' ') end), 1, 11), %d)" % len(imatch.KEEPS)
BOTH_EMPTY = " + ".join(f"(case when x{k} = '-' and y{k} = '-' then 0 else 1 end)" for k in range(len(imatch.KEEPS)))
SAME = " + ".join(f"(case when x{k} = y{k} and x{k} <> '-' then 1 else 0 end)" for k in range(len(imatch.KEEPS)))


def _likeness(other: str) -> str:
    """SQL of the likeness of print `a` and the other."""
    read = lambda expression: re.sub(r"([xy])(\d+)", lambda m: f"{'a' if m[1] == 'x' else other}.h[{int(m[2]) + 1}]", expression)
    return f"case when a.print = {other}.print then 1.0 when len(a.h) = 0 or len({other}.h) = 0 then 0.0 else ({read(SAME)})::double / ({read(BOTH_EMPTY)}) end::double"


SQL["op5_imatch"] = f"""
with base as (select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id nulls first, coalesce(text, '')) as spot from documents),
n as (select count(*) as total from base),
chained as (select *, coalesce(lead(text) over (order by spot), first_value(text) over (order by spot)) as following, length(text) as chars from base),
edited as (select *, substr(text, 1, chars - chars // 2) || substr(following, 1, chars // 2) as edit from chained),
every as (select spot, 'own' as kind, text from edited union all select spot, 'edit', edit from edited),
worded as (select *, list_filter(list_distinct(regexp_split_to_array(lower(text), '{SPLIT}')), lambda t: t <> '') as terms from every),
freq as (select term, count(*) as df from (select unnest(terms) as term from worded where kind = 'own') group by term),
lexicon as (select term, [{", ".join(KEPT)}] as keeps from freq, n where ln(total::double / df::double) between 1.5 and 6.0),
held as (select spot, kind, term, keeps from (select spot, kind, unnest(terms) as term from worded) join lexicon using (term)),
hashed as (
  select spot, kind, [{", ".join(f"case when count(*) filter (keeps[{k + 1}]) = 0 then '-' else substr(md5(string_agg(term, ' ' order by term) filter (keeps[{k + 1}])), 1, 12) end" for k in range(len(imatch.KEEPS)))}] as h
  from held group by spot, kind),
prints as (select spot, kind, coalesce(h, []) as h, case when h is null then {NO_TERMS} else array_to_string(h, '') end as print from worded left join hashed using (spot, kind))
select e.doc_id, e.chars as n_chars, sha256(e.edit) as edited_sha256, a.print as fingerprint, b.print as edited_fingerprint, {_likeness("b")} as near_edited, {_likeness("c")} as near_next
from edited e cross join n join prints a on a.spot = e.spot and a.kind = 'own' join prints b on b.spot = e.spot and b.kind = 'edit'
  join prints c on c.spot = case when e.spot = total then 1 else e.spot + 1 end and c.kind = 'own'
"""

LEVELS = ", ".join(mixing.LEVELS)


def _share(keys: str, level: str) -> str:
    """SQL that divides parents' budgets among the nodes of a level, as `mixing.share_out` does."""
    names = mixing.DOCUMENT_WEIGHTS[level]
    weight = "case " + " ".join(f"when {level} = '{n}' then {w}" for n, w in names.items()) + f" else {mixing.OTHER_WEIGHT} end" if names else str(mixing.OTHER_WEIGHT)
    upper = f"budget_{keys.split(', ')[-1]}" if keys else "budget_all"
    part = f"partition by {keys}" if keys else ""
    join = f"join {upper} using ({keys})" if keys else f", {upper}"
    group = f"{keys}, {level}" if keys else level
    return f"""
nodes_{level} as (select {group}, sum(tokens) * 4 as capacity, {weight} as weight from leaves group by all),
a_{level} as (select n.*, budget, coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0) as taken,
    sum(weight) over (w rows between current row and unbounded following) as left_weight
  from nodes_{level} n {join} window w as ({part} order by capacity::double / weight, {level})),
b_{level} as (select *, capacity * left_weight <= (budget - taken) * weight as is_full from a_{level}),
c_{level} as (select *, budget - coalesce(sum(case when is_full then capacity end) over ({part}), 0) as rest, sum(case when not is_full then weight end) over ({part}) as rest_weight,
    coalesce(sum(case when not is_full then weight end) over ({part} order by {level}), 0) as run from b_{level}),
budget_{level} as (select {group}, cast(case when is_full then capacity else (rest * run) // rest_weight - (rest * (run - weight)) // rest_weight end as hugeint) as budget from c_{level})"""


def _place(epoch: str) -> str:
    return f"('0x' || substr(md5('7:' || {epoch} || ':' || doc_id), 1, 12))::bigint"


SQL["op1_mixing"] = f"""
with numbered as (select *, try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) as number from documents),
tokens as (
  select case number % 4 when 0 then 'web' when 1 then 'books' when 2 then 'code' else 'reference' end as domain, coalesce(lang, '') as language, coalesce(source, '') as origin, doc_id,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as n_tokens from numbered),
kept as (select * from tokens where n_tokens > 0),
leaves as (select {LEVELS}, sum(n_tokens) as tokens, count(*) as n_rows from kept group by all),
budget_all as (select least(coalesce(sum(tokens), 0) * 150 // 100, coalesce(sum(tokens), 0) * 4) as budget from leaves),
{_share("", "domain")},{_share("domain", "language")},{_share("domain, language", "origin")},
plan as (select {LEVELS}, budget // tokens as whole, budget % tokens as rest from leaves join budget_origin using ({LEVELS})),
met as (select k.*, whole, rest, {_place("whole")} as place from kept k join plan using ({LEVELS})),
cut as (select *, sum(n_tokens) over (partition by {LEVELS} order by place, doc_id rows unbounded preceding) - n_tokens as start from met)
select {LEVELS}, doc_id, cast(unnest(range(cast(whole as bigint))) as bigint) as epoch, cast(n_tokens as bigint) as n_tokens, cast(n_tokens as bigint) as take_tokens from met
union all select {LEVELS}, doc_id, cast(whole as bigint), cast(n_tokens as bigint), cast(least(n_tokens, rest - start) as bigint) from cut where start < rest
"""

SQL["op13_residues"] = """
with fine as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as int) as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
usual as (select len(v) as n from fine group by all order by count(*) desc, n limit 1),
held as (select * from fine where len(v) = (select n from usual)),
met as (
  select a.vec_id as anchor, r.vec_id as other, r.label = a.label as alike, cast(list_dot_product(a.v, r.v) as bigint) as score
  from held a join held r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
positive as (select *, row_number() over (partition by anchor order by score desc, other) as place from met where alike qualify place <= 5),
ranked as (
  select p.anchor as anchor_id, p.other as positive_id, cast(row_number() over (partition by p.anchor, p.place order by n.score desc, n.other) as int) as rank, n.other as negative_id,
    p.score as positive_score, n.score as negative_score
  from positive p join met n on n.anchor = p.anchor and not n.alike and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
select * from ranked where rank <= 5
"""
