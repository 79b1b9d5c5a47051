"""Grading answers, and checking claims against the passages they cite, for whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.text import tokens

# How an answer refuses, corrects, or leaves something open.
REFUSAL = (
    r"not found|does not (?:contain|include|have|mention|specify)|no (?:provision|information|mention)|"
    r"not (?:mentioned|specified|available|provided|covered|stated|present)|isn't|is not (?:in|part)"
)
CORRECTION = r"\b(?:incorrect|not correct|not accurate|not right|wrong|actually|rather|not\s+\d)"
OPEN = r"not (?:explicitly |specifically )?(?:stated|specified|mentioned)"
# Words of an expected answer that say nothing.
SMALL_WORDS = "the and with for only from that this must shall should will member after before more than into under each once every".split()
# Verdicts from worst to best.
VERDICTS = ["ERROR", "WRONG", "NO ANSWER", "PARTIAL", "CORRECT"]
# Words that another word may stand for in a query.
SYNONYMS = {"probation": "probationary employment", "housing": "home loan", "house": "home loan", "ltv": "loan to value", "salary": "income", "maximum": "limit", "interest": "interest rate"}
IDENTIFIER = r"\b[A-Za-z]{1,10}[-/]\w+|\b\d+(?:\.\d+){1,4}\b|\b(?:[vV]|[vV]ersion)\s*\d+\b"


def plain(text: Column) -> Column:
    """Lower case, one way to write rupees, dashes, digits and per cents, single spaces."""
    t = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "₹", "rs "), r"rs\.", "rs ")
    t = F.regexp_replace(t, "–", "-")
    for _ in range(2):  # neighbouring groups share a digit
        t = F.regexp_replace(t, r"(\d),(\d)", "$1$2")
    return F.regexp_replace(F.regexp_replace(t, r"(\d)\s+%", "$1%"), r"\s+", " ")


def figures(text: Column) -> Column:
    """Distinct figures of a `plain` text without version labels and written dates; zeros after the point go."""
    t = F.regexp_replace(F.regexp_replace(text, r"\bv\d+(\.\d+)?\b", " "), r"\b\d{1,2}-[a-z]{3}-\d{4}\b", " ")
    found = F.regexp_extract_all(t, F.lit(r"(\d+(?:\.\d+)?%?)"))
    return F.array_distinct(F.transform(found, lambda f: F.regexp_replace(F.regexp_replace(f, r"(\.\d*?)0+(%?)$", "$1$2"), r"\.(%?)$", "$1")))


def grade(rows: DataFrame, records: DataFrame) -> DataFrame:
    """A verdict for each question (id, behavior, expected) from its record (id, status, answer), which may be missing.

    A crash is an error; where silence is right, refusing is; else figures of the expected answer, or its words of four
    letters and more, must be in the answer: all of them, some, or none. A figure is the same if it is the same number.
    """
    met = rows.join(records, "id", "left").withColumn("a", plain(F.col("answer"))).withColumn("e", plain(F.col("expected")))
    met = met.withColumn("wanted", figures(F.col("e"))).withColumn("said", figures(F.col("a")))
    words = F.filter(F.regexp_extract_all("e", F.lit(r"([a-z][a-z-]{3,})")), lambda w: ~w.isin(SMALL_WORDS))
    met = met.withColumn("words", words).withColumn("n", F.when(F.size("wanted") > 0, F.size("wanted")).otherwise(F.size("words")))
    in_figures = F.size(F.filter("wanted", lambda f: F.array_contains("said", f) | F.array_contains("said", F.concat(f, F.lit("%")))))
    hits = F.when(F.size("wanted") > 0, in_figures).otherwise(F.size(F.filter("words", lambda w: F.contains("a", w))))
    met = met.withColumn("hits", hits)
    refuses, some = F.rlike("a", F.lit(REFUSAL)), F.when(F.col("hits") > 0, "PARTIAL").otherwise("WRONG")
    verdict = (
        F.when(F.col("status") == "CRASH", "ERROR")
        .when(F.col("behavior") == "abstain", F.when((F.col("status") == "no_answer") | refuses, "CORRECT").otherwise("WRONG"))
        .when((F.col("behavior") == "answer_absent") & (F.col("status") == "no_answer"), "PARTIAL")
        .when(F.col("behavior") == "answer_absent", F.when(refuses | F.rlike("a", F.lit(r"\bno\b")), "CORRECT").otherwise("WRONG"))
        .when(~F.coalesce(F.col("status") == "answered", F.lit(False)) | F.rlike("a", F.lit(OPEN)), "NO ANSWER")
        .when((F.col("behavior") == "correct_premise") & ~F.rlike("a", F.lit(CORRECTION)), some)
        .when((F.col("n") > 0) & (F.col("hits") == F.col("n")), "CORRECT").otherwise(some)
    )
    return met.select("id", verdict.alias("verdict"))


def grade_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Questions whose verdict differs between two gradings, and whether for the better."""
    place = F.create_map(*[F.lit(x) for i, v in enumerate(VERDICTS) for x in (v, i)])
    met = before.select("id", F.col("verdict").alias("old")).join(after.select("id", F.col("verdict").alias("new")), "id").filter("old <> new")
    return met.select("id", "old", "new", F.when(place[F.col("new")] > place[F.col("old")], "improved").otherwise("regressed").alias("change"))


def sentences(text: Column) -> Column:
    """Sentences with single spaces: cut after a mark that white space follows, and at line feeds."""
    return F.filter(F.transform(F.split(text, r"(?<=[.;!?])\s+|\n+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")


def evidence_sentences(items: DataFrame, most: int = 80, each: int = 15, least_words: int = 4) -> DataFrame:
    """Numbered sentences of each query's passages (query_id, item_id, rank, text): short ones go, at most `each` of a passage
    and `most` of a query, in the order of rank and place."""
    rows = items.select("query_id", "item_id", "rank", F.posexplode(F.slice(F.filter(sentences(F.col("text")), lambda s: F.size(F.split(s, " ")) >= least_words), 1, each)).alias("place", "sentence"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item_id", "place"))
    return rows.withColumn("n", number).filter(F.col("n") <= most).select("query_id", "item_id", "n", "sentence")


def extractive_answers(queries: DataFrame, items: DataFrame, most: int = 3) -> DataFrame:
    """The `most` distinct sentences of a query's passages that share most of its terms; of equals those of better ranks first."""
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("q"))
    rows = items.select("query_id", "item_id", "rank", F.posexplode(sentences(F.col("text"))).alias("place", "sentence")).join(asked, "query_id")
    rows = rows.withColumn("overlap", F.size(F.array_intersect("q", tokens(F.col("sentence"))))).filter("overlap > 0")
    best = Window.partitionBy("query_id", "sentence").orderBy(F.desc("overlap"), "rank", "item_id", "place")
    rows = rows.withColumn("k", F.row_number().over(best)).filter("k = 1")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank", "item_id", "place"))
    return rows.withColumn("n", place).filter(F.col("n") <= most).select("query_id", "n", "item_id", "sentence")


def check_claims(claims: DataFrame, items: DataFrame, least: float = 0.35) -> DataFrame:
    """What is wrong with each claim (query_id, claim_id, item_id, text): its passage is not among the query's, a figure is not in
    it, or under `least` of its words are; else ``ok``."""
    met = claims.join(items.select("query_id", "item_id", F.col("text").alias("source")), ["query_id", "item_id"], "left")
    numbers = lambda c: figures(plain(F.col(c)))
    words = F.array_distinct(tokens(F.col("text")))
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, tokens(F.col("source")))) / F.size(words)).otherwise(1.0)
    problem = F.when(F.col("source").isNull(), "unknown_citation").when(F.size(F.array_except(numbers("text"), numbers("source"))) > 0, "figure").when(share < least, "support").otherwise("ok")
    return met.select("query_id", "claim_id", "item_id", problem.alias("problem"))


def unbound_figures(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Figures of a claim that no single sentence of its passage has together with one of the claim's words."""
    word = F.filter(tokens(F.col("text")), lambda w: F.rlike(w, F.lit("^[a-z]")))
    own = claims.select("query_id", "claim_id", "item_id", word.alias("words"), F.explode(figures(plain(F.col("text")))).alias("figure"))
    rows = items.select("query_id", "item_id", F.transform(sentences(F.col("text")), lambda s: F.struct(figures(plain(s)).alias("f"), tokens(s).alias("w"))).alias("s"))
    met = own.join(rows, ["query_id", "item_id"])
    bound = F.exists("s", lambda s: F.array_contains(s["f"], F.col("figure")) & F.arrays_overlap(s["w"], F.col("words")))
    return met.filter(~bound).select("query_id", "claim_id", "figure")


def dedupe_claims(claims: DataFrame) -> DataFrame:
    """Claims without those that repeat an earlier one of their query: the same figures, and no word that it lacks.

    Pairs meet by query and figures. Returns query_id, claim_id of the claims that stay, and the passages cited by them and
    by what repeats them directly."""
    rows = claims.select("query_id", "claim_id", "item_id", F.array_sort(figures(plain(F.col("text")))).alias("f"), F.array_distinct(tokens(F.col("text"))).alias("w"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.f") == F.col("b.f")) & (F.col("a.claim_id") < F.col("b.claim_id")))
    # the first claim that says all of it; being a subset is transitive, so that one stays itself
    first = met.filter(F.size(F.array_except("b.w", "a.w")) == 0).groupBy(F.col("b.query_id").alias("query_id"), F.col("b.claim_id").alias("claim_id")).agg(F.min("a.claim_id").alias("kept_id"))
    owned = claims.join(first, ["query_id", "claim_id"], "left").select("query_id", F.coalesce("kept_id", "claim_id").alias("claim_id"), "item_id")
    return owned.groupBy("query_id", "claim_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("item_id").cast("string"))), ",").alias("cited"))


def verify_citations(cited: DataFrame, seen: DataFrame, pages: DataFrame) -> DataFrame:
    """Citations (query_id, item_id, page) with a flag: the passage is among the rows that may be seen now, and its page exists."""
    live = seen.select("item_id").distinct().withColumn("live", F.lit(True))
    met = cited.join(live, "item_id", "left").join(pages.select("item_id", "page_count"), "item_id", "left")
    return met.select("query_id", "item_id", (F.coalesce("live", F.lit(False)) & F.coalesce(F.col("page").between(1, F.col("page_count")), F.lit(False))).alias("valid"))


def apply_rules(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """Amounts of queries (query_id, rule_id, amount) against a rule's level (rule_id, kind, value): above or not for an amount, the
    part of the amount for a per cent."""
    met = asked.join(facts.filter(F.col("kind").isin("amount", "percent")), "rule_id")
    level = F.col("value").cast("decimal(18,4)")
    part = F.when(F.col("kind") == "percent", F.round(F.col("amount").cast("decimal(18,4)") * level / 100, 4)).cast("double")
    above = F.when(F.col("kind") == "amount", F.col("amount").cast("decimal(18,4)") > level)
    return met.select("query_id", "rule_id", "kind", above.alias("above"), part.alias("part"))


def rerank(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Lexical score of each candidate (query_id, item_id, text): three quarters for the weight of the query's terms it holds,
    by their rarity among the query's candidates, up to 0.15 for their closeness, and 0.15 for the whole phrase; at most 1."""
    word = r"([a-z0-9]+)"
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("q"), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(word)), " ").alias("phrase"))
    rows = items.join(asked, "query_id").withColumn("t", tokens(F.col("text")))
    rows = rows.withColumn("held", F.array_intersect("q", "t")).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    df = rows.select("query_id", "n", F.explode("held").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("df"))
    terms = asked.select("query_id", F.explode("q").alias("term")).join(df, ["query_id", "term"], "left").fillna(0, ["df"])
    terms = terms.join(rows.groupBy("query_id").agg(F.first("n").alias("n")), "query_id").withColumn("idf", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6))
    idf = terms.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("idf"), F.sum(F.col("idf").cast("decimal(18,6)")).alias("all"))
    met = rows.join(idf, "query_id")
    total = F.aggregate("held", F.lit(0).cast("decimal(18,6)"), lambda s, t: (s + F.col("idf")[t].cast("decimal(18,6)")).cast("decimal(18,6)"))
    spots = F.filter(F.transform("t", lambda t, i: F.when(F.array_contains("q", t), i)), lambda i: i.isNotNull())
    span = F.array_max(spots) - F.array_min(spots) + 1
    near = F.when(F.size("held") > 1, F.least(F.lit(1.0), F.size("held") * 3 / span)).otherwise(0.0)
    body = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(word)), " ")
    phrase = F.when((F.length("phrase") > 8) & F.contains(body, F.col("phrase")), 0.15).otherwise(0.0)
    cover = F.when(F.col("all") > 0, total.cast("double") / F.col("all").cast("double")).otherwise(0.0)
    return met.select("query_id", "item_id", F.round(F.least(F.lit(1.0), 0.75 * cover + 0.15 * near + phrase), 4).alias("score"))


def salient_coverage(queries: DataFrame, items: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of the weight of each query's terms that any of its passages holds, to six places; terms without a weight count 0."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).join(weights.select("term", "weight"), "term")
    held = items.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct().withColumn("held", F.lit(True))
    met = terms.join(held, ["query_id", "term"], "left")
    w = F.col("weight").cast("decimal(18,6)")
    total, got = F.sum(w), F.sum(F.when(F.col("held"), w).otherwise(F.lit(0).cast("decimal(18,6)")))
    return met.groupBy("query_id").agg(F.round(F.when(total > 0, got.cast("double") / total.cast("double")).otherwise(0.0), 6).alias("salient"))


def one_copy(cands: DataFrame, prints: DataFrame, families: DataFrame, bits: int = 3) -> DataFrame:
    """Candidates (query_id, doc_id, rank) without those whose text is within `bits` bits of a better candidate's, unless both
    documents are of one family (doc_id, family), such as versions of one policy. Pairs form within the candidates of a query."""
    rows = cands.join(prints, "doc_id").join(families, "doc_id", "left")
    a, b = rows.alias("a"), rows.alias("b")
    near = F.bit_count(F.col("a.simhash").bitwiseXOR(F.col("b.simhash"))) <= bits
    met = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank")) & near & ~F.col("a.family").eqNullSafe(F.col("b.family")))
    gone = met.select(F.col("b.query_id").alias("query_id"), F.col("b.doc_id").alias("doc_id")).distinct()
    return cands.join(gone, ["query_id", "doc_id"], "left_anti")


def query_variants(queries: DataFrame, most: int = 3) -> DataFrame:
    """Each query and variants with a word swapped for its synonym, `most` in all; none for queries that name an identifier
    or a version or have fewer than three terms."""
    normal = F.trim(F.regexp_replace("text", r"\s+", " "))
    rows = queries.select("query_id", normal.alias("normal")).withColumn("fixed", F.rlike("normal", F.lit(IDENTIFIER)) | (F.size(tokens(F.col("normal"))) < 3))
    bare = lambda w: F.lower(F.regexp_replace(w, r"^[.,?!:;()\[\]]+|[.,?!:;()\[\]]+$", ""))
    swap = lambda said, other: F.array_join(F.transform(F.split("normal", " "), lambda w: F.when(bare(w) == said, other).otherwise(w)), " ")
    swapped = [swap(said, other) for said, other in SYNONYMS.items()]
    every = F.when(F.col("fixed"), F.array("normal")).otherwise(F.slice(F.array_distinct(F.array("normal", *swapped)), 1, most))
    return rows.select("query_id", F.posexplode(every).alias("variant", "text"))


def fuse_variants(results: DataFrame, k: int = 20, offset: int = 60) -> DataFrame:
    """Best rows of a query over its variants (query_id, variant, doc_id, rank): the sum of 1 / (offset + rank), to six places."""
    fused = results.groupBy("query_id", "doc_id").agg(F.round(F.sum(1 / (offset + F.col("rank"))), 6).alias("fused"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "doc_id")).cast("int")
    return fused.withColumn("rank", rank).filter(F.col("rank") <= k)
