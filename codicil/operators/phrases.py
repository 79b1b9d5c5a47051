"""What texts repeat, define and rule: key phrases, acronyms, stems of their words, and extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.stems import stem
from codicil.functions.text import tokens
from codicil.operators.compare import sentences
from codicil.sources.scratch import stored

# What ends a clause, words that no phrase begins or ends with, those that may join two, and those without a subject.
CLAUSE_END = "[\\n,;:/()|•–—.?!\"“”‘’]+"
FUNCTION_WORDS = (
    "a an and are as at be by can do does for from has have i in is it of on or shall should that the their this to was "
    "what when where which who will with any all such may other its not been being these those under per also into than "
    "then there our we you your they them he she his her us no nor so if each every same up out more most must would could "
    "against between within without about over upon via"
).split()
JOINERS = "of and for to in on".split()
GENERIC = (
    "policy policies bank banks document documents version page chapter section sections annexure annex table contents "
    "guidelines circular manual procedure framework year years date limited ltd office head chief group executive "
    "director directors officer general manager"
).split()
LEAST_COUNT = 3
CONNECTORS = "of and for the in on to by with & a an".split()
RULE = r"(?i)\b(shall|must|not exceed|minimum|maximum|required|mandatory|at least|up to)\b|\d"
ACTION = r"(?i)\b(must|shall submit|shall obtain|shall ensure|required to|should|apply|report)\b"
EXCEPTION = r"(?i)\b(except|unless|exempt|does not apply|shall not apply|excluding)\b"
PURPOSE = r"(?i)\b(purpose|objective|scope|introduction)\b"
QUOTAS = {"overview": 2, "purpose": 1, "rule": 8, "action": 5, "exception": 5}
PREFIX = 5


def key_phrases(docs: DataFrame, limit: int = 3) -> DataFrame:
    """The `limit` phrases of two to four words that a document (doc_id, text, name) repeats most.

    Phrases lie inside a clause, begin and end with words that carry meaning, hold only joining words beside these, name a
    subject that is not mostly the document's name, and occur three times. Most words in all come first, then order of letters;
    a phrase inside a better one, or around one, is left out. Returns doc_id, place, phrase, n. The phrases of a document that
    occur three times are folded in its row.
    """
    clauses = F.filter(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), CLAUSE_END), lambda c: F.regexp_extract_all(c, F.lit(r"([a-z]+)"))), lambda c: F.size(c) > 1)
    grams = lambda c: F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.lit(4), F.size(c))), lambda n: F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.slice(c, i, n))))
    named = F.regexp_extract_all(F.lower(F.coalesce("name", F.lit(""))), F.lit(r"([a-z0-9]+)"))
    rows = docs.select("doc_id", named.alias("named"), F.explode(clauses).alias("c")).select("doc_id", "named", F.explode(grams(F.col("c"))).alias("g"))
    fits = ~F.get("g", 0).isin(FUNCTION_WORDS) & ~F.element_at("g", -1).isin(FUNCTION_WORDS) & ~F.exists("g", lambda w: (w.isin(FUNCTION_WORDS) | (F.length(w) < 3)) & ~w.isin(JOINERS))
    subject = F.filter("g", lambda w: ~w.isin(FUNCTION_WORDS) & ~w.isin(GENERIC))
    rows = rows.filter(fits).withColumn("s", subject).filter((F.size("s") > 0) & (2 * F.size(F.filter("s", lambda w: F.array_contains("named", w))) <= F.size("s")))
    counts = rows.groupBy("doc_id", F.array_join("g", " ").alias("phrase")).agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    order = F.struct((-F.col("n") * F.size(F.split("phrase", " "))).alias("w"), "phrase", "n")
    ranked = counts.groupBy("doc_id").agg(F.sort_array(F.collect_list(order)).alias("all"))
    none = F.array().cast("array<struct<w:bigint,phrase:string,n:bigint>>")
    nested = lambda acc, x: F.exists(acc, lambda y: F.contains(y["phrase"], x["phrase"]) | F.contains(x["phrase"], y["phrase"]))
    picked = F.aggregate("all", none, lambda acc, x: F.when((F.size(acc) < limit) & ~nested(acc, x), F.array_append(acc, x)).otherwise(acc))
    return ranked.select("doc_id", F.posexplode(picked).alias("place", "p")).select("doc_id", F.col("place") + 1, "p.phrase", "p.n").toDF("doc_id", "place", "phrase", "n")


def spells(acronym: Column, expansion: Column) -> Column:
    """Whether an expansion of 2 to 12 words spells an acronym: it begins with its first letter and has its letters in order,
    joining words apart, and does not repeat it."""
    words = F.regexp_extract_all(expansion, F.lit(r"([A-Za-z][A-Za-z-]*)"))
    carrying = F.filter(words, lambda w: ~F.lower(w).isin(CONNECTORS))
    letters = F.regexp_replace(F.lower(F.array_join(carrying, "")), "[^a-z]", "")
    in_order = F.concat(F.lit("^"), F.array_join(F.split(F.regexp_replace(F.lower(acronym), "[^a-z]", ""), ""), ".*"))
    fits = F.size(words).between(2, 12) & (F.length(expansion) <= 160) & (F.size(carrying) > 0)
    return fits & ~F.array_contains(F.transform(F.regexp_extract_all(expansion, F.lit(r"(\w+)")), F.upper), F.upper(acronym)) & F.rlike(letters, in_order)


def acronyms(chunks: DataFrame) -> DataFrame:
    """Acronyms that chunks (chunk_id, text) define, with their expansions and the way it is done.

    In a table row (``HVDC | High Voltage Direct Current``, labels of cells apart), a line (``HVDC - High ...``), two lines, or in
    text (``State Transmission Utilities (STUs)``: made singular). Only expansions that spell the acronym count (`spells`); in text
    the shortest run of words before the bracket that begins with a capital. Returns chunk_id, acronym, expansion, way; distinct.
    """
    upper = r"[A-Z][A-Z0-9&-]{1,9}"
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.transform(F.split(text, r"\n"), F.trim), lambda x: x != "")
    rows = chunks.select("chunk_id", text.alias("text"), lines.alias("l"))
    spread = rows.select("chunk_id", "l", F.posexplode("l").alias("i", "line"))
    cells = F.transform(F.split("line", r" \| "), lambda c: F.trim(F.regexp_replace(F.trim(c), r"^[^:|]{1,40}:\s*", "")))
    told = lambda way, acronym, expansion: F.struct(F.lit(way).alias("way"), acronym.alias("acronym"), expansion.alias("expansion"))
    is_acronym = lambda c: F.rlike(c, F.lit(f"^{upper}$"))
    same = rf"^({upper})\s*(?:[-—–:]\s*|\s{{2,}})(.+)$"
    row = F.when((F.size(cells) >= 2) & is_acronym(cells[0]), told("row", cells[0], cells[1])).when(
        F.rlike("line", F.lit(same)), told("line", F.regexp_extract("line", same, 1), F.trim(F.regexp_extract("line", same, 2)))
    ).when(is_acronym(F.col("line")), told("stack", F.col("line"), F.get("l", F.col("i") + 1)))
    listed = spread.select("chunk_id", row.alias("d")).filter("d is not null").select("chunk_id", "d.*")

    inline = rf"([^()]{{1,160}})\(\s*({upper}?)(s?)\s*\)"
    found = rows.select("chunk_id", F.explode(F.regexp_extract_all("text", F.lit(inline), F.lit(0))).alias("m"))
    found = found.select("chunk_id", F.regexp_extract("m", inline, 2).alias("acronym"), F.regexp_extract("m", inline, 3).alias("many"), F.regexp_extract_all(F.regexp_extract("m", inline, 1), F.lit(r"([A-Za-z][\w&-]*)")).alias("w"))
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(12), F.size("w")))), lambda n: F.array_join(F.slice(F.col("w"), F.greatest(F.size("w") - n + 1, F.lit(1)), n), " "))
    fine = F.get(F.filter(tails, lambda p: F.rlike(p, F.lit("^[A-Z]")) & spells(F.col("acronym"), p)), 0)
    single = lambda p: F.when(F.rlike(p, F.lit("(?i)ies$")), F.regexp_replace(p, "(?i)ies$", "y")).when(F.rlike(p, F.lit("(?i)[^s]s$")), F.regexp_replace(p, "(?i)s$", "")).otherwise(p)
    inside = found.filter("size(w) >= 2").withColumn("p", fine).filter("p is not null").select("chunk_id", F.lit("text").alias("way"), "acronym", F.when(F.col("many") != "", single(F.col("p"))).otherwise(F.col("p")).alias("expansion"))
    good = listed.filter("expansion is not null").filter(spells(F.col("acronym"), F.col("expansion")))
    return good.unionByName(inside).select("chunk_id", "acronym", "expansion", "way").distinct()


def glossary(defined: DataFrame, chunks: DataFrame) -> DataFrame:
    """One expansion for each acronym: that of the shortest chunk that defines it, of equals the smallest chunk, then by letters."""
    met = defined.join(chunks.select("chunk_id", F.length("text").alias("size")), "chunk_id")
    k = F.row_number().over(Window.partitionBy("acronym").orderBy("size", "chunk_id", "expansion"))
    return met.withColumn("k", k).filter("k = 1").select("acronym", "expansion", "chunk_id")


def stemmed(terms: DataFrame) -> DataFrame:
    """Rows with `term` replaced by its stem: each distinct term is stemmed once, written, and joined back."""
    vocabulary = stored(terms.select("term").distinct().select("term", stem(F.col("term")).alias("stem")), "stems")
    return terms.join(vocabulary, "term").withColumn("term", F.col("stem")).drop("stem").select(*terms.columns)


def stem_postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """How often each stem occurs in each text. A text's terms are counted before they are stemmed."""
    counted = stored(docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")), "counts")
    return stemmed(counted).groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def stem_coverage(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Share of each query's distinct terms that its items (query_id, item_id, text) mention, and the terms missing.

    A term is mentioned if all its parts (between hyphens, points and strokes) are: by a word of the same stem, or one whose stem
    has the same first five letters and no digit. Each word is stemmed once for all queries. Queries without terms are covered.
    """
    parted = lambda df, *more: df.select("query_id", *more, F.explode(F.array_distinct(tokens(F.col("text")))).alias("whole")).select("query_id", "whole", F.explode(F.split("whole", r"[-./]")).alias("term")).filter("term <> ''")
    both = parted(queries).withColumn("asks", F.lit(True)).unionByName(parted(items).select("query_id", F.lit("").alias("whole"), "term", F.lit(False).alias("asks"))).distinct()
    both = stemmed(stored(both, "parts"))
    asked, held = both.filter("asks").select("query_id", "whole", "term"), both.filter("not asks").select("query_id", "term")
    start = F.when((F.length("term") >= PREFIX) & ~F.rlike("term", F.lit(r"\d")), F.substring("term", 1, PREFIX))
    same = held.select("query_id", "term").distinct().withColumn("same", F.lit(True))
    near = held.select("query_id", start.alias("start")).filter("start is not null").distinct().withColumn("near", F.lit(True))
    met = asked.withColumn("start", start).join(same, ["query_id", "term"], "left").join(near, ["query_id", "start"], "left")
    whole = met.groupBy("query_id", "whole").agg(F.bool_and(F.coalesce("same", F.lit(False)) | F.coalesce("near", F.lit(False))).alias("said"))
    found = whole.groupBy("query_id").agg(F.round(F.count_if("said") / F.count("*"), 6).alias("coverage"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("said"), F.col("whole")))), " ").alias("missing"))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("coverage", F.lit(1.0)).alias("coverage"), F.coalesce("missing", F.lit("")).alias("missing"))


def extractive_summary(sections: DataFrame) -> DataFrame:
    """A document's own sentences of five words or more, by what they are: its first two, the first of a section whose title tells
    the purpose, and the first rules, actions and exceptions, up to `QUOTAS`.

    Sections are (doc_id, place, number, title, text). A sentence counts for each kind that it is of. Of a section only as many
    sentences of a kind as its quota go on, so a document of any size leaves few. Returns doc_id, kind, n, number, sentence.
    """
    rows = sections.select("doc_id", "place", "number", "title", F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("i", "sentence"))
    rows = rows.filter(F.size(F.split(F.trim("sentence"), r"\s+")) >= 5)
    tests = {"overview": F.lit(True), "purpose": F.coalesce(F.rlike("title", F.lit(PURPOSE)), F.lit(False)), "rule": F.rlike("sentence", F.lit(RULE)), "action": F.rlike("sentence", F.lit(ACTION)), "exception": F.rlike("sentence", F.lit(EXCEPTION))}
    kinds = F.explode(F.array_compact(F.array(*[F.when(test, kind) for kind, test in tests.items()]))).alias("kind")
    spread = rows.select("doc_id", "place", "number", "i", "sentence", kinds)
    quota = F.create_map(*[F.lit(x) for pair in QUOTAS.items() for x in pair])[F.col("kind")]
    first = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "kind", *by).orderBy("place", "i")).cast("int")).filter(F.col("n") <= quota)
    return first(first(spread, "place").drop("n")).select("doc_id", "kind", "n", "number", "sentence")
