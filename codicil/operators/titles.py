"""Titles of documents: found in the layout of the first page, mended by the words the document uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.text import title_key
from codicil.operators.metadata import EFFECTIVE, NUMBER, smart_title
from codicil.sources.tables import spread

# What titles say, what they never are, how they are set, and what each way to find one weighs.
TYPE_WORDS = r"(?i)\b(policy|circular|guidelines?|manual|procedure|sop|notice|framework|faqs?|directions?|handbook|process)\b"
FILE_LIKE = r"(?i)(_|\.pdf$|\.docx?$|\bfinal\b|\bdraft\b|\bcopy\b|\bv\d+\b|^untitled|^microsoft|^document\d*$)"
SUBTITLE = r"(?i)^(?:volume|vol\.?|part|book|tome)\s+(?:[ivxlc]+|\d{1,3}|[a-z])\b"
ONLY_VERSION = r"(?i)^(?:version\s*(?:no\.?|number)?\s*[:\-]?\s*v?\d{1,3}(?:\.\d{1,3})?|v\d{1,3}(?:\.\d{1,3})?)$"
ONLY_PAGE = r"(?i)^(?:page\s+)?\d{1,5}(?:\s*(?:of|/)\s*\d{1,5})?$"
JOINING = ("a", "an", "and", "as", "at", "by", "for", "in", "of", "on", "or", "the", "to", "with", "from")
ALIKE_SIZE, LARGER = 0.97, 1.15
FIRST_LINES, KEYWORD_LINES = 40, 15
SCORES = {"largest_font": 0.55, "heading_keyword": 0.35, "continued": 0.45, "pdf_metadata": 0.4}


def detect_title(lines: DataFrame, openings: DataFrame) -> DataFrame:
    """The best title that a document's first page and its file name offer.

    Lines of first pages are (doc_id, line_no, text, size, bold), of which the first 40 that are not blank count; openings
    (doc_id, text, body, pdf_title) hold the opening text, the body's font size (null or 0: unknown) and the file's own title.
    Candidates: the first run of lines in the largest font, if that is larger than the body's, with a subtitle such as ``Part B``;
    of the first 15 lines those with a word such as ``policy``, and the same joined to the lines that end a title left open by a
    joining word; and the file's title. Numbers, versions, pages and dates are none. Words of document types, capitals and
    repetition in the opening add to the score; of equals the last in order of letters counts.

    Returns doc_id, title, confidence, source, found (the title as written, white space apart); no row where nothing is offered.
    A page's lines, 40 at most, are one row.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    kept = lines.filter("trim(text) <> ''").withColumn("i", F.row_number().over(w)).filter(F.col("i") <= FIRST_LINES)
    page = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "text", F.coalesce("size", F.lit(0.0)).alias("size"), F.coalesce("bold", F.lit(False)).alias("bold")))).alias("l"))
    rows = openings.select("doc_id", F.coalesce("text", F.lit("")).alias("opening"), F.coalesce("body", F.lit(0.0)).alias("body"), "pdf_title").join(page, "doc_id", "left")
    offer = lambda text, score, source: F.struct(text.alias("text"), F.lit(score).alias("score"), F.lit(source).alias("source"))
    text_of = lambda x: x["text"]

    top = F.array_max(F.transform("l", lambda x: x["size"]))
    rows = rows.withColumn("top", top).withColumn("big", F.transform("l", lambda x: x["size"] >= F.col("top") * ALIKE_SIZE))
    rows = rows.withColumn("from", F.array_position("big", F.lit(True)).cast("int"))
    after = F.slice("big", F.col("from"), F.size("big"))
    rows = rows.withColumn("n", F.coalesce(F.nullif(F.array_position(after, F.lit(False)).cast("int"), F.lit(0)) - 1, F.size(after)))
    below = F.trim(F.get("l", F.col("from") + F.col("n") - 1)["text"])
    block = F.array_join(F.transform(F.slice("l", F.col("from"), F.col("n")), text_of), " ")
    titled = F.when(F.coalesce(F.rlike(below, F.lit(SUBTITLE)), F.lit(False)), F.concat(block, F.lit(" – "), below)).otherwise(block)
    largest = F.when((F.col("top") > 0) & ((F.col("body") == 0) | (F.col("top") >= F.col("body") * LARGER)), F.array(offer(titled, SCORES["largest_font"], "largest_font")))

    def is_heading(x: Column) -> Column:
        return (x["i"] <= KEYWORD_LINES) & F.rlike(x["text"], F.lit(TYPE_WORDS)) & (F.size(F.split(F.trim(x["text"]), r"\s+")) <= 12) & ~F.endswith(F.rtrim(x["text"]), F.lit("."))

    def joined(x: Column) -> Column:
        """The line and up to three more, while the last is open; null if a piece is set otherwise or the title stays open."""
        is_open = lambda t: F.lower(F.element_at(F.split(t, r"\s+"), -1)).isin(*JOINING)
        bare = lambda t: F.regexp_replace(F.trim(t), "^[‘’“”\"']+|[‘’“”\"']+$", "")
        state = F.struct(F.array(F.trim(x["text"])).alias("parts"), F.lit(True).alias("good"), F.lit(False).alias("done"))

        def step(s: Column, y: Column) -> Column:
            stop = s["done"] | ~is_open(F.element_at(s["parts"], -1))
            fits = (x["size"] > 0) & (F.abs(y["size"] - x["size"]) <= x["size"] * (1 - ALIKE_SIZE)) & (y["bold"] == x["bold"]) & (bare(y["text"]) != "")
            parts = F.when(~stop & fits, F.array_append(s["parts"], bare(y["text"]))).otherwise(s["parts"])
            return F.struct(parts.alias("parts"), (s["good"] & (stop | fits)).alias("good"), (stop | ~fits).alias("done"))

        end = F.aggregate(F.slice(F.col("l"), x["i"] + 1, F.lit(3)), state, step)
        return F.when(end["good"] & (F.size(end["parts"]) > 1) & ~is_open(F.element_at(end["parts"], -1)), F.array_join(end["parts"], " "))

    heads = F.filter("l", is_heading)
    named = F.transform(heads, lambda x: offer(x["text"], SCORES["heading_keyword"], "heading_keyword"))
    long = F.transform(heads, lambda x: offer(joined(x), SCORES["continued"], "heading_keyword"))
    own = F.when(F.col("pdf_title").isNotNull() & ~F.rlike("pdf_title", F.lit(FILE_LIKE)), F.array(offer(F.col("pdf_title"), SCORES["pdf_metadata"], "pdf_metadata")))
    none = F.array().cast("array<struct<text:string,score:double,source:string>>")
    rows = rows.select("doc_id", "opening", "pdf_title", F.explode(F.concat(*[F.coalesce(x, none) for x in (largest, named, long, own)])).alias("c")).select("doc_id", "opening", "pdf_title", "c.*").filter("text is not null")

    tidy = F.regexp_replace(F.trim(F.regexp_replace("text", r"\s+", " ")), "^[ :-]+|[ :-]+$", "")
    rows = rows.withColumn("text", tidy).filter(F.length("text").between(3, 150) & F.rlike("text", F.lit("[A-Za-z]{3}")))
    for pattern in (NUMBER, ONLY_VERSION, ONLY_PAGE, EFFECTIVE):
        rows = rows.filter(~F.rlike("text", F.lit(pattern)))
    capital = F.rlike("text", F.lit("^[^a-z]*$")) | F.rlike("text", F.lit("^[^A-Za-z]*(?:[A-Z][a-z]*[^A-Za-z]+)*(?:[A-Z][a-z]*)?$"))
    score = F.col("score") + F.when(F.rlike("text", F.lit(TYPE_WORDS)), 0.2).otherwise(0.0) + F.when(capital, 0.1).otherwise(0.0)
    rows = rows.withColumn("score", F.round(score, 4)).withColumn("key", title_key(F.col("text"))).filter("key <> ''")
    best = rows.groupBy("doc_id", "key").agg(F.max(F.struct("score", "text", "source")).alias("b"), F.first("opening").alias("opening"), F.first("pdf_title").alias("pdf_title"))
    opening = title_key(F.col("opening"))
    seen = (F.length(opening) - F.length(F.replace(opening, F.col("key")))) / F.length("key")
    score = F.round(F.col("b.score") + F.when(seen >= 2, 0.1).otherwise(0.0) + F.when(title_key(F.col("pdf_title")) == F.col("key"), 0.15).otherwise(0.0), 4)
    last = best.select("doc_id", F.struct(score.alias("score"), F.col("b.text").alias("text"), F.col("b.source").alias("source")).alias("b")).groupBy("doc_id").agg(F.max("b").alias("b"))
    return last.select("doc_id", smart_title(F.col("b.text")).alias("title"), F.round(F.least("b.score", F.lit(0.99)), 2).alias("confidence"), F.col("b.source").alias("source"), F.col("b.text").alias("found"))


def deletions(word: Column, most: Column) -> Column:
    """The word and what is left of it without any one letter, or any two where `most` is 2."""
    less = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    one = less(word)
    return F.array_distinct(F.concat(F.array(word), one, F.when(most == 2, F.flatten(F.transform(one, less))).otherwise(F.array().cast("array<string>"))))


def close_words(broken: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """For each broken word (doc_id, word: lower case) the word its own document uses most, twice at least, that has one letter more
    (up to two from eight letters on) and is within as many edits; not its plural.

    Words within k edits share what is left of both after at most k deletions each, so they meet by that within a document.
    """
    limit = lambda c: F.when(F.length(c) >= 8, 2).otherwise(1)
    a = broken.filter("length(word) >= 3").select("doc_id", "word", limit("word").alias("k")).distinct()
    b = vocabulary.filter("n >= 2 and length(term) > 3").select("doc_id", "term", "n")
    keyed = lambda df, c, k: df.withColumn("key", F.explode(deletions(F.col(c), k)))
    # words of up to seven letters have one edit, so their longer partners up to eight are looked up by one deletion
    met = spread(keyed(a, "word", F.col("k"))).join(spread(keyed(b, "term", F.when(F.length("term") >= 9, 2).otherwise(1))), ["doc_id", "key"])
    more = F.length("term") - F.length("word")
    near = met.filter((more >= 1) & (more <= F.col("k")) & (F.levenshtein("term", "word") <= F.col("k")) & (F.col("term") != F.concat("word", F.lit("s"))) & (F.col("term") != F.concat("word", F.lit("es"))))
    return near.groupBy("doc_id", "word").agg(F.max(F.struct("n", "term"))["term"].alias("term"))


def repair_titles(titles: DataFrame, texts: DataFrame, acronyms: list[str] | None = None) -> DataFrame:
    """Titles (doc_id, title) in which words that the document's text (doc_id, text) never uses outside the title are replaced.

    A word is lost if it is one letter, or the text has it no more often than the title; joining words, `a`, `i` and `acronyms`
    never are. A run of lost words is first mended as one (``E HICS``: ethics), else word by word by the word that `close_words`
    finds; the word's case stays. Returns doc_id, title, repaired; documents without text keep their title.

    Titles meet their texts once; all else happens in their row, so neither words nor what edits leave of them are shuffled.
    """
    letters = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([A-Za-z]+)")), F.lower)
    pages = texts.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    rows = titles.select("doc_id", "title").join(spread(pages), "doc_id", "left").select("doc_id", "title", letters(F.col("text")).alias("terms"), letters(F.col("title")).alias("own"), F.split(F.trim("title"), r"\s+").alias("w"))
    times = lambda values, x: F.size(F.filter(values, lambda t: t == x))
    never = ["", *JOINING, "a", "i", *[x.lower() for x in acronyms or []]]

    def word(w: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("i"), w.alias("w"), F.lower(F.regexp_replace(w, "[^A-Za-z]", "")).alias("bare"))

    rows = rows.withColumn("w", F.transform("w", word))
    rows = rows.withColumn("lost", F.transform("w", lambda x: ~x["bare"].isin(*never) & ((F.length(x["bare"]) == 1) | (times(F.col("terms"), x["bare"]) <= times(F.col("own"), x["bare"])))))
    # a run of lost words begins after a sound word or the start; its words are those up to the next sound one
    begins = lambda i: F.get("lost", i - 1) & ~F.coalesce(F.get("lost", i - 2), F.lit(False))
    ends = lambda i: F.get("lost", i - 1) & ~F.coalesce(F.get("lost", i), F.lit(False))
    rows = rows.withColumn("from", F.filter(F.transform("w", lambda x: F.when(begins(x["i"]), x["i"])), lambda i: i.isNotNull())).withColumn("to", F.filter(F.transform("w", lambda x: F.when(ends(x["i"]), x["i"])), lambda i: i.isNotNull()))
    of = lambda ws, name: F.array_join(F.transform(ws, lambda x: x[name]), "")
    run = lambda a, b: F.struct(a.alias("at"), b.alias("to"), of(F.slice("w", a, b - a + 1), "bare").alias("bare"), of(F.slice("w", a, b - a + 1), "w").alias("written"))
    rows = rows.withColumn("runs", F.zip_with("from", "to", run))
    broken = F.array_union(F.transform("runs", lambda r: r["bare"]), F.transform(F.filter("w", lambda x: F.get("lost", x["i"] - 1)), lambda x: x["bare"]))
    rows = rows.withColumn("broken", F.filter(broken, lambda b: F.length(b) >= 3)).withColumn("known", F.when(F.size("broken") > 0, F.filter(F.array_distinct("terms"), lambda t: F.length(t) > 3)).otherwise(F.array().cast("array<string>")))

    def close(term: Column, w: Column) -> Column:
        """Whether `close_words` may take the term for the broken word, how often it is used aside."""
        k, more = F.when(F.length(w) >= 8, 2).otherwise(1), F.length(term) - F.length(w)
        return (more >= 1) & (more <= k) & (F.levenshtein(term, w) <= k) & (term != F.concat(w, F.lit("s"))) & (term != F.concat(w, F.lit("es")))

    rows = rows.withColumn("near", F.transform("broken", lambda b: F.filter("known", lambda t: close(t, b))))
    best = lambda ts: F.array_max(F.filter(F.transform(ts, lambda t: F.struct(times(F.col("terms"), t).alias("n"), t.alias("term"))), lambda x: x["n"] >= 2))["term"]
    rows = rows.withColumn("best", F.map_from_arrays("broken", F.transform("near", best)))
    upper = lambda c: F.rlike(F.regexp_replace(c, "[^A-Za-z]", ""), F.lit("^[A-Z]+$"))
    cased = lambda term, like: F.when(upper(like), F.upper(term)).when(F.rlike(F.regexp_replace(like, "[^A-Za-z]", ""), F.lit("^[A-Z]")), F.initcap(term)).otherwise(term)
    found = lambda b: F.try_element_at(F.col("best"), b)
    rows = rows.withColumn("whole", F.filter(F.transform("runs", lambda r: F.struct(r["at"].alias("at"), r["to"].alias("to"), cased(found(r["bare"]), r["written"]).alias("as"))), lambda r: r["as"].isNotNull()))

    def piece(x: Column) -> Column:
        inside = F.get(F.filter("whole", lambda r: (r["at"] <= x["i"]) & (x["i"] <= r["to"])), 0)
        return F.when(~F.get("lost", x["i"] - 1), x["w"]).when(inside.isNotNull(), F.when(inside["at"] == x["i"], inside["as"])).otherwise(F.coalesce(cased(found(x["bare"]), x["w"]), x["w"]))

    return rows.select("doc_id", "title", F.array_join(F.transform("w", piece), " ").alias("repaired"))
