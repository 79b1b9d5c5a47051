"""What a document says about itself in its opening text, and the words it uses."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.dates import first_date
from codicil.functions.text import tokens, version_key

# Labels before what is read, and words of amendments.
NUMBER = r"(?i)\bpolicy\s+(?:no\.?|number)\s*:?\s*([A-Za-z]{1,10}[-/][A-Za-z0-9]+(?:[-/][A-Za-z0-9]+)*)"
VERSION = r"(?i)\bversion\s*:?\s*v?(\d+(?:\.\d+){0,3})"
ISSUER = r"(?i)\bissued\s+by:?\s+(?:the\s+)?([A-Za-z ]{3,60}?)(?:[.,;\n]|$)"
EFFECTIVE = r"(?i)\b(?:effective\s+(?:from|date)|with\s+effect\s+from|comes\s+into\s+force\s+on)\b:?([^.\n]{0,40})"
AMENDS = r"(?i)\b(amends|replaces|supersedes|clarifies)\b([^.\n]{0,120})"
CLAUSES = r"(?i)\bclauses?\s+(\d{1,2}(?:\.\d{1,3}){0,4})"
SMALL = ("a", "an", "and", "as", "at", "by", "for", "in", "of", "on", "or", "the", "to")


def extract_metadata(openings: DataFrame) -> DataFrame:
    """Number, version and its key, issuer and own effective date of documents from their opening text; null where it has none."""
    read = lambda p: F.when(F.rlike("text", F.lit(p)), F.trim(F.regexp_extract("text", p, 1)))
    version = read(VERSION)
    return openings.select("doc_id", F.upper(read(NUMBER)).alias("number"), version.alias("version"), F.array_join(version_key(version).cast("array<string>"), ".").alias("version_key"), read(ISSUER).alias("issuer"), first_date(read(EFFECTIVE)).alias("effective"))


def amendment_refs(openings: DataFrame) -> DataFrame:
    """What each document amends, replaces, supersedes or clarifies: the verb, the policy number it names, and the clauses."""
    said = F.regexp_extract_all("text", F.lit(AMENDS), F.lit(0))
    rows = openings.select("doc_id", F.explode(F.array_distinct(said)).alias("said"))
    number = F.upper(F.regexp_extract("said", r"\b([A-Za-z]{1,10}-\d[A-Za-z0-9]*)", 1))
    return rows.select("doc_id", F.upper(F.regexp_extract("said", AMENDS, 1)).alias("relation"), F.when(number != "", number).alias("target"), F.array_join(F.regexp_extract_all("said", F.lit(CLAUSES)), ",").alias("clauses"))


def smart_title(text: Column) -> Column:
    """A title in title case: small words stay small but for the first, words in capitals or with digits stay as they are."""
    keep = lambda w: F.rlike(w, F.lit(r"\d|^[A-Z]{2,5}$"))
    one = lambda w, i: F.when(keep(w), w).when((i > 0) & F.lower(w).isin(*SMALL), F.lower(w)).otherwise(F.initcap(w))
    return F.array_join(F.transform(F.split(F.trim(text), r"\s+"), one), " ")


def initials(text: Column) -> Column:
    """First letters of the words of a title that are not small, in capitals."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~F.lower(w).isin(*SMALL) & F.rlike(w, F.lit("^[A-Za-z]")))
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def alias_catalogue(policies: DataFrame) -> DataFrame:
    """Names that stand for one policy (policy_id, title, number) only: its initials of three letters or more, its number, and words of
    five letters or more that no other title has."""
    words = F.filter(F.split(F.lower("title"), "[^a-z0-9]+"), lambda w: F.length(w) >= 5)
    short = F.when(F.length(initials(F.col("title"))) >= 3, F.lower(initials(F.col("title"))))
    rows = policies.select("policy_id", F.explode(F.array_distinct(F.array_compact(F.concat(words, F.array(short, F.lower("number")))))).alias("alias"))
    return rows.groupBy("alias").agg(F.min("policy_id").alias("policy_id"), F.max("policy_id").alias("last")).filter("policy_id = last").drop("last")


def policy_mentions(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Policies that a query names by one of their aliases."""
    said = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9]+(?:-[a-z0-9]+)*)")))).alias("alias"))
    return said.join(aliases, "alias").select("query_id", "policy_id").distinct()


def fallback_title(docs: DataFrame) -> DataFrame:
    """The pair of neighbouring terms that a document has most often; of equals the first in order of letters."""
    t = tokens(F.col("text"))
    pairs = F.zip_with(F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    counts = docs.select("doc_id", F.explode(pairs).alias("pair")).groupBy("doc_id", "pair").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "pair"))
    return counts.withColumn("k", k).filter("k = 1").select("doc_id", F.col("pair").alias("title"), "n")


def suggest_words(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """For each word (word) that the vocabulary (term, n) lacks, its most frequent term one edit away.

    Words one edit apart are equal after at most one character is left out of either, so they meet by that.
    """
    cut = lambda c: F.array_union(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))))
    lost = words.select("word").distinct().join(vocabulary, F.col("word") == F.col("term"), "left_anti")
    a = lost.filter("length(word) > 3").select("word", F.explode(cut(F.col("word"))).alias("key"))
    b = vocabulary.filter("length(term) > 2").select("term", "n", F.explode(cut(F.col("term"))).alias("key"))
    near = a.join(b, "key").filter(F.levenshtein("word", "term") <= 1).select("word", "term", "n").distinct()
    k = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "term"))
    return near.withColumn("k", k).filter("k = 1").select("word", "term", "n")


def places(features: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of each feature: the first eight hex digits of its md5, and whether the ninth is odd."""
    md5 = hashlib.md5
    digests = np.frombuffer(b"".join([md5(f).digest() for f in features.cast(pa.binary()).to_pylist()]), np.uint8).reshape(-1, 16)
    return (digests[:, :4].copy().view(">u4")[:, 0] % size).astype(np.int64), np.where(digests[:, 4] & 16, 1, -1)


def feature_sums(docs: np.ndarray, terms: pa.Array, n_docs: int, size: int) -> np.ndarray:
    """Tenths of each document's features at each place (n_docs x size); `docs` is the document of each term. A feature that comes
    again in the piece is hashed once."""
    out = np.zeros(n_docs * size, np.int64)

    def add(docs: np.ndarray, features: pa.Array, which: np.ndarray, weight: int) -> None:
        at, sign = places(features, size)
        np.add(out, np.bincount(docs * size + at[which], weights=(weight * sign)[which], minlength=len(out)).astype(np.int64), out=out)

    coded = terms.dictionary_encode()
    codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    add(docs, words, codes, 10)
    near = docs[:-1] == docs[1:]
    pairs, which = np.unique((codes[:-1] * len(words) + codes[1:])[near], return_inverse=True)
    add(docs[:-1][near], pc.binary_join_element_wise(words.take(pa.array(pairs // max(1, len(words)))), words.take(pa.array(pairs % max(1, len(words)))), " "), which, 7)
    cut = [["#" + w[i : i + 3] for i in range(len(w) - 2)] if len(w) > 4 else [] for w in words.to_pylist()]
    flat = pa.array([p for c in cut for p in c], pa.string()).dictionary_encode()
    n = np.array([len(c) for c in cut], np.int64)
    # the pieces of each term that stands in the text: from where its word's begin, as many as it has
    each = n[codes]
    step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    add(np.repeat(docs, each), flat.dictionary, flat.indices.to_numpy().astype(np.int64)[np.repeat((np.cumsum(n) - n)[codes], each) + step], 3)
    return out.reshape(n_docs, size)


def hash_embedding(docs: DataFrame, size: int = 64, piece: int = 100_000) -> DataFrame:
    """Signed feature hashing of each text as rows (doc_id, place, value): terms weigh 1, pairs of neighbours 0.7, pieces of three
    characters of longer terms 0.3; a text's values have length 1. The first eight hex digits of md5 give the place, the ninth the sign.

    Features are summed where a text is read, about `piece` terms or one text at a time; only a text's sums are shuffled.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("t")
            ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(ends):
                before = ends[at - 1] if at else 0
                stop = max(at + 1, int(np.searchsorted(ends, before + piece, "right")))
                part = lists.slice(at, stop - at)
                whose = np.repeat(np.arange(stop - at), np.diff(ends[at:stop], prepend=before))
                sums = feature_sums(whose, part.flatten(), stop - at, size)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, stop - at), pa.ListArray.from_arrays(np.arange(0, sums.size + 1, size, dtype=np.int32), pa.array(sums.ravel()))], names=["doc_id", "v"])
                at = stop

    key = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", tokens(F.col("text")).alias("t")).mapInArrow(summed, f"doc_id {key}, v array<bigint>")
    sums = rows.groupBy("doc_id").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(size)])
    # in whole tenths, so that no order of a sum decides how a value is rounded
    sums = sums.select("doc_id", F.array(*[f"v{i}" for i in range(size)]).alias("v"))
    sums = sums.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0).cast("bigint"), lambda acc, x: acc + x * x)))
    found = sums.select("doc_id", "length", F.posexplode("v").alias("place", "x")).filter("x <> 0")
    return found.select("doc_id", "place", F.round(F.when(F.col("length") > 0, F.col("x") / F.col("length")), 6).alias("value"))


def visible_doc_freq(terms: DataFrame, chunks: DataFrame, stop_words: list[str]) -> DataFrame:
    """Chunks that hold each asked term (query_id, term): -1 for stop words, 0 for terms nobody uses."""
    met = chunks.select("chunk_id", F.explode(F.array_distinct(tokens(F.col("content")))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    df = met.groupBy("term").agg(F.count("*").alias("df"))
    return terms.join(df, "term", "left").select("query_id", "term", F.when(F.col("term").isin(stop_words), -1).otherwise(F.coalesce("df", F.lit(0))).cast("long").alias("df"))
