"""I-Match fingerprints: terms of a document-frequency band, sorted, hashed under randomised lexicons (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.llm.common import stored

#: Part of the lexicon that each randomised subset keeps: some keep most terms, some few, so that both small and large
#: edits leave some of the hashes alike.
KEEPS = (1.0, 0.7, 0.5, 0.25, 1 / 8, 1 / 16, *[1 / 32] * 2, *[1 / 64] * 3, *[1 / 128] * 4, *[1 / 256] * 3)


def terms(text: Column) -> Column:
    """Distinct lower-case terms of a text: runs of anything but white space and ASCII punctuation."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[\s\p{Punct}]+")), "")


def lexicon(docs: DataFrame, low_idf: float, high_idf: float) -> DataFrame:
    """Terms whose inverse document frequency ln(documents / frequency) is in [`low_idf`, `high_idf`], with their subsets.

    `mask` has bit k set if subset k keeps the term, by md5 of k and the term. A term of the band is in at least
    documents / e**`high_idf` documents, so the lexicon has at most e**`high_idf` times the mean number of distinct terms
    of a document as rows, however many documents there are: its size is bounded.
    """
    found = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = docs.agg(F.count("*").alias("total"))
    idf = F.log(F.col("total").cast("double") / F.col("df").cast("double"))
    u = lambda k: F.conv(F.substring(F.md5(F.concat(F.lit(f"{k}:"), F.col("term"))), 1, 4), 16, 10).cast("int")
    mask = sum((F.when(u(k) < int(keep * 65536), 1 << k).otherwise(0) for k, keep in enumerate(KEEPS[1:], 1)), F.lit(1))
    band = found.crossJoin(F.broadcast(total)).filter((idf >= low_idf) & (idf <= high_idf))
    return band.select("term", mask.cast("int").alias("mask"))


def as_table(words: DataFrame, slots: int = 1 << 14) -> Column:
    """The bounded lexicon as one constant: an array of `slots` short lists, a term being in the list of its hash."""
    spot = F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int")
    lists = words.groupBy(spot.alias("spot")).agg(F.collect_list(F.struct("term", "mask")).alias("list"))
    every = words.sparkSession.range(slots).select(F.col("id").cast("int").alias("spot")).join(lists, "spot", "left")
    none = F.expr("filter(array(named_struct('term', '', 'mask', 0)), x -> false)")
    full = every.agg(F.sort_array(F.collect_list(F.struct("spot", F.coalesce("list", none).alias("list")))).alias("all"))
    text = full.select(F.to_json(F.transform("all", lambda x: x["list"])).alias("json")).first()["json"]
    return F.from_json(F.lit(text), "array<array<struct<term:string,mask:int>>>")


def add_print(df: DataFrame, text: str, table: Column, name: str, slots: int = 1 << 14) -> DataFrame:
    """Add column `name`: one hash for each subset, of the sorted distinct lexicon terms that it keeps, '-' for none.

    A text without any term of the lexicon is hashed by its sorted distinct terms, or if it has none by itself.
    """
    find = lambda t: F.get(F.filter(F.get(table, F.pmod(F.xxhash64(t), F.lit(slots)).cast("int")), lambda x: x["term"] == t), 0)
    # terms sort by name first, so this is the order of the terms
    df = df.withColumn("held_", F.sort_array(F.filter(F.transform(terms(F.col(text)), find), lambda x: x.isNotNull())))
    # rarer subsets look only at terms that some rare subset keeps
    df = df.withColumn("some_", F.filter("held_", lambda x: x["mask"] >= 1 << 4)).withColumn("few_", F.filter("some_", lambda x: x["mask"] >= 1 << 6))

    def kept(source: str, low: int, high: int) -> Column:
        bits = F.array(*[F.lit(1 << k) for k in range(low, high)])
        return F.transform(bits, lambda b: F.array_join(F.transform(F.filter(source, lambda x: x["mask"].bitwiseAND(b) != 0), lambda x: x["term"]), " "))

    joined = F.concat(kept("held_", 0, 4), kept("some_", 4, 6), kept("few_", 6, len(KEEPS)))
    hashes = F.transform(joined, lambda s: F.when(s == "", "-").otherwise(F.substring(F.md5(s), 1, 12)))
    plain = F.array_join(F.sort_array(terms(F.col(text))), " ")
    own = F.concat(F.lit("="), F.substring(F.md5(F.when(plain == "", F.col(text)).otherwise(plain)), 1, 11))
    return df.withColumn(name, F.when(F.size("held_") > 0, hashes).otherwise(F.array_repeat(own, len(KEEPS)))).drop("held_", "some_", "few_")


def likeness(a: str, b: str) -> Column:
    """Share of subsets with equal hashes among those where either print has terms; 1 for equal prints."""
    pairs = F.zip_with(a, b, lambda x, y: F.when((x == "-") & (y == "-"), None).when(x == y, 1).otherwise(0))
    some = F.filter(pairs, lambda v: v.isNotNull())
    same = F.aggregate(some, F.lit(0), lambda n, v: n + v)
    return F.when(F.col(a) == F.col(b), 1.0).when(F.size(some) > 0, same / F.size(some)).otherwise(0.0).cast("double")


def range_bucket(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Add `bucket_`: which of `parts` even ranges of `key` a row is in, from quantiles over all rows."""
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("cuts_"))
    steps = F.array(*[F.lit(1 << b) for b in range(parts.bit_length(), -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(F.col("cuts_"), at + s - 1) <= F.col(key), at + s).otherwise(at))
    return df.crossJoin(F.broadcast(cuts)).withColumn("bucket_", found).drop("cuts_")


def fingerprint_with_edits(docs: DataFrame, low_idf: float = 1.5, high_idf: float = 6.0) -> DataFrame:
    """Fingerprint every text and its edited form, in which the last half is replaced by the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The next document is
    the one with the next larger doc_id, for the last the first; ties of doc_id are ordered by text. Null texts are
    empty, null doc_ids come first. The lexicon comes from all given texts; equal texts have equal prints. An empty table
    gives no rows; other columns are ignored.

    One shuffle deals the texts out by even ranges of doc_id; `lead` works inside a range, and each range hands its first
    row to the range before. The prints need no further shuffle: the bounded lexicon is a constant.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    table = as_table(stored(lexicon(base, low_idf, high_idf), "lexicon"))
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = range_bucket(base, "doc_id", parts)
    w = Window.partitionBy("bucket_").orderBy("doc_id", "text")
    heads = placed.groupBy("bucket_").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    over = Window.orderBy("bucket_")  # one row for each range
    first = F.first("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("bucket_", F.coalesce(F.lead("head").over(over), first)["text"].alias("after_"))
    heads = add_print(heads, "after_", table, "after_print_")
    rows = placed.withColumn("next_", F.lead("text").over(w)).join(heads, "bucket_")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_", "after_"), F.lit(1), half))
    rows = rows.select("bucket_", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited_"), "after_print_")
    rows = add_print(add_print(rows, "text", table, "print_"), "edited_", table, "edited_print_")
    rows = rows.withColumn("edited_sha256", F.sha2("edited_", 256)).drop("edited_")
    rows = rows.withColumn("next_print_", F.coalesce(F.lead("print_").over(w), "after_print_"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("print_", "").alias("fingerprint"), F.array_join("edited_print_", "").alias("edited_fingerprint"),
        likeness("print_", "edited_print_").alias("near_edited"), likeness("print_", "next_print_").alias("near_next"),
    )
