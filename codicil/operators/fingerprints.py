"""Content hashes, SimHash fingerprints, and duplicate joins over them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.text import hamming, normalised
from codicil.sources.scratch import stored
from codicil.sources.tables import spread


def content_hash(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """SHA-256 of the normalised text."""
    return docs.select(key, F.sha2(normalised(F.col(text)), 256).alias("content_hash"))


def word_shingles(words: Column, size: int = 3) -> Column:
    """Runs of `size` words; all words as one run if there are fewer."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(n >= size, runs).when(n > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))


VOTES = 1 << 18  # hashes counted at a time


def majority(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row's 64-bit hashes (16 hex digits each, in a row) the bits that more than half of them have, as a signed long."""
    for batch in batches:
        counts = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 16
        ends = np.cumsum(counts)
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(VOTES, ends[-1] if len(ends) else 0, VOTES)) + 1, len(ends)])
        out = np.zeros(len(counts), np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = np.flatnonzero(counts[a:b]) + a
            if len(some):
                bits = np.unpackbits(np.frombuffer(bytes.fromhex("".join(t or "" for t in batch.column(1).slice(a, b - a).to_pylist())), np.uint8).reshape(-1, 8), axis=1)
                starts = np.r_[0, np.cumsum(counts[some])][:-1]
                ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
                out[some] = np.packbits(2 * ones > counts[some][:, None], axis=1).view(">i8")[:, 0]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=[batch.schema.names[0], "simhash"])


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """64-bit majority vote over the hashes of three-word shingles (first 16 hex digits of md5), as a signed long.

    Repeated shingles vote each time. Texts without words have 0. A text's votes are counted inside a map over its row, so
    nothing is spread or shuffled, and no filter on the result runs the hashing twice.
    """
    words = F.filter(F.split(normalised(F.col(text)), " "), lambda w: w != "")
    hashed = F.array_join(F.transform(word_shingles(F.col("words_")), lambda s: F.substring(F.md5(s), 1, 16)), "")
    rows = docs.withColumn("words_", words).select(key, hashed.alias("h_"))
    return rows.mapInArrow(majority, f"{key} {rows.schema[key].dataType.simpleString()}, simhash long")


def near_fingerprints(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs of different fingerprints that differ in at most `distance` bits, with their smallest keys and group sizes.

    Copies are one group, so a group of any size gives one row per pair of groups. The 64 bits are cut into 2 * `distance`
    blocks; two such fingerprints agree in at least half of them, so they meet by the values of some `distance` blocks
    together: 32 bits, few enough fingerprints for each value. A pair is given once, by the first blocks that agree.
    The groups are written once, as both sides of the join read them.
    """
    groups = stored(prints.groupBy("simhash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "fingerprints")
    cuts = [64 * i // (2 * distance) for i in range(2 * distance + 1)]
    masks = [((1 << b) - (1 << a)) - ((1 << 64) if b == 64 else 0) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    sets = list(combinations(range(2 * distance), distance))
    keys = F.array(*[F.col("simhash").bitwiseAND(F.lit(sum(masks[b] for b in some))) for some in sets])
    keyed = groups.select("*", F.posexplode(keys).alias("some", "value"))
    a, b = spread(keyed).alias("a"), spread(keyed).alias("b")
    met = a.join(b, (F.col("a.some") == F.col("b.some")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    apart = F.col("a.simhash").bitwiseXOR(F.col("b.simhash"))
    blocks = F.array(*[F.array(*[F.lit(b) for b in some]) for some in sets])
    same = F.filter(F.array(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)]), lambda i: i.isNotNull())
    met = met.filter((F.bit_count(apart) <= distance) & (F.slice(same, 1, distance) == F.get(blocks, F.col("a.some"))))
    return met.select(
        F.col("a.doc_id").alias("doc_id"), F.col("b.doc_id").alias("other_id"), F.col("a.n").alias("n_copies"), F.col("b.n").alias("n_other"),
        hamming(F.col("a.simhash"), F.col("b.simhash")).alias("distance"),
    )


def exact_duplicates(hashes: DataFrame, key: str = "doc_id", by: str = "content_hash") -> DataFrame:
    """Rows whose content came before, with the earliest row of it. Only groups with several rows are joined back."""
    first = hashes.groupBy(by).agg(F.min(key).alias("original_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return hashes.join(first, by).filter(F.col(key) != F.col("original_id")).select(key, "original_id")


def check_duplicates(asked: DataFrame, stored: DataFrame, scope: Column) -> DataFrame:
    """Asked hashes that are stored: the earliest stored row, shown only where `scope` holds, else just flagged."""
    met = asked.join(stored, "content_hash")
    k = F.row_number().over(Window.partitionBy("asked_id").orderBy(F.desc(scope), "doc_id"))
    best = met.withColumn("in_scope", scope).withColumn("k", k).filter("k = 1")
    return best.select("asked_id", F.when(F.col("in_scope"), F.col("doc_id")).alias("doc_id"), (~F.col("in_scope")).alias("hidden"))
