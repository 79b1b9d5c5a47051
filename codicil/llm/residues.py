"""Hard negatives by exact integer products: matrices modulo small primes in float32, joined by Chinese remaindering."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDE = 64  # components multiplied at a time
LARGEST = int(2 * (2**24 / WIDE) ** 0.5)  # residues of at most half of this: WIDE products of two sum to less than 2^24, exact in float32
FAR = 1 << 60  # scores beyond count as this, so that five times a score still fits 64 bits


def primes(bound: int) -> list[int]:
    """The largest primes below LARGEST whose product passes `bound`."""
    found, product = [], 1
    for n in range(LARGEST, 1, -1):
        if product > bound:
            break
        if all(n % d for d in range(2, int(n**0.5) + 1)):
            found.append(n)
            product *= n
    return found


def residues(values: np.ndarray, prime: int) -> np.ndarray:
    """Residues of whole doubles that lie nearest to zero, as float32."""
    left = np.fmod(values, prime)
    left -= prime * np.round(left / prime)
    return left.astype(np.float32)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of `a` with all rows of `b` (whole doubles of any size), exact up to FAR, beyond it FAR."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = 2 * a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max()) + 1
    chosen = primes(bound)
    kind = np.int64 if bound < 1 << 52 else object  # the product of the primes is at most about 2^10 times the bound
    # mixed radix: digit i counts the product of the primes before it
    digits: list[np.ndarray] = []
    for i, p in enumerate(chosen):
        left, right, digit = residues(a, p), residues(b, p), np.zeros((len(a), len(b)), np.int64)
        for at in range(0, a.shape[1], WIDE):
            digit += (left[:, at : at + WIDE] @ right[:, at : at + WIDE].T).astype(np.int64)
        weight, below = 1, np.zeros_like(digit)
        for q, d in zip(chosen[:i], digits, strict=True):
            below += d * (weight % p) % p
            weight *= q
        digits.append((digit - below) % p * pow(weight, -1, p) % p)
    total, weight = np.zeros(digits[0].shape, kind), 1
    for p, d in zip(chosen, digits, strict=True):
        total += d.astype(kind) * weight
        weight *= p
    total -= (total > weight // 2).astype(kind) * weight
    return np.clip(total, -FAR, FAR).astype(np.int64)


def first_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by descending score, ties by smaller id."""
    near = np.arange(len(scores))
    if len(scores) > 8 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def negatives_in_window(scores: np.ndarray, ids: np.ndarray, positive: int, share: tuple[int, int], k: int) -> np.ndarray:
    """Places of the k first rows whose score is at most `positive` and at least `share` of it."""
    near = np.flatnonzero((scores <= positive) & (scores * share[1] >= positive * share[0]))
    return near[first_rows(scores[near], ids[near], k)]


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """Vectors of one length as rows of whole doubles: floor(256 x)."""
    flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.floor(256.0 * flat.astype(np.float64)).reshape(table.num_rows, -1)


def take_part(df: DataFrame, key: str, vector: str, label: Column) -> DataFrame:
    """Rows (id, label, v) with an id, a label and a vector of finite components."""
    rows = df.select(F.col(key).cast("long").alias("id"), label.alias("label"), F.col(vector).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 2.0**500))
    return rows.filter("id is not null and label is not null and v is not null and size(v) > 0").filter(fine)


def hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), key: str = "vec_id", vector: str = "embedding",
    label: Column | None = None, block_rows: int = 4096, block_anchors: int = 2048, slice_rows: int = 256,
) -> DataFrame:
    """For each row of `anchors` and each of its nearest rows of the same label, the next lower rows of other labels.

    Components count as floor(256 x); a score is the integer inner product with the anchor. An anchor's positives are its
    `positives` first rows of equal `label` (a column of both tables; default `label`); for each, the `negatives` first rows of
    other labels score at most as high as the positive and at least `share` (numerator, denominator) of it. Higher scores come
    first, ties by smaller id.

    Rows are dealt into blocks by a hash of the id, anchors likewise; each pair of blocks is one task's product, so a frequent
    label or vector spreads over all blocks. Positives of all blocks meet first (a few for each anchor and block); with their
    scores the products are made again, and each block hands on the first rows inside each positive's window.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. Rows with a null id, label or
    vector, an empty vector, a null or non-finite component, or one of 2^500 or more take no part, nor do those whose length is
    not that of most rows (of equals the smallest). An anchor never meets rows of its own id; anchors repeated wholly count once,
    rows repeated are rows of their own. Anchors without positives, and positives without a negative in the window, give no
    rows. Scores beyond 2^60 count as 2^60. Empty tables give no rows; other columns are ignored.
    """
    label = F.col("label") if label is None else label
    held = take_part(rows, key, vector, label)
    usual = held.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").first()
    width = usual["n"] if usual else 0
    held = held.filter(F.size("v") == width)
    asked = take_part(anchors, key, vector, label).filter(F.size("v") == width).withColumn("h", F.xxhash64("v", "label")).dropDuplicates(["id", "h"])
    blocks, parts = max(1, -(-(usual["m"] if usual else 0) // block_rows)), max(1, -(-asked.count() // block_anchors))
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    left = held.withColumn("b", deal(blocks, 1)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def meet(sought: DataFrame, choose: Callable, schema: str) -> DataFrame:
        """`choose` over each anchor's scores with a block's rows; gives arrays of the columns after anchor and h."""
        names = [part.split()[0] for part in schema.split(", ")]
        sought = sought.withColumn("q", deal(parts, 2)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def run(near: pa.Table, far: pa.Table) -> pa.Table:
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in names]
            if near.num_rows and far.num_rows:
                ids, labels, x = near.column("id").to_numpy(), near.column("label").to_numpy(), matrix(near, "v")
                for at in range(0, far.num_rows, slice_rows):
                    some = far.slice(at, slice_rows)
                    scores = products(matrix(some, "v"), x)
                    for row, s in zip(some.drop_columns("v").to_pylist(), scores, strict=True):
                        found = choose(row, s, ids, labels)
                        n = len(found[0])
                        for place, column in enumerate([np.full(n, row["id"]), np.full(n, row["h"]), *found]):
                            out[place].append(np.asarray(column, np.int64))
            return pa.table({n: np.concatenate(c) for n, c in zip(names, out, strict=True)})

        return left.groupBy("b", "q").cogroup(sought.groupBy("b", "q")).applyInArrow(run, schema)

    def alike(row: dict, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> tuple:
        own = np.flatnonzero((labels == row["label"]) & (ids != row["id"]))
        own = own[first_rows(scores[own], ids[own], positives)]
        return ids[own], scores[own]

    def unlike(row: dict, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> tuple:
        other = np.flatnonzero((labels != row["label"]) & (ids != row["id"]))
        s, i, out = scores[other], ids[other], []
        for p in row["best"]:
            some = negatives_in_window(s, i, p["score"], share, negatives)
            out.append((np.full(len(some), p["place"]), np.full(len(some), p["id"]), i[some], np.full(len(some), p["score"]), s[some]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    rank = lambda by, score, tie: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie))
    best = meet(asked, alike, "id long, h long, near long, score long").withColumn("place", rank(["id", "h"], "score", "near")).filter(F.col("place") <= positives)
    best = best.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("place", F.col("near").alias("id"), "score"))).alias("best"))
    found = meet(asked.join(best, ["id", "h"]), unlike, "anchor_id long, h long, place long, positive_id long, negative_id long, positive_score long, negative_score long")
    found = found.withColumn("rank", rank(["anchor_id", "h", "place"], "negative_score", "negative_id")).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
