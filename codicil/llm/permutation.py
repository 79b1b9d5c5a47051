"""Permutation index: vectors as ordered nearest pivots in pivot inverted files, ranked by footrule distance, reranked exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v) whose vector is not null, not zero and has only finite components, as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id is not null and v is not null").filter(fine)


def choose_pivots(rows: DataFrame, pivots: int) -> np.ndarray:
    """At most `pivots` distinct vectors of the table: those whose content hash comes first (a bounded sample)."""
    found = rows.groupBy(F.xxhash64("v").alias("h")).agg(F.first("v").alias("v")).orderBy(F.pmod(F.hash("h", F.lit(7)), F.lit(1 << 30)), "h").limit(pivots).collect()
    return np.array([r["v"] for r in found]) if found else np.zeros((0, 1))


def prefixes(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of each vector's `length` nearest pivots by inner product, nearest first; ties to the smaller number."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :length].astype(np.int16)


class Block:
    """Inverted files of a block of rows: for every pivot, the rows whose prefix holds it, and at which place."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, length: int):
        order = np.argsort(ids, kind="stable")  # ties in footrule and score go to the smaller id
        self.ids, self.vectors, self.length = ids[order], vectors[order], min(length, len(pivots))
        found = prefixes(self.vectors, pivots, length)
        flat = found.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows = (by_pivot // self.length).astype(np.int32)
        self.places = (by_pivot % self.length).astype(np.int32)
        self.edges = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))

    def search(self, query_id: int, query: np.ndarray, prefix: np.ndarray, k: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best of the `share` of rows (at least `least`) that are nearest by footrule distance."""
        # places count from 0; a missing pivot stands at place `length`: each shared pivot lowers the distance
        gain = np.zeros(len(self.ids), np.int32)
        for i, pivot in enumerate(prefix):
            at = slice(self.edges[pivot], self.edges[pivot + 1])
            rows, place = self.rows[at], self.places[at]
            gain[rows] += (self.length - i) + (self.length - place) - np.abs(i - place)
        keep = max(least, int(share * len(gain)))
        if keep < len(gain):
            key = -gain.astype(np.int64) * len(gain) + np.arange(len(gain))
            near = np.sort(np.argpartition(key, keep)[:keep])
        else:
            near = np.arange(len(gain))
        near = near[self.ids[near] != query_id]
        score = (self.vectors[near] * query).sum(axis=1)
        best = np.lexsort((self.ids[near], -score))[:k]
        return self.ids[near][best], score[best]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", pivots: int = 256, length: int = 64, share: float = 0.3,
    least: int = 400, block_rows: int = 4096, query_rows: int = 1024,
) -> DataFrame:
    """For each row of `queries`, its `k` nearest rows of `vectors` by inner product, the query's own id excepted.

    Pivots are a bounded sample; every row is indexed. Rows are dealt into blocks of about `block_rows` by a hash of the
    id, queries into blocks of about `query_rows`; each pair of blocks is one group, holding a permutation index of its
    rows. A query takes the `share` of a block nearest by footrule distance over prefixes of `length` pivots and reranks
    them by the exact inner product in doubles; the best k of all blocks remain. A frequent vector spreads over all blocks.

    Returns query_id, rank (from 1), vec_id, score; ties to the smaller vec_id. Vectors null, zero or with null or
    non-finite components take no part, nor do those whose length is not that of most rows (of equals the smallest). Rows
    that repeat an id are candidates of their own, and as queries, where their vectors differ, each gets ranks of its own.
    Fewer candidates than k: all. Empty tables give no rows; other columns are ignored.
    """
    rows = usable(vectors, key, vector)
    usual = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "n").first()
    length_of = usual["n"] if usual else 0
    rows = rows.filter(F.size("v") == length_of)
    asked = usable(queries, key, vector).filter(F.size("v") == length_of).withColumn("h", F.xxhash64("v")).dropDuplicates(["id", "h"])
    pivot_table = choose_pivots(rows, pivots)
    shared = vectors.sparkSession.sparkContext.broadcast(pivot_table)  # at most `pivots` rows
    n_rows, n_queries = rows.count(), asked.count()
    blocks, parts = max(1, -(-n_rows // block_rows)), max(1, -(-n_queries // query_rows))
    deal = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    left = rows.withColumn("b", deal(blocks, 1)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.withColumn("q", deal(parts, 2)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(group: tuple, near: pd.DataFrame, sought: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(near) and len(sought):
            table = shared.value
            block = Block(near["id"].to_numpy(), np.stack(near["v"].to_numpy()), table, length)
            q = np.stack(sought["v"].to_numpy())
            for qid, h, query, prefix in zip(sought["id"].to_numpy(), sought["h"].to_numpy(), q, prefixes(q, table, length), strict=True):
                ids, score = block.search(qid, query, prefix, k, share, least)
                out.append((np.full(len(ids), qid), np.full(len(ids), h), ids, score))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]
        return pd.DataFrame(dict(zip(("query_id", "h", "vec_id", "score"), columns, strict=True)))

    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(run, "query_id long, h long, vec_id long, score double")
    # at most k rows of each block meet again
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
