"""Connected components of a links table: union-find inside partitions, and large-star steps between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.llm.common import discard, stored, tidy

EDGE = "u long, v long"


def smallest_linked(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest number in the component of each of the numbers below `n`, linked by a[i] - b[i]: roots hook onto smaller roots."""
    parent = np.arange(n)
    while len(a):
        x, y = parent[a], parent[b]
        live = x != y
        a, b, x, y = a[live], b[live], x[live], y[live]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's links (u, v), each node but the smallest of its component here, linked to that smallest."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    ends = np.concatenate([table.column(i).to_numpy() for i in range(2)])
    nodes, number = np.unique(ends, return_inverse=True)
    root = smallest_linked(number[: len(number) // 2], number[len(number) // 2 :], len(nodes))
    some = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], names=["u", "v"])


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """Rows (node, root) of every node with a link: root is the smallest node of its component.

    Links meet by their larger end in partitions, where union-find thins them. Then, in each round, every node's neighbours
    are linked to the smallest of them (a join on the node, which Spark splits where a node has very many), and meet again. Ends when every node has one link and no root has one of its
    own; raises if `rounds` rounds, where given, don't get so far. A partition of the shuffle is held in memory as arrays.
    An empty table gives no rows.
    """
    meet = lambda df: stored(df.repartition("u").mapInArrow(tidy(forest), EDGE), "edges")
    edges = meet(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v"))
    done = 0
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(True).alias("up")), F.struct(F.col("v").alias("x"), F.lit(False).alias("up")))).alias("e"))
        open_nodes = ends.groupBy("e.x").agg(F.count_if("e.up").alias("ups"), F.count("*").alias("n")).filter("ups > 1 or ups > 0 and n > ups")
        if open_nodes.isEmpty():
            found = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
            found._codicil_path = edges._codicil_path  # so that `discard` takes the table behind it
            return found
        if done == rounds:
            raise RuntimeError(f"the components still change after {rounds} rounds")
        done += 1
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        last, edges = edges, meet(large)
        discard(last)
