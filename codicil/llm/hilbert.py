"""Sharding along a Hilbert curve over several metadata dimensions (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.llm.common import crc32_text, stored


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a point with integer coordinates below 2**`bits` in every dimension.

    Skilling's transform: walk the bit planes from the top, exchange or invert the low bits, Gray-encode, interleave.
    The walk is a fold over (plane, dimension) steps, so the expression does not grow with the number of bits.
    """
    n = len(cells)
    steps = F.array(*[F.lit(j) for j in range((bits - 1) * n)])
    start = F.array(*[c.cast("long") for c in cells])

    def step(x: Column, j: Column) -> Column:
        i = F.pmod(j, F.lit(n))
        q = F.expr("1L").cast("long") * F.pow(F.lit(2), F.lit(bits - 1) - F.floor(j / n)).cast("long")
        xi, x0 = F.element_at(x, (i + 1).cast("int")), F.element_at(x, 1)
        swap = x0.bitwiseXOR(xi).bitwiseAND(q - 1)
        return F.when(
            xi.bitwiseAND(q) != 0, F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(q - 1)).otherwise(v))
        ).otherwise(F.transform(x, lambda v, k: F.when((k == 0) & (i == 0), v).when((k == 0) | (k == i), v.bitwiseXOR(swap)).otherwise(v)))

    turned = F.aggregate(steps, start, step)
    gray = F.aggregate(
        turned, F.expr("array_remove(array(0L), 0L)"), lambda acc, v: F.array_append(acc, F.when(F.size(acc) == 0, v).otherwise(v.bitwiseXOR(F.element_at(acc, -1))))
    )
    planes = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)]).cast("array<bigint>")
    flip = lambda g: F.aggregate(planes, F.lit(0).cast("long"), lambda t, q: F.when(F.element_at(g, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    # one-element arrays keep each intermediate computed once
    return F.element_at(
        F.transform(
            F.array(gray),
            lambda g: F.element_at(
                F.transform(
                    F.array(flip(g)),
                    lambda t: F.aggregate(
                        F.array(*[F.lit(p) for p in range(bits * n)]),
                        F.lit(0).cast("long"),
                        lambda acc, p: acc * 2
                        + F.when(
                            F.element_at(g, (F.pmod(p, F.lit(n)) + 1).cast("int"))
                            .bitwiseXOR(t)
                            .bitwiseAND(F.pow(F.lit(2), F.lit(bits - 1) - F.floor(p / n)).cast("long"))
                            != 0,
                            1,
                        ).otherwise(0),
                    ),
                ),
                1,
            ),
        ),
        1,
    )


def shard_by_curve(docs: DataFrame, shards: int, dimensions: list[Column], bits: int = 6) -> DataFrame:
    """Order documents along a Hilbert curve and cut the order into `shards` runs.

    Every entry of `dimensions` is a Column over the documents that gives a non-negative integer; it is cut to `bits`
    bits. Equal texts stay adjacent: all copies take the cell of the copy with the smallest doc_id, and ties on the curve
    are broken by text digest, then doc_id. The runs follow the law ``rows``: shard sizes differ by one row at most.
    Positions are global: a range-partitioned sort, positions inside partitions, and one offset per partition.

    Returns the columns of `docs` except text, and size (UTF-8 bytes plus 8), text_crc32, curve, law, shard, slot
    (gapless from 0 in each shard), grown_shard (null under this law). Null texts count as empty; null coordinates as 0;
    empty tables give no rows; repeated rows get slots of their own; texts of any length count by their size and digests
    only. Columns named like outputs are dropped.
    """
    outputs = ("size", "text_crc32", "curve", "law", "shard", "slot", "grown_shard")
    text = F.coalesce(F.col("text"), F.lit(""))
    top = F.lit((1 << bits) - 1)
    cells = F.array(*[F.least(F.coalesce(c.cast("long"), F.lit(0)), top) for c in dimensions])
    keep = [c for c in docs.columns if c not in outputs and c != "text"]
    rows = docs.select(
        F.struct(*keep).alias("row_"), F.col("doc_id").alias("id_"), (F.octet_length(text) + 8).cast("long").alias("size"), crc32_text(text).alias("text_crc32"), F.xxhash64(text).alias("key_"), cells.alias("cell_")
    )
    first = rows.groupBy("key_").agg(F.min(F.struct("id_", "cell_")).alias("rep_"), F.count("*").alias("n_")).filter("n_ > 1")
    total = rows.count()
    # copies: at most 1000 keys hold a thousandth of the rows each
    hot = first.filter(F.col("n_") * 1000 >= total)
    cold = first.filter(F.col("n_") * 1000 < total)
    placed = (
        rows.join(F.broadcast(hot.select("key_", F.col("rep_.cell_").alias("hot_"))), "key_", "left")
        .withColumn("cold_key_", F.when(F.col("hot_").isNull(), F.col("key_")).otherwise(F.xxhash64("id_", "key_")))
        .join(cold.select(F.col("key_").alias("cold_key_"), F.col("rep_.cell_").alias("warm_")), "cold_key_", "left")
        .withColumn("cell_", F.coalesce("hot_", "warm_", "cell_"))
    )
    n = len(dimensions)
    curve = hilbert_index([F.element_at("cell_", i + 1) for i in range(n)], bits)
    ordered = placed.withColumn("curve", curve).orderBy("curve", "key_", "id_")
    mask = F.lit((1 << 33) - 1)
    at = F.monotonically_increasing_id()
    kept = stored(ordered.select("row_", "size", "text_crc32", "curve", at.alias("at_")), "curve").withColumn("part_", F.shiftright("at_", 33))
    counts = kept.groupBy("part_").agg(F.count("*").alias("n_"))
    # one row for each partition of the sort, whatever the input
    w = Window.orderBy("part_")
    offsets = counts.withColumn("before_", F.sum("n_").over(w) - F.col("n_")).withColumn("all_", F.sum("n_").over(Window.partitionBy()))
    rank = F.col("at_").bitwiseAND(mask) + F.col("before_")
    cut = kept.join(F.broadcast(offsets), "part_").withColumn("rank_", rank).withColumn("shard", F.expr(f"(rank_ * {shards}) div all_").cast("int"))
    return cut.select(
        "row_.*", "size", "text_crc32", "curve", F.lit("rows").alias("law"), "shard",
        F.expr(f"rank_ - ((shard * all_ + {shards} - 1) div {shards})").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def document_dimensions() -> list[Column]:
    """Cells of a document: language, source and magnitude of its text."""
    size = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    return [
        F.pmod(F.xxhash64("lang"), F.lit(64)),
        F.pmod(F.xxhash64("source"), F.lit(64)),
        F.least(F.lit(63), F.floor(F.log2(size + 1) * 3)),
    ]
