"""Shared helpers of the training-data operators: tables in the cluster's shared folder and skew-safe lookups."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only where the setting is absent (tests on one machine) a temporary folder is made and used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(spark.sparkContext, "_codicil_dir", None)
        if not found:
            found = tempfile.mkdtemp(prefix="spark-codicil-")
            spark.sparkContext._codicil_dir = found
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path of the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write.option("compression", "zstd")
    # once the table is written, nothing reads the shuffles behind it again
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._codicil_path = path
    return back


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker hands freed memory back to the system, as Spark keeps idle workers for the next stage."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # a C library without it
            pass

    return wrapped


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand at most `rows` rows at a time to Python, so that whole texts take little memory on either side."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting)) <= rows:
        spark.conf.set(setting, str(rows))


def discard(*tables: DataFrame) -> None:
    """Delete tables made by `stored` that no later plan reads."""
    for df in tables:
        path = getattr(df, "_codicil_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def documents(df: DataFrame, *more: str) -> DataFrame:
    """`doc_id` and `text` (null: empty) of a documents table, with the columns named in `more`."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def crc32_text(column: Column) -> Column:
    """Unsigned CRC-32 of a text's UTF-8 bytes."""
    return F.crc32(F.encode(column, "UTF-8"))


def lookup(left: DataFrame, right: DataFrame, key: str, count: str, total: int, share: float = 1e-3) -> DataFrame:
    """Left-join `right` (one row per `key`, with `count` rows of `left` behind it) so that no key is too hot.

    Keys that hold at least `share` of the `total` rows number at most 1/`share`, so they are broadcast;
    the rest is an ordinary shuffled join in which no key holds more than that share.
    """
    least = max(2, int(total * share))
    hot = right.filter(F.col(count) >= least).withColumn("hot_", F.lit(True))
    tagged = left.join(F.broadcast(hot.select(key, "hot_")), key, "left")
    names = [c for c in right.columns if c != key]
    warm = tagged.filter("hot_").drop("hot_").join(F.broadcast(hot.drop("hot_")), key, "left")
    cold = tagged.filter("hot_ is null").drop("hot_").join(right.filter(F.col(count) < least), key, "left")
    return warm.select(*left.columns, *names).unionByName(cold.select(*left.columns, *names))
