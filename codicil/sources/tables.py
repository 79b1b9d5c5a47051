"""Typed table scans, page lines, evaluation files, and idempotent writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVALUATION_SCHEMA = "id string, category string, question string, expected_answer string, expected_behavior string, clause_ids string, versions string, documents string"
RECORD_SCHEMA = "id string, status string, answer string, summary string, reason string, key_rank string, seconds double, sources array<string>"


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Read a stored table; columns and filters reach the scan."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def evaluation_rows(spark: SparkSession, path: str) -> DataFrame:
    """Questions with expected answers from CSV with a header."""
    return spark.read.csv(path, header=True, schema=EVALUATION_SCHEMA, multiLine=True, escape='"')


def evaluation_records(spark: SparkSession, path: str) -> DataFrame:
    """One JSON record per answered question; `key_rank` is a number or ``n/a``."""
    return spark.read.schema(RECORD_SCHEMA).json(path)


def write_grades(df: DataFrame, path: str) -> None:
    """Graded table as CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)


def page_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per non-blank line, with the number of its block (blocks are parted by empty lines) and its own number."""
    blocks = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n\n")).alias("block", "block_text"))
    lines = blocks.select(key, "block", F.posexplode(F.split("block_text", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.trim("line")).filter("line <> ''")


def spread(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled, never broadcast: Spark takes exploded rows to be as few as the rows they come from."""
    return df.hint("merge")


def pages(df: DataFrame, key: str, order: str, parts: int | None = None) -> DataFrame:
    """Rows of a document together and in order, for bounded windows of pages."""
    dealt = df.repartition(parts, key) if parts else df.repartition(key)
    return dealt.sortWithinPartitions(key, order)


def render_rows(df: DataFrame, header: str, cells: str) -> Column:
    """A table row as ``Header: cell | Header: cell``; empty cells are left out."""
    pairs = F.zip_with(header, cells, lambda h, c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", None).when(F.coalesce(F.trim(h), F.lit("")) == "", F.trim(c)).otherwise(F.concat(F.trim(h), F.lit(": "), F.trim(c))))
    return F.array_join(F.filter(pairs, lambda p: p.isNotNull()), " | ")


def append_new(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `df` whose key `target` lacks, one per key: what an insert that ignores conflicts adds."""
    return df.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def upsert(df: DataFrame, target: DataFrame, keys: list[str], version: str) -> DataFrame:
    """`target` with the rows of `df` put in by key; of several for one key the largest `version` stays."""
    rows = target.withColumn("_fresh", F.lit(0)).unionByName(df.withColumn("_fresh", F.lit(1)))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_fresh"), F.desc(version)))
    return rows.withColumn("_k", best).filter("_k = 1").drop("_k", "_fresh")


def overwrite_partition(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions of `by` that `df` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def sync_scope(chunks: DataFrame, docs: DataFrame, key: str, scope: list[str]) -> DataFrame:
    """Chunks with their document's scope columns."""
    own = docs.select(key, *[F.col(c).alias(f"_{c}") for c in scope], F.lit(True).alias("_met"))
    met = chunks.join(own, key, "left")
    return met.select(*[F.when(F.col("_met"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in scope else c for c in chunks.columns])
