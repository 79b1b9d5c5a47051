"""Choosing and checking evidence for whole tables of queries, and grading retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.text import tokens


def coverage(queries: DataFrame, docs: DataFrame, cands: DataFrame) -> DataFrame:
    """Share of each query's distinct terms that a candidate text holds, to six places."""
    own = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("q"))
    met = cands.join(own, "query_id").join(docs.select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("d")), "doc_id")
    share = F.when(F.size("q") > 0, F.size(F.array_intersect("q", "d")) / F.size("q")).otherwise(0.0)
    return met.select(*cands.columns, F.round(share, 6).alias("coverage"))


def distinct_passages(cands: DataFrame, docs: DataFrame) -> DataFrame:
    """The first candidate by rank of each text of a query."""
    met = cands.join(docs.select("doc_id", F.md5(F.regexp_replace(F.lower("text"), r"\s+", " ")).alias("_same")), "doc_id")
    k = F.row_number().over(Window.partitionBy("query_id", "_same").orderBy("rank"))
    return met.withColumn("_k", k).filter("_k = 1").select(*cands.columns)


def select_evidence(cands: DataFrame, group: str, most: int = 14, each: int = 3) -> DataFrame:
    """Up to `most` candidates of a query: first by rank those among the first `each` of their group, then the rest."""
    inside = F.row_number().over(Window.partitionBy("query_id", group).orderBy("rank"))
    met = cands.withColumn("_late", (inside > each).cast("int"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_late", "rank")).cast("int")
    return met.withColumn("place", place).filter(F.col("place") <= most).drop("_late")


def gate(graded: DataFrame, least_score: float = 0.18, least_coverage: float = 0.4) -> DataFrame:
    """Why a query cannot be answered from its evidence: no items, a low best score, or low coverage; else ``ok``."""
    per = graded.groupBy("query_id").agg(F.count("doc_id").alias("n_items"), F.max("score").alias("best"), F.max("coverage").alias("covered"))
    reason = F.when(F.col("n_items") == 0, "no_items").when(F.col("best") < least_score, "low_score").when(F.col("covered") < least_coverage, "low_coverage").otherwise("ok")
    return per.withColumn("reason", reason)


def blend(cands: DataFrame) -> DataFrame:
    """Half the coverage and half the score by the query's best score, to six places."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return cands.withColumn("blended", F.round(0.5 * F.col("coverage") + 0.5 * F.col("score") / best, 6))


def grounded(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Whether all numbers of `claim` occur in `source`."""
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)")))
    return texts.select(*keys, (F.size(F.array_except(numbers(F.col("claim")), numbers(F.col("source")))) == 0).alias("grounded"))


def retrieval_metrics(ranks: DataFrame, by: str) -> DataFrame:
    """Recall at 1, 3, 5 and 10 and mean reciprocal rank; a missing rank is a miss, rows with ``n/a`` are left out."""
    kept = ranks.filter("key_rank is null or key_rank <> 'n/a'").withColumn("r", F.col("key_rank").cast("int"))
    recall = [F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in (1, 3, 5, 10)]
    return kept.groupBy(by).agg(F.count("*").alias("n"), *recall, F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def latency(rows: DataFrame, by: str, value: str, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Nearest-rank percentiles: the value at position floor(q * n), counted from 0, at most n - 1.

    Values are first counted by distinct value, so that a key with most rows is summed before it is ordered.
    """
    per = rows.groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by)
    upto = F.sum("c").over(w.orderBy(value))
    met = per.withColumn("upto", upto).withColumn("n", F.sum("c").over(w))
    at = lambda q: F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n")))
    some = [F.min(F.when(F.col("upto") > at(q), F.col(value))).alias(f"p{round(q * 100)}") for q in quantiles]
    return met.groupBy(by).agg(*some)


def grade_summary(rows: DataFrame, by: str, verdict: str, verdicts: list[str]) -> DataFrame:
    """Verdicts counted by category, a column each."""
    return rows.groupBy(by).pivot(verdict, verdicts).agg(F.count(F.lit(1))).fillna(0)


def consistency(rows: DataFrame, key: str, verdict: str) -> DataFrame:
    """Keys with their number of distinct verdicts; consistent if there is one."""
    return rows.groupBy(key).agg(F.countDistinct(verdict).alias("n_verdicts")).withColumn("consistent", F.col("n_verdicts") == 1)


def key_rank(cands: DataFrame, keys: DataFrame) -> DataFrame:
    """Rank of the first candidate among each query's expected texts; null if there is none."""
    met = cands.join(keys, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("key_rank"))
    return keys.select("query_id").distinct().join(met, "query_id", "left")


def pattern_counts(rows: DataFrame, by: str, column: str, probes: list[str]) -> DataFrame:
    """How many texts of each key hold each probe, in any case."""
    hit = lambda p: F.contains(F.lower(F.col(column)), F.lit(p.lower()))
    return rows.groupBy(by).agg(*[F.count_if(hit(p)).alias(f"probe_{i}") for i, p in enumerate(probes)])


def numeric_conflicts(facts: DataFrame, group: list[str], owner: str) -> DataFrame:
    """Kinds of figures of a group in which its owners differ: how many owners, values, and the extremes."""
    per = facts.groupBy(*group, "kind", "value").agg(F.countDistinct(owner).alias("owners"))
    met = per.groupBy(*group, "kind").agg(F.count("*").alias("n_values"), F.sum("owners").alias("n_owners"), F.min("value").alias("first_value"), F.max("value").alias("last_value"))
    return met.filter("n_values > 1")


def any_of(column: Column, words: list[str]) -> Column:
    """Whether a lower-case text holds one of some words."""
    return F.lower(column).rlike(r"\b(?:" + "|".join(words) + r")\b")
