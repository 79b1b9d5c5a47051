"""The evidence of each question, put together from its candidates: reranked, thinned, diversified, cleaned, and set in context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.operators.answers import one_copy, rerank
from codicil.operators.evidence import select_evidence
from codicil.operators.hybrid import first
from codicil.operators.matching import INSTRUCTIONS
from codicil.operators.phrases import stem_coverage
from codicil.operators.structure import expand_context
from codicil.sources.scratch import stored

# The share of the rerank score, passages of one document, and characters of context.
RERANK_SHARE, EACH, CONTEXT = 0.5, 3, 600


def assemble_evidence(queries: DataFrame, cands: DataFrame, passages: DataFrame, prints: DataFrame, required: DataFrame | None = None, limit: int = 14, top: int = 24) -> tuple[DataFrame, DataFrame]:
    """Evidence of each question (query_id, text) from its candidates (query_id, doc_id, fused, rank), and its coverage.

    Passages are (doc_id, document_id, family, section_id, chunk_index, text), prints (doc_id, simhash). Of the first `4 * top`
    candidates, half the lexical score and half the fused one by the question's best make the score; then of equal passages and of
    copies under other families the best stays; of the `top` best that remain, `limit` are chosen, three of a document first.
    Passages that must be there (`required`: query_id, doc_id) follow. Sentences that instruct an assistant go, and passages of
    which nothing is left; context is what stands before and after in the section, cleaned likewise.

    Returns rows (query_id, place, doc_id, score, rerank_score, text, before, after, cleaned) and (query_id, coverage, missing).
    """
    found = stored(cands.filter(F.col("rank") <= max(4 * top, limit)).select("query_id", "doc_id", "fused"), "candidates")
    text = passages.select("doc_id", "text")
    scored = rerank(queries, found.join(text, "doc_id").select("query_id", F.col("doc_id").alias("item_id"), "text")).select("query_id", F.col("item_id").alias("doc_id"), F.col("score").alias("rerank_score"))
    best = F.max("fused").over(Window.partitionBy("query_id"))
    exact = lambda x, kind="decimal(10,6)": x.cast(kind)  # noqa: E731  # halves are rounded alike everywhere
    fused = exact(F.round(F.when(best > 0, F.col("fused") / best).otherwise(0.0), 6))
    blended = F.round(exact(F.col("rerank_score")) * exact(F.lit(RERANK_SHARE), "decimal(2,1)") + fused * exact(F.lit(1 - RERANK_SHARE), "decimal(2,1)"), 4).cast("double")
    rows = found.join(scored, ["query_id", "doc_id"]).withColumn("score", blended)
    words = F.md5(F.array_join(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z0-9]+)")), " "))
    rows = first(rows.join(text.select("doc_id", words.alias("same")), "doc_id"), ["query_id"], [F.desc("score"), "doc_id"], max(4 * top, limit))
    rows = stored(first(rows, ["query_id", "same"], ["rank"], 1, "k").drop("k", "same"), "ranked")
    kept = one_copy(rows.select("query_id", "doc_id", "rank"), prints, passages.select("doc_id", "family"))
    kept = first(kept.select("query_id", "doc_id", F.col("rank").alias("was")), ["query_id"], ["was"], top).drop("was")
    chosen = select_evidence(kept.join(passages.select("doc_id", "document_id"), "doc_id"), "document_id", limit, EACH).select("query_id", "doc_id", "place")
    if required is not None:
        more = required.select("query_id", "doc_id").distinct().join(chosen, ["query_id", "doc_id"], "left_anti")
        last = chosen.groupBy("query_id").agg(F.max("place").alias("last"))
        k = F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id"))
        chosen = chosen.unionByName(more.join(last, "query_id", "left").select("query_id", "doc_id", (F.coalesce("last", F.lit(0)) + k).cast("int").alias("place")))
    bad = lambda s: F.rlike(F.lower(s), F.lit(INSTRUCTIONS))
    parts = F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?\n])")
    clean = passages.select("doc_id", "section_id", "chunk_index", parts.alias("p")).select("doc_id", "section_id", "chunk_index", F.array_join(F.filter("p", lambda s: ~bad(s)), "").alias("text"), F.exists("p", bad).alias("cleaned"))
    items = chosen.join(rows.select("query_id", "doc_id", "score", "rerank_score"), ["query_id", "doc_id"], "left").join(clean, "doc_id").filter("trim(text) <> ''")
    items = stored(items, "items")
    around = expand_context(items.select("query_id", "section_id", "chunk_index"), clean, 1, CONTEXT)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    out = items.join(around, ["query_id", "section_id", "chunk_index"], "left").select(
        "query_id", place.cast("int").alias("place"), "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("rerank_score", F.lit(0.0)).alias("rerank_score"), "text",
        F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), "cleaned",
    )
    return out, stem_coverage(queries, items.select("query_id", F.col("doc_id").alias("item_id"), "text"))
