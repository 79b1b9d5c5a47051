"""From documents to token ids: toxic texts go, near copies go, repeated passages go, sources are mixed, texts are encoded.

SQL cannot state the learned first stage, so ORACLE_SQL is None; tests hold each stage against a brute-force version.

Every stage takes an empty table (no rows come out), null languages, sources and doc_ids, texts of any length, and extra
columns, which it drops. Null and empty texts pass the first three stages, the third as empty texts; the fourth drops texts
without words. Rows that repeat doc_id and text pass the first stage; the second keeps one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.llm import jaccard_join, mixing, pieces, repeats, toxicity
from codicil.llm.common import stored
from codicil.llm.queries import public_file, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    scored = toxicity.toxicity(docs.select(*COLUMNS), read(spark, sf_dir, "labels"), carry=["text", "lang", "source", "n_chars"])
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of texts that five-word shingles link at 0.8; rows repeated go."""
    docs = docs.select(*COLUMNS)
    found = jaccard_join.similarity_components(docs).filter("doc_id <=> component_id").select(F.col("doc_id").alias("keep_")).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found["keep_"]), "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes that came before; texts of which nothing is left go. Cut characters go whole."""
    cut = repeats.remove_repeats(docs, carry=["lang", "source"], whole=True).filter("n_removed = 0 or length(kept) > 0")
    text = F.col("kept").cast("string")
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many words as came in, mixed to the target weights: a document stands once for each epoch that takes it.

    Where only a part of a document is taken, its text ends after that many words. Documents without words go.
    """
    chosen = mixing.mix(docs, mixing.document_tree(), mixing.DOCUMENT_WEIGHTS, percent=100, max_epochs=2, seed=7)
    chosen = chosen.select(F.col("doc_id").alias("took_"), "epoch", "n_tokens", "take_tokens").distinct()
    met = docs.select(*COLUMNS).withColumn("words_", mixing.word_count(F.col("text"))).join(chosen, F.col("doc_id").eqNullSafe(F.col("took_")) & (F.col("words_") == F.col("n_tokens")))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("take_tokens").cast("int")), "")
    text = F.when(F.col("take_tokens") < F.col("n_tokens"), part).otherwise(F.col("text"))
    return met.select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with what their decoding gave."""
    return pieces.round_trip(docs, public_file("piece_bpe_32k.model", "PIECE_MODEL"), more=["lang", "source"], with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("repeats", drop_repeats), ("mixing", mix_sources), ("encoding", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each one's rows written to the shared folder before the next begins."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
