"""Batches of uploads: planned dates, the policies they belong to, and checks of what has been indexed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.text import title_key
from codicil.operators.hybrid import cosine, first
from codicil.operators.matching import norm, score_candidates
from codicil.operators.retrieval import match_candidates
from codicil.sources.scratch import stored

# How alike names must be, how many candidates are scored, and how many chunks a check samples.
NAME_MATCH, CANDIDATES, SAMPLES = 0.6, 5, 5


def plan_dates(uploads: DataFrame) -> DataFrame:
    """Effective dates of a batch's versions (batch_id, place: oldest first, entered, stated, uploaded_on).

    Entered dates stay. Else the date that the document states, if it is before the next version's; else the newest version gets
    its day of upload and an older one the day before the version after it. Versions of a batch are folded from the newest, in one
    row of small structs. Returns batch_id, place, effective_from, source (entered, detected, upload_date, inferred), forced
    (a stated date that did not fit).
    """
    none = "array<struct<place:int,day:date,source:string,forced:boolean>>"
    start = F.struct(F.lit(None).cast("date").alias("after"), F.array().cast(none).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = x["stated"].isNotNull() & (acc["after"].isNull() | (x["stated"] < acc["after"]))
        day = F.when(x["entered"].isNotNull(), x["entered"]).when(fits, x["stated"]).when(acc["after"].isNull(), x["uploaded_on"]).otherwise(F.date_sub(acc["after"], 1))
        source = F.when(x["entered"].isNotNull(), "entered").when(fits, "detected").when(acc["after"].isNull(), "upload_date").otherwise("inferred")
        row = F.struct(x["place"].alias("place"), day.alias("day"), source.alias("source"), ((source == "inferred") & x["stated"].isNotNull()).alias("forced"))
        return F.struct(day.alias("after"), F.array_append(acc["out"], row).alias("out"))

    item = F.struct(F.col("place").cast("int").alias("place"), "entered", "stated", "uploaded_on")
    rows = uploads.groupBy("batch_id").agg(F.sort_array(F.collect_list(item), asc=False).alias("all"))
    return rows.select("batch_id", F.explode(F.aggregate("all", start, step)["out"]).alias("o")).select("batch_id", "o.place", F.col("o.day").alias("effective_from"), "o.source", "o.forced")


def existing_policy(uploads: DataFrame, policies: DataFrame) -> DataFrame:
    """The policy that each upload (document_id, u_*) is a version of, before it is stored; columns as `score_candidates` takes them,
    policies (policy_id, p_*), and intended_policy_id of the upload where someone chose one.

    Candidates have the upload's policy number or document number, or a title at least `NAME_MATCH` alike; the `CANDIDATES` most
    alike are scored. A candidate is the same policy by its number, or by document number or title if no number clashes. The
    intended one wins if it fits, else the best score, of equals the smallest policy_id. Each way to meet is an equi-join.
    Returns document_id, policy_id, score, reason (policy_number, document_number, title).
    """
    key = lambda df, side, c, *more: df.filter(norm(F.col(f"{side}_{c}")) != "").select(norm(F.col(f"{side}_{c}")).alias("key"), "document_id" if side == "u" else "policy_id", *more)
    intended = uploads.filter("intended_policy_id is not null")
    pairs = None
    for c in ("number", "document_number"):
        # a key's first policies are found once; an intended policy is looked up by itself
        lead = first(key(policies, "p", c).distinct(), ["key"], ["policy_id"], CANDIDATES, "k").drop("k")
        met = key(uploads.filter("intended_policy_id is null"), "u", c).join(lead, "key").select("document_id", "policy_id")
        meant = key(intended.withColumn("policy_id", F.col("intended_policy_id")), "u", c, "policy_id").join(key(policies, "p", c), ["policy_id", "key"]).select("document_id", "policy_id")
        pairs = met.unionByName(meant) if pairs is None else pairs.unionByName(met).unionByName(meant)
    left = uploads.select("document_id", title_key(F.col("u_title")).alias("title")).filter("title <> ''")
    right = policies.select("policy_id", title_key(F.col("p_title")).alias("title")).filter("title <> ''")
    a, b = left.groupBy("title").agg(F.min("document_id").alias("left_id")), right.groupBy("title").agg(F.min("policy_id").alias("right_id"))
    alike = stored(match_candidates(a, b, NAME_MATCH), "alike")
    # the best policies of each title are found once; an intended policy is looked up by itself
    few = first(right.join(b, "title"), ["title"], ["policy_id"], CANDIDATES, "k").select("right_id", "policy_id")
    of_title = first(alike.join(few, "right_id"), ["left_id"], [F.desc("similarity"), "policy_id"], CANDIDATES, "k").select("left_id", "policy_id", "similarity")
    keyed = left.join(a, "title").select("document_id", "left_id")
    chosen = uploads.filter("intended_policy_id is not null").select("document_id", F.col("intended_policy_id").alias("policy_id"))
    meant = chosen.join(keyed, "document_id").join(right.join(b, "title").select("policy_id", "right_id"), "policy_id").join(alike, ["left_id", "right_id"])
    named = keyed.join(of_title, "left_id").select("document_id", "policy_id", "similarity").unionByName(meant.select("document_id", "policy_id", "similarity"))
    every = pairs.withColumn("similarity", F.lit(0.0)).unionByName(named).groupBy("document_id", "policy_id").agg(F.max("similarity").alias("similarity"))
    every = every.join(uploads.select("document_id", "intended_policy_id"), "document_id").filter(F.col("intended_policy_id").isNull() | (F.col("intended_policy_id") == F.col("policy_id")))
    best = first(every, ["document_id"], [F.desc("similarity"), "policy_id"], CANDIDATES, "k").select("document_id", "policy_id", "similarity")
    rows = score_candidates(best.join(uploads, "document_id").join(policies, "policy_id"))
    given = lambda c: (norm(F.col(f"u_{c}")) != "") & (norm(F.col(f"p_{c}")) != "")
    same_document = given("document_number") & (norm(F.col("u_document_number")) == norm(F.col("p_document_number")))
    reason = F.when(F.col("same_number"), "policy_number").when(given("number"), None).when(same_document, "document_number").when(F.col("similarity") >= NAME_MATCH, "title")
    fits = rows.withColumn("reason", reason).filter("reason is not null")
    return first(fits, ["document_id"], [F.desc("score"), "policy_id"], 1, "k").select("document_id", "policy_id", "score", "reason")


def index_self_check(chunks: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """How many of a document's sampled chunks (chunk_id, document_id, vector) are their own nearest neighbour in it by cosine.

    A sample is drawn by a hash of the chunk's id. Samples meet only their document's chunks; of equally near ones the smallest id
    counts, so a copy of an earlier chunk is a miss. Chunks without a vector take no part. Returns document_id, n_sampled, n_hits.
    """
    rows = chunks.filter("vector is not null").select("chunk_id", "document_id", "vector")
    drawn = first(rows, ["document_id"], [F.md5(F.col("chunk_id").cast("string")), "chunk_id"], samples, "k").select("document_id", F.col("chunk_id").alias("asked"), F.col("vector").alias("v"))
    near = drawn.join(rows, "document_id").select("document_id", "asked", "chunk_id", cosine("v", "vector").alias("c"))
    best = near.groupBy("document_id", "asked").agg(F.min_by("chunk_id", F.struct(-F.col("c"), "chunk_id")).alias("nearest"))
    return best.groupBy("document_id").agg(F.count("*").alias("n_sampled"), F.count_if(F.col("asked") == F.col("nearest")).alias("n_hits"))
