"""Uploads against policies: scores and decisions; planned dates and moves of versions; the same rule over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.text import content_similarity, tokens, trigram_similarity, trigrams
from codicil.operators.timeline import build_timeline, effective_on

# What each signal is worth, and where decisions begin.
WEIGHTS = {"number": 0.40, "number_differs": -0.35, "document": 0.15, "title": 0.25, "issuer": 0.05, "category": 0.05, "content": 0.10, "structure": 0.10}
HIGH, LOW = 0.75, 0.45
# What a document says to an assistant instead of to its readers.
INSTRUCTIONS = (
    r"\b(?:ignore|disregard|forget|override|bypass)\b[^.!?\n]{0,30}?\b(?:(?:all|any|the|your|my)\s+)?(?:previous|prior|above|earlier|system|hidden)\s+(?:instructions?|prompts?|messages?)"
    r"|\bdeveloper\s+mode\b|\bjail\s*-?\s*break\w*|\bdo\s+anything\s+now\b|\b(?:note|instructions?|message)\s+(?:to|for)\s+(?:the\s+|any\s+)?(?:ai|assistant|chatbot|language\s+model)\b"
)


def norm(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]", "")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays in their union; null if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def score_candidates(pairs: DataFrame) -> DataFrame:
    """Score of each pair of an upload (u_*) and a policy (p_*) from weighted signals, between 0 and 0.99, to three places.

    Columns: number, document_number, title, issuer, category, simhash, keys (an array). What is missing on either side says
    nothing; but numbers that differ count against the pair.
    """
    both = lambda c: (norm(F.col(f"u_{c}")) != "") & (norm(F.col(f"p_{c}")) != "")
    same = lambda c: both(c) & (norm(F.col(f"u_{c}")) == norm(F.col(f"p_{c}")))
    title = F.when(F.lower("u_title") == F.lower("p_title"), 1.0).otherwise(F.round(trigram_similarity(trigrams(F.col("u_title")), trigrams(F.col("p_title"))), 6))
    number = F.when(same("number"), WEIGHTS["number"]).when(both("number"), WEIGHTS["number_differs"]).otherwise(0.0)
    keys = F.coalesce(F.round(jaccard(F.col("u_keys"), F.col("p_keys")), 6), F.lit(0.0))
    content = F.coalesce(content_similarity(F.col("u_simhash"), F.col("p_simhash")), F.lit(0.0))
    flag = lambda c: F.when(same(c), 1.0).otherwise(0.0)
    total = number + WEIGHTS["document"] * flag("document_number") + WEIGHTS["title"] * title + WEIGHTS["issuer"] * flag("issuer") + WEIGHTS["category"] * flag("category") + WEIGHTS["content"] * content + WEIGHTS["structure"] * keys
    return pairs.withColumn("same_number", same("number")).withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(total, F.lit(0.99))), 3))


def version_check(uploads: DataFrame, versions: DataFrame) -> DataFrame:
    """What an upload (document_id, policy_id, label, day, content_hash) is to its policy's versions: a copy of one's content, a
    label or day that another has, a label that is later while the day is earlier or the reverse, an older version, or a new one."""
    key = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)")), lambda p: p.cast("int"))
    # uploads and versions of a policy stand in one table, so that no upload meets every version
    known = versions.filter("policy_id is not null").select("policy_id", F.col("version_label").alias("label"), F.col("effective_from").alias("day"), "content_hash", "version_id", F.lit(True).alias("known"))
    asked = uploads.select("document_id", "policy_id", "label", "day", "content_hash", F.lit(False).alias("known"))
    rows = asked.unionByName(known, allowMissingColumns=True).repartition("policy_id").distinct()
    newest = F.max(F.when(F.col("known"), F.struct("day", "version_id", "label"))).over(Window.partitionBy("policy_id"))
    has = lambda c: F.col(c).isNotNull() & F.max("known").over(Window.partitionBy("policy_id", c))
    met = rows.withColumn("last", newest).withColumn("same_hash", has("content_hash")).withColumn("same_label", has("label")).withColumn("same_day", has("day")).filter("not known")
    later = key(F.col("label")) > key(F.col("last.label"))
    what = (
        F.when(F.col("same_hash"), "content_duplicate").when(F.col("same_label"), "label_exists").when(F.col("same_day"), "day_exists")
        .when(later != (F.col("day") > F.col("last.day")), "order_mismatch").when(F.col("day") < F.col("last.day"), "historical").otherwise("new_version")
    )
    return met.select("document_id", "policy_id", what.alias("finding"))


def decide(uploads: DataFrame, scored: DataFrame, checks: DataFrame) -> DataFrame:
    """The decision for each upload from its best candidate (ties to the smaller policy): an amendment, a new policy, a review, or
    what the version check found. `amends` marks uploads that name what they amend."""
    best = scored.groupBy("document_id").agg(F.max_by(F.struct("policy_id", "score", "same_number"), F.struct("score", (-F.col("policy_id")).alias("i"))).alias("b"))
    met = uploads.select("document_id", "amends").join(best, "document_id", "left").select("document_id", "amends", "b.policy_id", "b.score", "b.same_number")
    met = met.join(checks.select("document_id", "policy_id", "finding"), ["document_id", "policy_id"], "left")
    decision = (
        F.when(F.col("amends") & ~F.coalesce("same_number", F.lit(False)), "amendment").when(F.coalesce("score", F.lit(0.0)) < LOW, "new_policy")
        .when(F.col("score") < HIGH, "review").otherwise(F.coalesce("finding", F.lit("new_version")))
    )
    return met.select("document_id", "policy_id", "score", decision.alias("decision"))


def not_copies(pairs: DataFrame) -> DataFrame:
    """Near-duplicate pairs (a_*, b_* with label, day, batch_id) that are copies: not told apart by a label or day both have, nor one batch."""
    differ = lambda c: F.coalesce(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(False))
    return pairs.filter(~differ("label") & ~differ("day") & ~F.coalesce(F.col("a_batch_id") == F.col("b_batch_id"), F.lit(False)))


def vocabulary_overlap(a: Column, b: Column) -> Column:
    """Share of the smaller vocabulary that the other text has; 0 if one has no words."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))).otherwise(0.0)


def unrelated_versions(versions: DataFrame, texts: DataFrame, bits: int = 24, least: float = 0.2) -> DataFrame:
    """Versions whose text (version_id, simhash, opening) is far from the version before: `bits` bits apart, and under `least` of the
    opening vocabulary in common."""
    w = Window.partitionBy("policy_id").orderBy("effective_from", "version_id")
    rows = versions.join(texts, "version_id").select("policy_id", "version_id", "simhash", "opening", F.lag("version_id").over(w).alias("previous_id"), F.lag("simhash").over(w).alias("s0"), F.lag("opening").over(w).alias("o0"))
    apart = F.bit_count(F.col("simhash").bitwiseXOR(F.col("s0")))
    rows = rows.withColumn("bits", apart).withColumn("overlap", F.round(vocabulary_overlap(F.col("opening"), F.col("o0")), 6))
    return rows.filter((F.col("bits") >= bits) & (F.col("overlap") < least)).select("policy_id", "version_id", "previous_id", "bits", "overlap")


def classify(docs: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """Category of each document (doc_id, title, first_page, body) by its keywords: five for the title, two for each hit of the first
    page up to three, half for each of the body up to six; and how sure: the lead over the runner-up times the strength."""
    count = lambda c, w: (F.length(c) - F.length(F.replace(c, F.lit(w)))) / len(w)

    def points(words: list[str]) -> Column:
        worth = [F.when(F.contains("t", F.lit(w)), 5.0).otherwise(0.0) + 2 * F.least(F.lit(3.0), count(F.col("f"), w)) + 0.5 * F.least(F.lit(6.0), count(F.col("b"), w)) for w in map(str.lower, words)]
        return sum(worth[1:], worth[0])

    rows = docs.select("doc_id", F.lower("title").alias("t"), F.lower("first_page").alias("f"), F.lower("body").alias("b"))
    every = F.array(*[F.struct(points(words).alias("points"), F.lit(name).alias("category")) for name, words in keywords.items()])
    order = lambda x, y: F.when(x["points"] != y["points"], F.when(x["points"] > y["points"], -1).otherwise(1)).when(x["category"] < y["category"], -1).otherwise(1)
    rows = rows.select("doc_id", F.array_sort(every, order).alias("all"))
    first, second = F.get("all", 0), F.coalesce(F.get("all", 1)["points"], F.lit(0.0))
    rows = rows.select("doc_id", first["category"].alias("category"), first["points"].alias("points"), second.alias("second")).filter("points > 0")
    return rows.select("doc_id", "category", "points", F.round((F.col("points") - F.col("second")) / F.col("points") * F.least(F.lit(1.0), F.col("points") / 10), 6).alias("confidence"))


def strip_instructions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents with sentences that instruct an assistant: how many, and the text without them. Line feeds stay."""
    parts = F.split(F.col(text), r"(?<=[.!?\n])")
    bad = lambda s: F.rlike(F.lower(s), F.lit(INSTRUCTIONS))
    rows = docs.select(key, parts.alias("p")).withColumn("n_removed", F.size(F.filter("p", bad))).filter("n_removed > 0")
    return rows.select(key, "n_removed", F.array_join(F.filter("p", lambda s: ~bad(s)), "").alias("kept"))


def plan_order(versions: DataFrame) -> DataFrame:
    """Dates that realise an order of each policy's versions (newest first by `place`): real dates stay; a version with a placeholder
    keeps its own if it is before the version above, else gets the day before that; real dates that are not are conflicts."""
    start = F.struct(F.lit(None).cast("date").alias("last"), F.array().cast("array<struct<version_id:bigint,day:date,conflict:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["last"].isNull() | (x["day"] < acc["last"])
        day = F.when(fits | x["fixed"], x["day"]).otherwise(F.date_sub(acc["last"], 1))
        return F.struct(day.alias("last"), F.array_append(acc["out"], F.struct(x["version_id"].alias("version_id"), day.alias("day"), (x["fixed"] & ~fits).alias("conflict"))).alias("out"))

    rows = versions.groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("place", "version_id", F.col("effective_from").alias("day"), "fixed"))).alias("all"))
    return rows.select("policy_id", F.explode(F.aggregate("all", start, step)["out"]).alias("o")).select("policy_id", F.col("o.version_id").alias("version_id"), F.col("o.day").alias("planned_from"), F.col("o.conflict").alias("conflict"))


def reorder(versions: DataFrame, day: Column) -> DataFrame:
    """Policies whose version in force on a day changes if their versions take the dates of `plan_order`."""
    planned = plan_order(versions)
    moved = versions.join(planned, ["policy_id", "version_id"]).withColumn("effective_from", F.col("planned_from"))
    live = lambda df, name: build_timeline(df).filter(effective_on(day)).select("policy_id", F.col("version_id").alias(name))
    met = live(versions, "before").join(live(moved, "after"), "policy_id", "full")
    return met.filter(~F.col("before").eqNullSafe(F.col("after")))


def move_versions(versions: DataFrame, moves: DataFrame) -> DataFrame:
    """Active versions after those of `moves` (version_id, to_policy_id) went to other policies: both timelines are built anew, and
    where a policy now has a label twice, revisions count from 1 by date."""
    met = versions.join(moves, "version_id", "left").withColumn("moved", F.col("to_policy_id").isNotNull()).withColumn("policy_id", F.coalesce("to_policy_id", "policy_id"))
    out = build_timeline(met.drop("to_policy_id"))
    label = met.select("version_id", "version_label", "moved")
    met = out.select("policy_id", "version_id", "effective_from", "effective_to", "version_number").join(label, "version_id")
    revision = F.row_number().over(Window.partitionBy("policy_id", "version_label").orderBy("effective_from", "version_id")).cast("int")
    return met.withColumn("revision", revision)


def rule_history(rules: DataFrame) -> DataFrame:
    """Each rule (policy_id, version_id, effective_from, number, content) with the same rule in the version before it that has one: by
    its number; and whether the wording or only the figures differ."""
    w = Window.partitionBy("policy_id", "number").orderBy("effective_from", "version_id")
    rows = rules.select("policy_id", "version_id", "number", "content", F.lag("version_id").over(w).alias("earlier_id"), F.lag("content").over(w).alias("earlier")).filter("earlier_id is not null")
    words = lambda c: F.regexp_replace(F.lower(c), r"\d+", "#")
    change = F.when(F.col("content") == F.col("earlier"), "same").when(words("content") == words("earlier"), "figures").otherwise("wording")
    return rows.select("policy_id", "version_id", "number", "earlier_id", change.alias("change"))


def ambiguous_rules(rules: DataFrame, least: int = 3) -> DataFrame:
    """Rules that one version states in `least` variants or more with as many different figures: same words, other numbers."""
    words = F.regexp_replace(F.lower("content"), r"\d+(?:[.,]\d+)*", "#")
    rows = rules.select("version_id", "number", F.md5(words).alias("rule"), F.array_join(F.regexp_extract_all("content", F.lit(r"(\d+(?:[.,]\d+)*)")), " ").alias("figures"))
    found = rows.groupBy("version_id", "rule").agg(F.count("*").alias("variants"), F.count_distinct("figures").alias("figures"), F.min("number").alias("first_number"))
    return found.filter((F.col("variants") >= least) & (F.col("figures") >= least)).drop("rule")


def version_warnings(versions: DataFrame, searchable: DataFrame, day: Column) -> DataFrame:
    """What to warn of: a version in force that can't be searched, or one that can be but is not in force (`searchable`: version_id)."""
    can = searchable.select("version_id").distinct().withColumn("can", F.lit(True))
    rows = build_timeline(versions).withColumn("live", effective_on(day)).join(can, "version_id", "left")
    warning = F.when(F.col("live") & F.col("can").isNull(), "not_searchable").when(~F.col("live") & F.col("can"), "not_in_force")
    return rows.select("policy_id", "version_id", warning.alias("warning")).filter("warning is not null")
