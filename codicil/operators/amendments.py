"""Amending documents: whom they change, which passages they touch on a day, and what conflicts follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.text import title_key
from codicil.operators.hybrid import Corpus, cosine, first, part
from codicil.operators.retrieval import RANK_OFFSET, match_candidates
from codicil.operators.scope import USER, in_scope, principals_for
from codicil.operators.timeline import effective_on
from codicil.sources.scratch import stored
from codicil.sources.tables import spread

# Relations that change a text, and how many count.
AMENDING = ("AMENDS", "REPLACES", "SUPERSEDES", "CLARIFIES")
MOST_DOCUMENTS, MOST_CONFLICTS, LEAST_ALIKE = 4, 10, 0.45


def above(number: Column) -> Column:
    """A clause number and those above it: 5.2.1, 5.2 and 5; and the empty one, which stands for the whole policy."""
    steps = F.split(F.coalesce(number.cast("string"), F.lit("")), r"\.")
    return F.array_distinct(F.array_append(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), ".")), F.lit("")))


def confirmed(relations: DataFrame) -> DataFrame:
    """Relations (source_document_id, policy_id, relation_type, status, ready) that amend a policy."""
    return relations.filter("status = 'confirmed' and ready").filter(F.col("relation_type").isin(*AMENDING))


def attach_amendments(items: DataFrame, relations: DataFrame, principals: DataFrame | None = None, assignments: DataFrame | None = None) -> DataFrame:
    """Passages (query_id, item_id, policy_id, number, as_of) with each confirmed relation that amends them.

    A relation (source_document_id, title, policy_id, relation_type, status, ready, clauses, effective_from) touches the passages
    of its policy whose number is one of its clauses or below it, or all if it names none; from its effective date on (a null
    `as_of` takes any). Passages meet relations by policy and clause, their numbers being expanded to those above. With principals,
    items have a user_id, relations the scope of their document (organization_id, branch_id, own_policy_id), and only documents
    that the user may see count; users meet relations by their organisation and by the policies assigned to them as well. Returns query_id, item_id, source_document_id, title, relation_type, effective_from.
    """
    scope = ["organization_id", "branch_id", "own_policy_id"] if principals is not None else []
    clause = F.explode(F.when(F.size(F.coalesce("clauses", F.array().cast("array<string>"))) == 0, F.array(F.lit(""))).otherwise(F.array_distinct("clauses"))).alias("clause")
    rows = confirmed(relations).select("policy_id", "source_document_id", "title", "relation_type", "effective_from", *scope, clause)
    more = ["user_id"] if principals is not None else []
    asked = items.select("query_id", "item_id", "policy_id", "as_of", *more, F.explode(above(F.col("number"))).alias("clause"))
    dated, keys = F.col("as_of").isNull() | (F.col("effective_from") <= F.col("as_of")), ["policy_id", "clause"]
    if principals is None:
        met = spread(asked).join(rows, keys).filter(dated)
    else:
        asked = asked.join(principals_for(principals), "user_id").withColumn("organization_id", F.col("p_organization_id"))
        wide = spread(asked.filter(F.col("p_role") != USER)).join(rows, [*keys, "organization_id"])
        mine = assignments.select("user_id", F.col("policy_id").alias("own_policy_id")).distinct()
        own = spread(asked.filter(F.col("p_role") == USER)).join(spread(mine), "user_id").join(spread(rows), [*keys, "organization_id", "own_policy_id"])
        met = wide.select(*own.columns).unionByName(own).filter(dated & in_scope())
    return met.select("query_id", "item_id", "source_document_id", "title", "relation_type", "effective_from").distinct()


def amendment_candidates(c: Corpus, chosen: DataFrame, relations: DataFrame, today: Column) -> DataFrame:
    """The best chunk of each amending document that a question's chosen chunks (query_id, document_id, policy_id) call for.

    At most `MOST_DOCUMENTS` documents that amend a chosen policy and are not among those chosen, smallest ids first. Only their
    chunks meet the question; words and vectors rank them apart, and reciprocal ranks are summed.
    """
    wanted = chosen.select("query_id", "policy_id").distinct().join(confirmed(relations).select("policy_id", F.col("source_document_id").alias("document_id")), "policy_id").select("query_id", "document_id").distinct()
    wanted = first(wanted.join(chosen.select("query_id", "document_id").distinct(), ["query_id", "document_id"], "left_anti"), ["query_id"], ["document_id"], MOST_DOCUMENTS, "k").drop("k")
    wanted = stored(wanted, "wanted")  # few rows: chunks with their vectors are not shuffled to meet them
    near = c.allowed(wanted.join(c.chunks.select("chunk_id", "document_id", "vector"), "document_id").select("query_id", "chunk_id", "vector"))
    words = c.posts.join(c.terms, "term").groupBy("query_id", "chunk_id").agg(F.sum(part(F.col("weight"))).cast("double").alias("words"))
    rows = near.join(words, ["query_id", "chunk_id"], "left").join(c.plans.select("query_id", F.col("vector").alias("asked")), "query_id").withColumn("alike", cosine("asked", "vector"))
    place = lambda by: F.when(F.col(by).isNotNull(), 1 / (RANK_OFFSET + F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(by), "chunk_id")))).otherwise(0.0)
    scored = rows.withColumn("fused", F.round(place("words") + place("alike"), 7))
    return first(scored, ["query_id", "document_id"], [F.desc("fused"), "chunk_id"], 1, "k").select("query_id", "chunk_id", "document_id", "policy_id", "fused")


def amended_conflicts(items: DataFrame, attached: DataFrame) -> DataFrame:
    """Passages that an amending document changes, with that document's own passage among the question's, where there is one.

    One row for each set of passages, the first of the passages' order (`place` of items: query_id, item_id, place, document_id,
    policy_name, number); at most `MOST_CONFLICTS` for a question.
    """
    last = items.groupBy("query_id", F.col("document_id").alias("source_document_id")).agg(F.max_by("item_id", "place").alias("amending_id"))
    rows = attached.join(items.select("query_id", "item_id", "place", "policy_name", "number"), ["query_id", "item_id"]).join(last, ["query_id", "source_document_id"], "left")
    order = ["place", "effective_from", "source_document_id", "relation_type"]
    pair = [F.least("item_id", "amending_id"), F.greatest("item_id", "amending_id")]
    rows = first(rows, ["query_id", *pair], order, 1, "k")
    said = F.regexp_replace(F.concat("policy_name", F.lit(" section "), F.coalesce("number", F.lit("")), F.lit(" is "), F.lower("relation_type"), F.lit(" by '"), "title", F.lit("' (effective "), F.date_format("effective_from", "yyyy-MM-dd"), F.lit(").")), "  +", " ")
    return first(rows, ["query_id"], order, MOST_CONFLICTS, "n").select("query_id", "n", "item_id", "amending_id", said.alias("description"))


def amendment_targets(refs: DataFrame, policies: DataFrame, versions: DataFrame, today: Column) -> DataFrame:
    """The policy that each reference (ref_id, target, effective_date) means, and its version in force on the document's date.

    A policy (policy_id, number, name) of the reference's number, or the one whose title key is most alike (trigrams, 0.45 at
    least); of equals the smallest policy_id. Titles meet by shared rare trigrams, so no reference is compared with all policies.
    """
    key = lambda c: title_key(F.col(c))
    titles = refs.select("ref_id", "effective_date", F.upper(F.trim("target")).alias("number"), key("target").alias("title")).filter("title <> ''")
    names = policies.select("policy_id", F.upper("number").alias("number"), key("name").alias("title"))
    alike = match_candidates(titles.select(F.col("ref_id").alias("left_id"), "title"), names.select(F.col("policy_id").alias("right_id"), "title"), LEAST_ALIKE)
    # matches are of the smallest id of each title: they hold for all with that title
    same = lambda df, key, side: df.groupBy("title").agg(F.min(key).alias(side))
    first_ref, first_policy = same(titles, "ref_id", "left_id"), same(names, "policy_id", "right_id")
    by_title = titles.join(first_ref, "title").join(alike, "left_id").select("ref_id", F.col("right_id").alias("policy_id"), "similarity")
    exact = titles.join(names.select("number", "policy_id", F.col("title").alias("other")), "number").join(first_ref.withColumnRenamed("left_id", "l"), "title").join(first_policy.withColumnRenamed("right_id", "r").withColumnRenamed("title", "other"), "other")
    exact = exact.join(alike.select(F.col("left_id").alias("l"), F.col("right_id").alias("r"), "similarity"), ["l", "r"], "left").select("ref_id", "policy_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    best = first(by_title.unionByName(exact), ["ref_id"], [F.desc("similarity"), "policy_id"], 1, "k").drop("k")
    day = F.coalesce("effective_date", today)
    dated = best.join(titles.select("ref_id", day.alias("day")), "ref_id")
    live = dated.join(versions.filter("status = 'active'").select("policy_id", "version_id", "effective_from", "effective_to"), "policy_id").filter(effective_on(F.col("day"))).select("ref_id", "version_id")
    return best.join(live, "ref_id", "left").select("ref_id", "policy_id", "version_id", F.round("similarity", 2).alias("confidence"))
