"""Effective-dated versions: timelines, states, as-of joins, conflicts and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sources of dates that were not stated by anyone; such versions yield their day.
PLACEHOLDERS = ("upload_date", "inferred")


def by_policy() -> Window:
    return Window.partitionBy("policy_id").orderBy("effective_from", "version_id")


def effective_on(day: Column) -> Column:
    """Half-open validity: from <= day and (no end or end > day)."""
    return (F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") > day))


def real_date(column: str = "effective_from") -> Column:
    """The date, or null where it is a placeholder."""
    return F.when(~F.col("date_source").isin(*PLACEHOLDERS), F.col(column))


def build_timeline(versions: DataFrame) -> DataFrame:
    """Active versions in order of their dates: number, end (the next one's start where open or later) and chain links."""
    w = by_policy()
    follow = F.lead("effective_from").over(w)
    end = F.col("effective_to") if "effective_to" in versions.columns else F.lit(None).cast("date")
    return versions.filter("status = 'active'").select(
        "policy_id", "version_id", "effective_from", "date_source", "status",
        F.when(end.isNull() | (end > follow), follow).otherwise(end).alias("effective_to"),
        F.row_number().over(w).cast("int").alias("version_number"),
        F.lag("version_id").over(w).alias("supersedes"), F.lead("version_id").over(w).alias("superseded_by"),
    )


def with_state(versions: DataFrame, day: Column) -> DataFrame:
    """Add `state`: withdrawn, scheduled, historical or current on a day."""
    state = (
        F.when(F.col("status") == "withdrawn", "withdrawn").when(F.col("effective_from") > day, "scheduled").when(F.col("effective_to") <= day, "historical").otherwise("current")
    )
    return versions.withColumn("state", state)


def asof_join(facts: DataFrame, versions: DataFrame, key: str, day: str) -> DataFrame:
    """Facts with the version of their policy in force on their day; facts without one keep nulls.

    Versions never overlap, so each fact meets one at most: both sides are stacked, and the last version before a fact is
    carried forward by a window, which sorts each policy once instead of comparing facts with all versions.
    """
    v = versions.filter("status = 'active'").select(F.col("policy_id").alias(key), F.col("effective_from").alias("_at"), F.struct("version_id", "effective_from", "effective_to").alias("_v"))
    left = facts.withColumn("_row", F.struct(*facts.columns)).select(key, F.col(day).alias("_at"), "_row")
    rows = v.withColumn("_row", F.lit(None).cast(left.schema["_row"].dataType)).select(key, "_at", "_v", "_row").unionByName(left.withColumn("_v", F.lit(None).cast(v.schema["_v"].dataType)))
    w = Window.partitionBy(key).orderBy("_at", F.col("_v").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_row is not null")
    fits = F.col("_v.effective_to").isNull() | (F.col("_v.effective_to") > F.col("_at"))
    return met.select("_row.*", F.when(fits, F.col("_v.version_id")).alias("version_id"), F.when(fits, F.col("_v.effective_from")).alias("effective_from"))


def previous_version(versions: DataFrame) -> DataFrame:
    """Each version with the one just before it."""
    w = by_policy()
    return versions.select("policy_id", "version_id", F.lag("version_id").over(w).alias("previous_id"), F.lag("effective_from").over(w).alias("previous_from"))


def without_successor(versions: DataFrame) -> DataFrame:
    """Versions after which no other starts."""
    latest = F.max("effective_from").over(Window.partitionBy("policy_id"))
    return versions.withColumn("_latest", latest).filter("effective_from = _latest").drop("_latest")


def timeline_conflicts(registrations: DataFrame) -> DataFrame:
    """Registrations with a real date on a day that another one with a real date has."""
    real = registrations.filter(~F.col("date_source").isin(*PLACEHOLDERS))
    n = F.count("*").over(Window.partitionBy("policy_id", "registered_on"))
    first = F.min("version_id").over(Window.partitionBy("policy_id", "registered_on"))
    return real.withColumn("n", n).filter("n > 1").select("policy_id", "version_id", "registered_on", first.alias("first_id"))


def make_room(versions: DataFrame, new: DataFrame) -> DataFrame:
    """Versions after `new` (policy_id, day) took its day: the placeholder there moves back one day, and so does every
    placeholder it then lands on. If a real date is in that unbroken run of days, the policy is a conflict and stays."""
    run = versions.join(new, "policy_id").filter("effective_from <= day")
    run = run.withColumn("_island", F.date_add("effective_from", F.row_number().over(Window.partitionBy("policy_id").orderBy(F.desc("effective_from"))).cast("int")))
    # the run that ends on the day has day + 1 as its island
    hit = run.filter(F.col("_island") == F.date_add("day", 1)).select("policy_id", "version_id", F.col("date_source").isin(*PLACEHOLDERS).alias("_yields"))
    all_yield = F.min("_yields").over(Window.partitionBy("policy_id"))
    hit = hit.withColumn("_moves", all_yield)
    met = versions.join(hit.select("policy_id", "version_id", "_moves"), ["policy_id", "version_id"], "left")
    moved = F.when(F.col("_moves"), F.date_sub("effective_from", 1)).otherwise(F.col("effective_from"))
    return met.select("policy_id", "version_id", moved.alias("effective_from"), F.coalesce("_moves", F.lit(False)).alias("moved"), F.coalesce(~F.col("_moves"), F.lit(False)).alias("conflict"))


def number_versions(versions: DataFrame) -> DataFrame:
    """Number of a version in its policy and revision of its label there, in order of registration."""
    w = Window.partitionBy("policy_id").orderBy("version_id")
    label = Window.partitionBy("policy_id", "version_label").orderBy("version_id")
    return versions.select("policy_id", "version_id", "version_label", F.row_number().over(w).cast("int").alias("number"), F.row_number().over(label).cast("int").alias("revision"))


def default_dates(docs: DataFrame) -> DataFrame:
    """Date used where none is entered: the stated effective date, else the issue date, else the day of upload."""
    day = F.coalesce("effective_date", "issue_date", F.to_date("created_at"))
    return docs.withColumn("default_date", day).withColumn("default_source", F.when(F.coalesce("effective_date", "issue_date").isNotNull(), "detected").otherwise("upload_date"))


def expiry(versions: DataFrame, day: Column, notice_days: int) -> DataFrame:
    """Last versions of a policy that end within the notice window or have ended."""
    last = versions.filter("status = 'active'").withColumn("_k", F.row_number().over(Window.partitionBy("policy_id").orderBy(F.desc("effective_from")))).filter("_k = 1")
    near = last.filter(F.col("effective_to").isNotNull() & (F.col("effective_to") <= F.date_add(day, notice_days)))
    return near.select("policy_id", "version_id", "effective_to", F.when(F.col("effective_to") <= day, "expired").otherwise("expiring").alias("kind"))


def newer_versions(items: DataFrame, versions: DataFrame, policies: DataFrame) -> DataFrame:
    """Active versions after an item's date in all records that share its policy's trimmed lower-case name and organisation."""
    name = F.lower(F.trim("name"))
    own = policies.select("policy_id", F.concat_ws("|", "organization_id", name).alias("same"))
    mine = items.join(own, "policy_id")
    theirs = versions.filter("status = 'active'").join(own, "policy_id").select("same", F.col("version_id").alias("newer_id"), F.col("effective_from").alias("newer_from"))
    return mine.join(theirs, "same").filter("newer_from > effective_from").drop("same")


def version_sets(versions: DataFrame, day: Column) -> DataFrame:
    """Superseded versions by depth (1 is the latest before the one in force), for policies with one in force."""
    active = versions.filter("status = 'active'")
    live = active.filter(effective_on(day)).select("policy_id").distinct()
    past = active.filter(F.col("effective_to") <= day).join(live, "policy_id", "left_semi")
    return past.select("policy_id", "version_id", F.row_number().over(Window.partitionBy("policy_id").orderBy(F.desc("effective_from"))).cast("int").alias("depth"))


def true_periods(items: DataFrame, newer: DataFrame) -> DataFrame:
    """Items whose period ends where the next newer registered version begins."""
    first = newer.groupBy("version_id").agg(F.min("newer_from").alias("_next"))
    met = items.join(first, "version_id", "left")
    return met.select("policy_id", "version_id", "effective_from", F.least("effective_to", "_next").alias("true_to"))


def library(policies: DataFrame, versions: DataFrame, day: Column) -> DataFrame:
    """Policies with a version in force on a day, that version, and how many have ended before it."""
    active = build_timeline(versions)
    live = active.filter(effective_on(day)).select("policy_id", "version_id")
    earlier = active.filter(F.col("effective_to") <= day).groupBy("policy_id").agg(F.count("*").alias("n_earlier"))
    met = policies.select("policy_id", "name").join(live, "policy_id").join(earlier, "policy_id", "left")
    return met.select("policy_id", "name", "version_id", F.coalesce("n_earlier", F.lit(0)).cast("long").alias("n_earlier"))
