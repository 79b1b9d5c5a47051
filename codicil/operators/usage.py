"""Operational aggregates: counts, usage and cost, series, newest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def version_counts(versions: DataFrame) -> DataFrame:
    """Active versions of each policy."""
    return versions.filter("status = 'active'").groupBy("policy_id").agg(F.count("*").alias("n_versions"))


def category_summary(policies: DataFrame, versions: DataFrame) -> DataFrame:
    """Policies, versions and latest date of each category. Versions are summed by policy before the join."""
    per = versions.groupBy("policy_id").agg(F.count("*").alias("n"), F.max("effective_from").alias("latest"))
    met = policies.join(per, "policy_id", "left")
    return met.groupBy("category").agg(F.countDistinct("policy_id").alias("n_policies"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_versions"), F.max("latest").alias("latest"))


def message_counts(messages: DataFrame, thread: str = "conv_id") -> DataFrame:
    """Messages of each thread, those of its user, and the last turn."""
    return messages.groupBy(thread).agg(F.count("*").alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"), F.max("turn").alias("last_turn"))


def usage_daily(calls: DataFrame) -> DataFrame:
    """Calls and tokens by UTC day, service and model; failed calls do not count."""
    kept = calls.filter(~F.col("failed")).withColumn("day", F.to_date("created_at"))
    return kept.groupBy("day", "service", "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))


def usage_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of each model in millionths of tokens, priced by the longest prefix of its name; null where none fits."""
    per = calls.filter(~F.col("failed")).groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    # names of models are few; each meets its own prefixes by an equi-join
    prefixes = per.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length("model")), lambda i: F.substring(F.col("model"), F.lit(1), i))).alias("prefix"))
    met = prefixes.join(prices, "prefix").groupBy("model").agg(F.max_by(F.struct("input_price", "output_price"), F.length("prefix")).alias("p"))
    cost = (F.col("input_tokens") * F.col("p.input_price") + F.col("output_tokens") * F.col("p.output_price")) / 1_000_000
    return per.join(met, "model", "left").select("model", "input_tokens", "output_tokens", cost.alias("cost"))


def usage_totals(calls: DataFrame, today: str, since: str) -> DataFrame:
    """Input tokens of each service on a day, since a day, and in all."""
    day = F.to_date("created_at")
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("input_tokens"))), F.lit(0))
    kept = calls.filter(~F.col("failed"))
    return kept.groupBy("service").agg(some(day == F.lit(today).cast("date")).alias("today"), some(day >= F.lit(since).cast("date")).alias("since"), F.sum("input_tokens").alias("total"))


def usage_series(calls: DataFrame, last: str, days: int) -> DataFrame:
    """Calls and tokens of each of the `days` days up to `last`; days without calls have zeros."""
    end = F.lit(last).cast("date")
    calendar = calls.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days - 1), end)).alias("day"))
    per = calls.filter(~F.col("failed")).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    return calendar.join(per, "day", "left").select("day", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def out_of_credit(calls: DataFrame, key: str) -> DataFrame:
    """Whether the latest refusal of each key is later than its latest success."""
    last = lambda cond: F.max(F.when(cond, F.col("created_at")))
    met = calls.groupBy(key).agg(last(F.col("failed")).alias("last_refusal"), last(~F.col("failed")).alias("last_success"))
    return met.withColumn("out_of_credit", F.coalesce(F.col("last_refusal") > F.col("last_success"), F.col("last_refusal").isNotNull()))


def audit_list(events: DataFrame, service: str | None = None, user_id: int | None = None, since: str | None = None) -> DataFrame:
    """Events that fit all given conditions."""
    if service is not None:
        events = events.filter(F.col("service") == service)
    if user_id is not None:
        events = events.filter(F.col("user_id") == user_id)
    return events.filter(F.col("created_at") >= F.lit(since).cast("timestamp")) if since else events


def newest(rows: DataFrame, by: str, at: str, tie: str, n: int) -> DataFrame:
    """The `n` newest rows of each key."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie)))).filter(F.col("_k") <= n).drop("_k")
