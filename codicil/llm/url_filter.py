"""URL filters: host-suffix and path-prefix expressions met with a rule table by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.llm.common import lookup

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add `host` and `path`. Null urls and urls without ``://`` get two empty strings."""
    rest = F.when(F.instr(F.col("url_"), "://") > 0, F.expr("substring(url_, instr(url_, '://') + 3)"))
    pattern = r"^([^/?#]*)([^?#]*)"
    out = df.withColumn("url_", F.col(url)).withColumn("rest_", rest)
    return out.select(
        *df.columns,
        F.coalesce(F.translate(F.regexp_extract("rest_", pattern, 1), UPPER, LOWER), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract("rest_", pattern, 2), F.lit("")).alias("path"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """Judge every row of `pages` by `rules` (host, path, verdict).

    A rule fits its host and all subdomains when the url's path starts with the rule's path. The longest rule
    (characters of host and path) wins; at equal length the longer host, then ``block``. Every url is expanded into its
    host suffixes (cut at dots) and path prefixes, only in the label counts and path lengths that rules have, so any
    rule path works, not just those ending in a slash. Expressions meet rules in an equi-join on `prefix_hex` hex digits
    of SHA-256; full digests then confirm. Spark broadcasts the rules only while they are below its own size threshold.

    Returns the columns of `pages` and host, path, rule (host and path of the winner, else null), verdict. Nulls, urls
    without ``://`` and empty texts get empty parts and the default; repeated rows are judged and kept one by one; an
    empty rule table gives the default to all; a rule without a host fits no url. Columns of `pages` named like an output are dropped.
    """
    outputs = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in outputs]
    pages = pages.select(F.struct(*kept).alias("row_"), F.col(url).alias("url_"))
    rules = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).filter("r_host <> ''")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block is after allow
    rules = rules.withColumn("digest", F.sha2(F.concat_ws(" ", "r_host", "r_path"), 256)).withColumn("short", F.substring("digest", 1, prefix_hex))
    # the shapes rules have: at most as many as the longest host has labels, and the longest path characters
    shapes = rules.agg(F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.length("r_path")).alias("lengths"))
    parted = split_url(pages, "url_").withColumn("spot_", F.concat("host", "path"))  # hosts hold no slash, so this is one to one
    counts = parted.filter("host <> ''").groupBy("spot_", "host", "path").agg(F.count("*").alias("n_"))
    keyed = counts.crossJoin(F.broadcast(shapes))
    parts = F.split("host", r"\.")
    hosts = F.transform(
        F.filter("labels", lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")
    )
    paths = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    spelled = keyed.select("spot_", "n_", F.explode(hosts).alias("h"), paths.alias("paths")).select("spot_", "n_", "h", F.explode("paths").alias("p"))
    spelled = spelled.withColumn("full", F.sha2(F.concat_ws(" ", "h", "p"), 256)).withColumn("short", F.substring("full", 1, prefix_hex))
    met = spelled.join(rules, "short").filter("full = digest and h = r_host and p = r_path")
    order = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), F.col("r_verdict").alias("v"), F.concat("r_host", "r_path").alias("rule"))
    best = met.groupBy("spot_").agg(F.max(order).alias("best"), F.max("n_").alias("n_"))
    return lookup(parted, best, "spot_", "n_", pages.count()).select(
        "row_.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict")
    )
