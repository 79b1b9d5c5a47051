"""Mixing sources to target weights: budgets flow down a domain-language-source tree, leaves give seeded token prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.llm.common import stored

LEVELS = ("domain", "language", "origin")

#: Relative weights of the documents' tree by level and name; names that are not listed weigh 10.
DOCUMENT_WEIGHTS = {
    "domain": {"web": 50, "books": 25, "code": 15, "reference": 10},
    "language": {"en": 60, "fr": 15, "de": 15, "es": 10},
    "origin": {},
}
OTHER_WEIGHT = 10


def document_tree() -> dict[str, Column]:
    """Tree of the `documents` table: the domain follows from the source's number, then language, then source."""
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) as int)")
    domain = (
        F.when(F.pmod(number, F.lit(4)) == 0, "web").when(F.pmod(number, F.lit(4)) == 1, "books").when(F.pmod(number, F.lit(4)) == 2, "code").otherwise("reference")
    )
    return {"domain": domain, "language": F.coalesce(F.col("lang"), F.lit("")), "origin": F.coalesce(F.col("source"), F.lit(""))}


def word_count(text: Column) -> Column:
    """Tokens of a text, by default its words: runs without space, tab, line feed or the like."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def share_out(parents: DataFrame, children: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Divide each parent's `budget` among its children by `weight`, none above its `capacity`.

    What full children cannot take goes to their siblings by weight; since a parent's capacity is the sum over its
    children and its own budget was cut at it one level up, a shortage reaches an ancestor's siblings only once all
    siblings are full. A child with the k-th smallest capacity/weight is full when filling all to that level costs no
    more than the budget. Whole tokens: shares are differences of rounded-down running shares, so they sum to the budget.
    Children: one row for each node, so the windows hold a node's children, never rows of documents.
    """
    joined = children.join(parents, keys) if keys else children.crossJoin(F.broadcast(parents))
    by = [F.col(k) for k in keys]
    ratio = F.col("capacity").cast("double") / F.col("weight").cast("double")
    low = Window.partitionBy(*by).orderBy("ratio", name)
    before = low.rowsBetween(Window.unboundedPreceding, -1)
    after = low.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = joined.withColumn("ratio", ratio)
    out = out.withColumn("taken", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("left_weight", F.sum("weight").over(after))
    # full if capacity * left_weight <= (budget - taken) * weight
    full = F.col("capacity").cast("decimal(19,0)") * F.col("left_weight").cast("decimal(19,0)") <= (F.col("budget") - F.col("taken")).cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)")
    out = out.withColumn("full", full)
    group = Window.partitionBy(*by)
    out = out.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0)))
    out = out.withColumn("rest_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(group))
    run = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(Window.partitionBy(*by).orderBy(name)), F.lit(0))
    out = out.withColumn("run", run)
    upto = lambda w: F.expr(f"cast(rest as decimal(19,0)) * cast({w} as decimal(19,0)) div cast(rest_weight as decimal(19,0))")
    got = F.when(F.col("full"), F.col("capacity")).otherwise(upto("run") - upto("(run - weight)"))
    return out.select(*keys, name, got.cast("long").alias("budget"))


def mix(
    docs: DataFrame, tree: dict[str, Column], weights: dict[str, dict[str, int]], percent: int, max_epochs: int, seed: int, tokens: Column | None = None
) -> DataFrame:
    """Choose documents so that tokens follow the tree's weights.

    The total budget is `percent` hundredths of all tokens. A leaf can give `max_epochs` times its tokens. Its budget is
    filled by whole epochs, then by a prefix of one more epoch, in an order seeded by (`seed`, epoch, doc_id); the last
    document may give a part of its tokens. Returns domain, language, origin, doc_id, epoch (from 0), n_tokens and
    take_tokens, one row per chosen document and epoch.

    Windows run over nodes of the tree and over about sqrt(rows) ranges of a leaf's shuffled order; documents are ranked
    only inside the one range where a leaf's prefix ends, so a leaf with a third of all rows is no hot spot.
    Null names count as ''; documents without tokens are never chosen; repeated rows count and are chosen as rows of
    their own, those that share a doc_id in the order of their tokens; texts of any length count whole; zero weights get nothing; an empty table gives no rows.
    """
    n_tokens = word_count(F.col("text")) if tokens is None else tokens
    rows = stored(docs.select(*[c.alias(k) for k, c in tree.items()], "doc_id", n_tokens.alias("n_tokens")).filter("n_tokens > 0"), "mix")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows"))
    weigh = lambda level: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in (weights[level] or {"": OTHER_WEIGHT}).items() for x in kv]), F.col(level)), F.lit(OTHER_WEIGHT)).cast("long")
    leaves = stored(leaves, "leaves")
    node = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    total = leaves.agg((F.expr(f"coalesce(sum(tokens), 0) * {percent} div 100")).alias("want"), F.coalesce(F.sum(F.col("tokens") * max_epochs), F.lit(0)).alias("most"))
    budgets = total.select(F.least("want", "most").alias("budget"))
    keys: list[str] = []
    for level in LEVELS:
        children = node.groupBy(*keys, level).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weigh(level)).filter("weight > 0")
        budgets = share_out(budgets, children, keys, level)
        keys.append(level)
    plan = leaves.join(budgets, list(LEVELS)).select(
        *LEVELS, "tokens", "n_rows", F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest"), F.ceil(F.sqrt("n_rows")).cast("long").alias("ranges")
    )
    plan = stored(plan, "plan")
    met = rows.join(plan, list(LEVELS))
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("doc_id").cast("string"))), 1, 12), 16, 10).cast("long")
    met = met.withColumn("place", place).withColumn("range", F.expr("cast(place as decimal(15,0)) * cast(ranges as decimal(19,0)) div cast(281474976710656 as decimal(15,0))"))
    # the order of a leaf's last epoch is that of md5(seed:epoch:doc_id), cut into ranges of about sqrt(rows) documents
    every = met.filter("whole > 0").select(*LEVELS, "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"))
    sums = met.filter("rest > 0").groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("range_tokens"))
    upto = F.sum("range_tokens").over(Window.partitionBy(*LEVELS).orderBy("range"))
    sums = sums.withColumn("start", upto - F.col("range_tokens"))
    ends = sums.join(plan.select(*LEVELS, "rest"), list(LEVELS)).filter("start < rest")
    part = met.filter("rest > 0").drop("rest").join(ends, [*LEVELS, "range"])
    inside = part.filter("start + range_tokens <= rest").select(*LEVELS, "doc_id", F.col("whole").alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"))
    edge = part.filter("start + range_tokens > rest")
    end = F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "range").orderBy("place", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("from", F.col("start") + end - F.col("n_tokens")).filter("from < rest")
    edge = edge.select(*LEVELS, "doc_id", F.col("whole").alias("epoch"), "n_tokens", F.least(F.col("n_tokens"), F.col("rest") - F.col("from")).alias("take_tokens"))
    return every.unionByName(inside).unionByName(edge)
