"""Queries that compare whole versions of documents, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.operators import compare, structure
from codicil.plans.alignment import aligned_sql
from codicil.plans.views import Views, with_views

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(build):
        QUERIES[name] = lambda spark, directory: build(Views(spark, directory))
        SQL[name] = with_views(sql)
        return build

    return add


def revised(v: Views) -> DataFrame:
    """Sections whose numbers are partly missing and whose titles change from version to version; some in two parts."""
    n, i = F.col("number"), F.col("version_id")
    title = (
        F.when((i % 13 == 0) & (n == 2), F.lit(None).cast("string")).when(i % 4 == 0, F.concat(F.lit("Rules on "), "title")).when(i % 4 == 1, F.split_part("title", F.lit(" "), F.lit(2)))
        .when(i % 4 == 2, F.concat(F.lit("Rules on "), "title", F.lit(" Version 2"))).otherwise(F.col("title"))
    )
    rows = v.sections().select(
        "version_id", n.alias("order_index"), F.when((i + n) % 3 == 0, n).alias("number"), F.when((n == 1) & (i % 5 == 0), 0).otherwise(1).alias("level"), title.alias("title"),
        F.when((i % 17 == 0) & (n == 3), "").otherwise(F.col("content")).alias("content"),
    )
    w, part = Window.partitionBy("version_id").orderBy("order_index"), (F.col("order_index") % 3 == 2) & (i % 7 == 0)
    return rows.select(
        "version_id", "order_index", F.when(part, F.lag("number").over(w)).otherwise(n).alias("number"), "level",
        F.when(part, F.concat(F.lag("title").over(w), F.lit(" (continued)"))).otherwise(F.col("title")).alias("title"), "content",
    )


REVISED = """
, plain as (
  select version_id, number as order_index, case when (version_id + number) % 3 = 0 then number end as number, case when number = 1 and version_id % 5 = 0 then 0 else 1 end as level,
    case when version_id % 13 = 0 and number = 2 then null when version_id % 4 = 0 then 'Rules on ' || title when version_id % 4 = 1 then split_part(title, ' ', 2)
      when version_id % 4 = 2 then 'Rules on ' || title || ' Version 2' else title end as title, case when version_id % 17 = 0 and number = 3 then '' else content end as content from sections),
revised as (
  select version_id, order_index, case when order_index % 3 = 2 and version_id % 7 = 0 then lag(number) over w else number end as number, level,
    case when order_index % 3 = 2 and version_id % 7 = 0 then lag(title) over w || ' (continued)' else title end as title, content from plain window w as (partition by version_id order by order_index)),
based as (
  select *, regexp_replace(title, ' \\(continued\\)$', '') as base from revised),
cut as (select *, case when ends_with(title, ' (continued)') and lag(title) over w = base and lag(number) over w is not distinct from number then 0 else 1 end as fresh from based window w as (partition by version_id order by order_index)),
headed as (select *, sum(fresh) over (partition by version_id order by order_index) as run0 from cut),
counted as (select *, struct_pack(a := run0, b := case when first(ends_with(title, ' (continued)')) over (partition by version_id, run0 order by order_index) then order_index end) as run from headed),
whole as (
  select version_id, min(order_index) as place, first(number order by order_index) as number, first(level order by order_index) as level, first(title order by order_index) as title,
    string_agg(content, chr(10) || chr(10) order by order_index) as content from counted group by version_id, run)"""

ALIGNED = aligned_sql(REVISED)


@query("align_sections", f"{ALIGNED} select * from aligned")
def align_sections(v: Views) -> DataFrame:
    pairs = compare.consecutive(v.versions())
    rows = structure.merge_continuations(revised(v)).withColumnRenamed("order_index", "place")
    side = lambda name: pairs.join(rows.withColumnRenamed("version_id", name), name)
    return compare.align_sections(side("old_id"), side("new_id"))


@query("version_diff", f"""{ALIGNED}
select a.old_id, a.new_id, old_place, new_place, cast(coalesce(n.number, o.number) as int) as number, "by",
  case when "by" in ('added', 'removed') then "by" when o.content is not distinct from n.content and o.title is not distinct from n.title then 'unchanged' else 'modified' end as change,
  md5(coalesce(o.content, '') || '|' || coalesce(n.content, '')) as contents
from aligned a left join whole o on o.version_id = a.old_id and o.place = old_place left join whole n on n.version_id = a.new_id and n.place = new_place""")
def version_diff(v: Views) -> DataFrame:
    rows = compare.compare_versions(revised(v), compare.consecutive(v.versions()))
    both = F.md5(F.concat(F.coalesce("old_content", F.lit("")), F.lit("|"), F.coalesce("new_content", F.lit(""))))
    return rows.select("old_id", "new_id", "old_place", "new_place", F.col("number").cast("int").alias("number"), "by", "change", both.alias("contents"))
