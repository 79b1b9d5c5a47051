"""Derived tables over the driver tables, as DataFrames and as SQL: fixed rules that both engines repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codicil.operators.structure import with_body
from codicil.sources.tables import load


class Views:
    """Derived tables of one directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.directory, name)

    def registrations(self) -> DataFrame:
        source = F.element_at(F.array(*[F.lit(x) for x in ("entered", "detected", "upload_date", "inferred")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
        return self.table("orders").select(
            F.col("o_custkey").alias("policy_id"), F.col("o_orderkey").alias("version_id"), F.to_date("o_orderdate").alias("registered_on"), source.alias("date_source"),
            F.when(F.col("o_orderkey") % 7 == 0, "withdrawn").otherwise("active").alias("status"),
        )

    def versions(self) -> DataFrame:
        """Registrations, one for each policy and day (that with the smallest key), with a label."""
        one = self.registrations().groupBy("policy_id", "registered_on").agg(F.min(F.struct("version_id", "date_source", "status")).alias("v"))
        return one.select(
            "policy_id", F.col("v.version_id").alias("version_id"), F.col("registered_on").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"),
            F.col("v.date_source").alias("date_source"), F.col("v.status").alias("status"), F.concat(F.lit("v"), F.col("v.version_id") % 5 + 1).alias("version_label"),
        )

    def policies(self) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("organization_id"))
        return self.table("customer").join(nation, "c_nationkey").select(
            F.col("c_custkey").alias("policy_id"), "organization_id", F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey")).alias("branch_id"),
            F.col("c_mktsegment").alias("category"), F.col("c_name").alias("name"),
        )

    def principals(self) -> DataFrame:
        nation = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("organization_id"))
        role = F.when(F.col("c_custkey") % 3 == 0, "manager").when(F.col("c_custkey") % 60 == 1, "admin").otherwise("user")
        return self.table("customer").join(nation, "c_nationkey").select(
            F.col("c_custkey").alias("user_id"), "organization_id", F.col("c_nationkey").alias("branch_id"), role.alias("role"), F.col("c_name").alias("name")
        )

    def assignments(self) -> DataFrame:
        """Every user has the policies 1, 26, 51, ... 226 numbers on."""
        steps = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")
        return self.table("customer").select(F.col("c_custkey").alias("user_id"), steps).select("user_id", (F.col("user_id") + F.col("k") * 25 + 1).alias("policy_id"))

    def usage(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("service"), F.concat(F.lit("model-"), F.col("user_id") % 4).alias("model"), "user_id",
            F.floor("value").cast("long").alias("input_tokens"), F.floor(F.col("value") / 2).cast("long").alias("output_tokens"), (F.col("event_type") == "error").alias("failed"),
        )

    def sections(self) -> DataFrame:
        """Sections of a version: one for each order line number, with rendered sentences."""
        p = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
        text = F.concat(
            F.lit("The rate shall not exceed "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%. The amount is Rs. "), F.floor("l_extendedprice").cast("long").cast("string"),
            F.lit(". The term is "), F.col("l_quantity").cast("int").cast("string"), F.lit(" months. It starts on "), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("."),
        )
        # one shuffle by version, of figures instead of sentences: what follows by version needs neither a shuffle nor a sort
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").cast("int").alias("number"), "l_partkey", "l_discount", "l_extendedprice", "l_quantity", "l_shipdate")
        rows = lines.join(p, "l_partkey").repartition("version_id").select("version_id", "number", "l_partkey", "title", text.alias("content"))
        first = F.row_number().over(Window.partitionBy("version_id", "number").orderBy("l_partkey", "content", "title"))
        return rows.withColumn("k", first).filter("k = 1").select("version_id", "number", "title", "content")

    def uploads(self) -> DataFrame:
        """Uploaded files: one for each order."""
        key, status = F.col("o_orderkey"), pick(F.col("o_orderkey"), "ready", "processing", "failed", "rejected", "archived", "awaiting_review", "ready")
        code = pick(F.floor(F.col("o_orderkey") / 7), "provider_down", "bad_file", "quota")
        return self.table("orders").select(
            key.alias("document_id"), F.when(key % 9 != 0, F.col("o_custkey")).alias("policy_id"), key.alias("version_id"), pick(F.col("o_custkey"), "audit", "credit", "people").alias("category"),
            (F.col("o_custkey") % 25).alias("branch_id"), F.col("o_custkey").alias("uploader_id"), status.alias("status"), F.concat(F.lit("Policy_"), key, F.lit(".pdf")).alias("file_name"),
            F.to_date("o_orderdate").alias("uploaded_on"), F.when(status == "failed", F.concat(F.lit('{"code": "'), code, F.lit('"}'))).alias("error"), (key % 4 + 3).cast("int").alias("page_count"),
            (F.col("o_custkey") % 200).alias("batch_id"),
        )

    def decisions(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(key.alias("document_id"), pick(key, "new_policy", "new_version", "duplicate", "conflict", "review").alias("decision"), (F.col("o_custkey") + key % 2).alias("policy_id"))

    def stages(self) -> DataFrame:
        """Stages of an upload's processing: one for each order line."""
        names = ("extraction", "structure", "chunking", "embedding", "indexing", "validation", "finish")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("document_id"), pick(F.col("l_linenumber"), *names).alias("stage"), pick(F.col("l_partkey"), "done", "running", "failed", "waiting").alias("state"),
            F.when(F.col("l_quantity") >= 10, F.col("l_quantity").cast("int")).alias("total"), F.floor(F.col("l_quantity") / 2).cast("int").alias("done"),
        )

    def samples(self) -> DataFrame:
        """Samples of a running stage: done of 100,000 units at seconds of the day, one row for each event."""
        seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
        return self.table("events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("stage"), (F.col("event_id") * 86400 + seconds).alias("sampled_at"), (F.col("event_id") % 977).cast("int").alias("done"), F.lit(1000).alias("total"))

    def chunks(self) -> DataFrame:
        """One chunk for each section of a version."""
        key = F.col("version_id") * 10 + F.col("number")
        return self.sections().select(
            key.alias("chunk_id"), F.col("version_id").alias("document_id"), "version_id", "number", "title", "content", (F.col("number") - F.when(F.col("version_id") % 50 == 0, 1).otherwise(0)).alias("page_start"),
            (F.col("number") + F.when(F.col("version_id") % 11 == 0, 1).otherwise(0)).alias("page_end"), F.when(key % 5 == 1, "m1").when(key % 5 != 0, "m2").alias("model"), F.md5("content").alias("chunk_hash"),
            pick(key, "text", "ocr", "table").alias("method"),
        )

    def tickets(self) -> DataFrame:
        key = F.col("event_id")
        return self.table("events").select(
            key.alias("ticket_id"), F.col("user_id").alias("author_id"), (F.col("user_id") % 5).alias("organization_id"), pick(key, "help", "data", "audit").alias("queue"), F.col("event_type").alias("kind"),
            pick(F.floor(key / 3), "open", "in_progress", "closed").alias("status"), F.col("ts").alias("created_at"),
        )

    def notices(self) -> DataFrame:
        return self.table("events").select(F.col("event_id").alias("notice_id"), "user_id", F.col("ts").alias("created_at"), (F.col("event_id") % 4 == 0).alias("is_read"), F.col("event_type").alias("kind"))

    def laid_pages(self) -> DataFrame:
        """Pages of a laid-out manual for each version, one for each section, with their lines in order; a header and a footer run."""
        n = F.col("number").cast("string")
        head = (
            F.when(F.col("version_id") % 5 == 0, F.concat(F.lit("Chapter "), n, F.lit(": "), F.col("title"))).when(F.col("number") % 2 == 0, F.concat(n, F.lit(".1 "), F.col("title")))
            .when(F.col("number") % 3 == 0, F.col("title")).otherwise(F.concat(n, F.lit(". "), F.col("title")))
        )
        line = lambda text, size, bold: F.struct(text.alias("text"), F.lit(size).alias("size"), F.lit(bold).alias("bold"))
        body = F.transform(F.split("content", r"\. "), lambda s: line(s, 10.0, False))
        every = F.concat(F.array(line(F.concat(F.lit("Manual of rules - page "), n), 9.0, False), line(head, 14.0, True)), body, F.array(line(F.concat(F.lit("Page "), n, F.lit(" of "), F.col("pages").cast("string")), 9.0, False)))
        return self.sections().withColumn("pages", F.count("*").over(Window.partitionBy("version_id"))).select(F.col("version_id").alias("doc_id"), F.col("number").alias("page"), every.alias("lines"))

    def lines(self, body: bool = False) -> DataFrame:
        """Lines of the laid-out manuals; where asked for, with the size of their document's body."""
        pages = with_body(self.laid_pages()) if body else self.laid_pages()
        more = ["body"] if body else []
        rows = pages.select("doc_id", "page", *more, F.posexplode("lines").alias("line_no", "line"))
        return rows.select("doc_id", "page", "line_no", F.floor(F.col("line_no") / 3).cast("int").alias("block"), "line.text", "line.size", "line.bold", *more)


def pick(number: Column, *names: str) -> Column:
    """The name at a number's remainder."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (number % len(names) + 1).cast("int"))


SQL = """
registrations as (
  select o_custkey as policy_id, o_orderkey as version_id, cast(o_orderdate as date) as registered_on,
    ['entered', 'detected', 'upload_date', 'inferred'][o_orderkey % 4 + 1] as date_source,
    case when o_orderkey % 7 = 0 then 'withdrawn' else 'active' end as status from orders),
versions as (
  select policy_id, version_id, registered_on as effective_from, cast(null as date) as effective_to, date_source, status, 'v' || (version_id % 5 + 1) as version_label
  from registrations qualify row_number() over (partition by policy_id, registered_on order by version_id) = 1),
policies as (
  select c_custkey as policy_id, n_regionkey as organization_id, case when c_custkey % 5 <> 0 then c_nationkey end as branch_id, c_mktsegment as category, c_name as name
  from customer join nation on n_nationkey = c_nationkey),
principals as (
  select c_custkey as user_id, n_regionkey as organization_id, c_nationkey as branch_id,
    case when c_custkey % 3 = 0 then 'manager' when c_custkey % 60 = 1 then 'admin' else 'user' end as role, c_name as name
  from customer join nation on n_nationkey = c_nationkey),
assignments as (select c_custkey as user_id, c_custkey + k * 25 + 1 as policy_id from customer, range(10) t(k)),
timeline as (
  select policy_id, version_id, effective_from, date_source, status, lead(effective_from) over w as effective_to, cast(row_number() over w as int) as version_number,
    lag(version_id) over w as supersedes, lead(version_id) over w as superseded_by
  from versions where status = 'active' window w as (partition by policy_id order by effective_from, version_id)),
usage as (
  select event_id, ts as created_at, event_type as service, 'model-' || (user_id % 4) as model, user_id, cast(floor(value) as bigint) as input_tokens,
    cast(floor(value / 2) as bigint) as output_tokens, event_type = 'error' as failed from events),
sections as (
  select l_orderkey as version_id, cast(l_linenumber as int) as number, p_name as title,
    'The rate shall not exceed ' || cast(cast(round(l_discount * 100) as int) as varchar) || '%. The amount is Rs. ' || cast(cast(floor(l_extendedprice) as bigint) as varchar)
    || '. The term is ' || cast(cast(l_quantity as int) as varchar) || ' months. It starts on ' || strftime(l_shipdate, '%Y-%m-%d') || '.' as content
  from lineitem join part on p_partkey = l_partkey qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, content) = 1),
uploads as (
  select *, case when status = 'failed' then '{"code": "' || ['provider_down', 'bad_file', 'quota'][document_id // 7 % 3 + 1] || '"}' end as error from (
    select o_orderkey as document_id, case when o_orderkey % 9 <> 0 then o_custkey end as policy_id, o_orderkey as version_id, ['audit', 'credit', 'people'][o_custkey % 3 + 1] as category,
      o_custkey % 25 as branch_id, o_custkey as uploader_id, ['ready', 'processing', 'failed', 'rejected', 'archived', 'awaiting_review', 'ready'][o_orderkey % 7 + 1] as status,
      'Policy_' || o_orderkey || '.pdf' as file_name, cast(o_orderdate as date) as uploaded_on, cast(o_orderkey % 4 + 3 as int) as page_count, o_custkey % 200 as batch_id from orders)),
decisions as (
  select o_orderkey as document_id, ['new_policy', 'new_version', 'duplicate', 'conflict', 'review'][o_orderkey % 5 + 1] as decision, o_custkey + o_orderkey % 2 as policy_id from orders),
stages as (
  select l_orderkey as document_id, ['extraction', 'structure', 'chunking', 'embedding', 'indexing', 'validation', 'finish'][l_linenumber % 7 + 1] as stage,
    ['done', 'running', 'failed', 'waiting'][l_partkey % 4 + 1] as state, case when l_quantity >= 10 then cast(l_quantity as int) end as total, cast(floor(l_quantity / 2) as int) as done from lineitem),
samples as (
  select user_id as document_id, event_type as stage, event_id * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) as sampled_at, cast(event_id % 977 as int) as done, 1000 as total from events),
chunks as (
  select *, case when chunk_id % 5 = 1 then 'm1' when chunk_id % 5 <> 0 then 'm2' end as model, md5(content) as chunk_hash, ['text', 'ocr', 'table'][chunk_id % 3 + 1] as method from (
    select version_id * 10 + number as chunk_id, version_id as document_id, version_id, number, title, content, number - case when version_id % 50 = 0 then 1 else 0 end as page_start,
      number + case when version_id % 11 = 0 then 1 else 0 end as page_end from sections)),
tickets as (
  select event_id as ticket_id, user_id as author_id, user_id % 5 as organization_id, ['help', 'data', 'audit'][event_id % 3 + 1] as queue, event_type as kind,
    ['open', 'in_progress', 'closed'][event_id // 3 % 3 + 1] as status, ts as created_at from events),
notices as (select event_id as notice_id, user_id, ts as created_at, event_id % 4 = 0 as is_read, event_type as kind from events),
laid as (
  select version_id as doc_id, number as page, ['Manual of rules - page ' || number,
    case when version_id % 5 = 0 then 'Chapter ' || number || ': ' || title when number % 2 = 0 then number || '.1 ' || title when number % 3 = 0 then title else number || '. ' || title end]
    || string_split(content, '. ') || ['Page ' || number || ' of ' || count(*) over (partition by version_id)] as t from sections),
lines as (
  select doc_id, page, cast(i - 1 as int) as line_no, cast((i - 1) // 3 as int) as block, text, (case when i = 2 then 14.0 when i = 1 or i = n then 9.0 else 10.0 end)::double as size, i = 2 as bold from (
    select doc_id, page, unnest(t) as text, generate_subscripts(t, 1) as i, len(t) as n from laid))
"""


def with_views(query: str) -> str:
    """SQL in which the derived tables can be named."""
    return f"with {SQL.strip()}\n{query}" if not query.lstrip().startswith(",") else f"with {SQL.strip()}{query}"
