"""Lists, boxes and progress of uploads, tickets and notices: filters, roll-ups and pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.text import contains_ci, trigram_similarity, trigrams

PLACEHOLDERS = ("upload_date", "inferred")


def list_documents(docs: DataFrame, status: str | None = None, category: str | None = None, policy_id: int | None = None, branch_id: int | None = None, search: str | None = None) -> DataFrame:
    """Uploads that every filter given allows; `search` looks into the file name."""
    for column, value in (("status", status), ("category", category), ("policy_id", policy_id), ("branch_id", branch_id)):
        if value is not None:
            docs = docs.filter(F.col(column) == value)
    return docs.filter(contains_ci(F.col("file_name"), search)) if search else docs


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """Rows `offset` + 1 to `offset` + `limit` in `order`, each with the number of all rows as `total`."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def find_policies(policies: DataFrame, term: str, least: float = 0.3) -> DataFrame:
    """Policies whose name holds the term, whose number is the term, or whose name is as similar as `least` by trigrams."""
    like = trigram_similarity(trigrams(F.col("name")), trigrams(F.lit(term)))
    met = contains_ci(F.col("name"), term) | (F.lower("policy_number") == term.lower()) | (like >= least)
    return policies.withColumn("similarity", F.round(like, 6)).filter(met)


def visible_tickets(tickets: DataFrame, people: DataFrame, queues: DataFrame) -> DataFrame:
    """Pairs of principals and tickets they may see: their own, and those in the queues of their role (role, queue) of their organisation.

    Principals meet tickets by author, and by (organisation, queue); the two are told apart, so no pair comes twice.
    """
    own = people.select("user_id").join(tickets, F.col("user_id") == F.col("author_id"))
    staff = people.join(queues, "role").select("user_id", F.col("organization_id").alias("p_organization_id"), F.col("queue").alias("p_queue"))
    queued = staff.join(tickets, (F.col("p_organization_id") == F.col("organization_id")) & (F.col("p_queue") == F.col("queue"))).filter("user_id <> author_id")
    names = ["user_id", *tickets.columns]
    return own.select(*names).unionByName(queued.select(*names))


def find_tickets(seen: DataFrame, box: str, status: str | None = None, kind: str | None = None) -> DataFrame:
    """Of visible tickets those of a box: `mine`, `queue` (of others), `open` or `all`, with a status or kind where given."""
    boxes = {"mine": F.col("author_id") == F.col("user_id"), "queue": F.col("author_id") != F.col("user_id"), "open": F.col("status").isin("open", "in_progress"), "all": F.lit(True)}
    seen = seen.filter(boxes[box])
    for column, value in (("status", status), ("kind", kind)):
        if value is not None:
            seen = seen.filter(F.col(column) == value)
    return seen


def ticket_counts(tickets: DataFrame, people: DataFrame, queues: DataFrame, box: str = "all", status: str | None = None, kind: str | None = None) -> DataFrame:
    """What `find_tickets` of `visible_tickets` holds for each principal, without the pairs: how many (n) and, but for the box `queue`,
    the first and last ticket.

    Tickets are counted by author and by (organisation, queue); of a queue's tickets a principal's own are taken off. So the work
    grows with tickets and principals, not with their pairs.
    """
    rows = tickets.filter(F.col("status").isin("open", "in_progress")) if box == "open" else tickets
    for column, value in (("status", status), ("kind", kind)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    ends = [F.min("ticket_id").alias("first_ticket"), F.max("ticket_id").alias("last_ticket")]
    place, names = ["organization_id", "queue"], ["user_id", "n", "first_ticket", "last_ticket"]
    own = people.select("user_id").join(rows.groupBy(F.col("author_id").alias("user_id")).agg(F.count("*").alias("n"), *ends), "user_id")
    authored = rows.filter("author_id is not null")
    staff = people.filter("user_id is not null").join(queues, "role").select("user_id", *place)
    mine = authored.groupBy(F.col("author_id").alias("user_id"), *place).agg(F.count("*").alias("n_own"))
    met = staff.join(authored.groupBy(*place).agg(F.count("*").alias("n_all"), *ends), place).join(mine, ["user_id", *place], "left")
    queued = met.withColumn("n", F.col("n_all") - F.coalesce("n_own", F.lit(0)))
    parts = {"mine": [own], "queue": [queued]}.get(box, [own, queued])
    told = parts[0].select(*names) if len(parts) == 1 else own.select(*names).unionByName(queued.select(*names))
    found = told.groupBy("user_id").agg(F.sum("n").alias("n"), F.min("first_ticket").alias("first_ticket"), F.max("last_ticket").alias("last_ticket")).filter("n > 0")
    return found.select("user_id", "n") if box == "queue" else found


def pending_uploads(docs: DataFrame, limit: int = 50) -> DataFrame:
    """Of each category the newest uploads that belong to no policy yet and were neither rejected nor archived."""
    k = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("uploaded_on"), "document_id"))
    return docs.filter(F.col("policy_id").isNull() & ~F.col("status").isin("rejected", "archived")).withColumn("place", k).filter(F.col("place") <= limit)


def resumable(docs: DataFrame, codes: list[str], limit: int) -> DataFrame:
    """Failed uploads whose error's JSON `code` is one of `codes`, oldest first."""
    code = F.get_json_object("error", "$.code")
    return docs.filter(F.col("status") == "failed").withColumn("code", code).filter(F.col("code").isin(codes)).orderBy("uploaded_on", "document_id").limit(limit)


def still_embedding(docs: DataFrame, stages: DataFrame) -> DataFrame:
    """Ready uploads whose embedding stage is still running or has failed."""
    late = stages.filter((F.col("stage") == "embedding") & F.col("state").isin("running", "failed"))
    return docs.filter(F.col("status") == "ready").join(late.select("document_id", "state"), "document_id")


def bad_pages(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks whose pages can't be: before page 1, ending before they start, or beyond the document."""
    met = chunks.join(docs.select("document_id", "page_count"), "document_id")
    return met.filter((F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start")) | (F.col("page_end") > F.col("page_count")))


def with_people(rows: DataFrame, people: DataFrame, roles: list[str]) -> DataFrame:
    """Add the name of the person in each role: `x_id` gives `x_name`, null where nobody or nobody known is there."""
    for role in roles:
        names = people.select(F.col("user_id").alias(f"{role}_id"), F.col("name").alias(f"{role}_name"))
        rows = rows.join(names, f"{role}_id", "left")
    return rows


def provenance(rows: DataFrame, docs: DataFrame, versions: DataFrame, policies: DataFrame) -> DataFrame:
    """What a passage comes from: its file, the version's label and real dates, the policy's name. Rows without match stay."""
    file = docs.select("document_id", "file_name", "policy_id", "version_id")
    real = F.when(F.col("date_source").isin(*PLACEHOLDERS), None).otherwise(F.col("effective_from"))
    label = versions.select("version_id", "version_label", real.alias("effective_from"))
    return rows.join(file, "document_id", "left").join(label, "version_id", "left").join(policies.select("policy_id", F.col("name").alias("policy_name")), "policy_id", "left")


def pending_decisions(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Open uploads that await a decision, by its type."""
    open_ = docs.filter(F.col("status") == "awaiting_review").select("document_id")
    return decisions.join(open_, "document_id", "left_semi").groupBy("decision").agg(F.count("*").alias("n"))


def index_check(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Of each document: its chunks, those with terms, and those with impossible pages, in one pass."""
    met = chunks.join(docs.select("document_id", "page_count"), "document_id")
    bad = (F.col("page_start") < 1) | (F.col("page_end") < F.col("page_start")) | (F.col("page_end") > F.col("page_count"))
    return met.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.trim("content") != "").alias("indexed"), F.count_if(bad).alias("bad"))


def embedding_progress(chunks: DataFrame) -> DataFrame:
    """Of each document: chunks, those with a model label, and whether that is all."""
    done = F.count("model").alias("embedded")
    return chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"), done, (F.count("model") == F.count("*")).alias("complete"))


def pages_by_method(pages: DataFrame, methods: list[str]) -> DataFrame:
    """Pages of each document by how their text was read, one column for each method."""
    counts = [F.count_if(F.col("method") == m).alias(m) for m in methods]
    return pages.groupBy("document_id").agg(*counts)


def progress(stages: DataFrame) -> DataFrame:
    """How far each document is: stages counted, stages done, and the mean fraction as whole per cents.

    A stage that says no total yet is not measured: it counts as nothing done.
    """
    part = F.when(F.col("state") == "done", 1.0).when(F.coalesce("total", F.lit(0)) > 0, F.least(F.lit(1.0), F.col("done") / F.col("total")))
    rows = stages.withColumn("fraction", part)
    percent = F.floor(100 * F.sum(F.coalesce("fraction", F.lit(0.0))) / F.count("*") + 1e-9).cast("int")
    return rows.groupBy("document_id").agg(F.count("*").alias("n_stages"), F.count_if(F.col("state") == "done").alias("n_done"), F.count_if(F.col("fraction").isNull()).alias("unmeasured"), percent.alias("percent"))


def eta(samples: DataFrame, window: int = 90) -> DataFrame:
    """Seconds left of each (document, stage): units left over the rate of the last `window` seconds of samples
    (document_id, stage, sampled_at, done, total); where these show no progress, over the rate since the first sample; else null."""
    by = Window.partitionBy("document_id", "stage")
    rows = samples.withColumn("last_at", F.max("sampled_at").over(by)).withColumn("first_at", F.min("sampled_at").over(by))
    recent = F.col("sampled_at") >= F.col("last_at") - window
    found = rows.groupBy("document_id", "stage").agg(
        F.max_by("done", "sampled_at").alias("done"), F.max_by("total", "sampled_at").alias("total"), F.min_by("done", "sampled_at").alias("done0"), F.max("last_at").alias("at1"), F.min("first_at").alias("at0"),
        F.min(F.when(recent, F.struct("sampled_at", "done"))).alias("near"),
    )
    rate = lambda done, at: F.when((F.col("done") > done) & (F.col("at1") > at), (F.col("done") - done) / (F.col("at1") - at))
    best = F.coalesce(rate(F.col("near.done"), F.col("near.sampled_at")), rate(F.col("done0"), F.col("at0")))
    return found.select("document_id", "stage", F.round((F.col("total") - F.col("done")) / best, 3).alias("seconds_left"))


def batch_status(items: DataFrame) -> DataFrame:
    """State of each batch from its items: failed if all failed, done if all are finished, review if any waits for one,
    else running; with the counts."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = items.groupBy("batch_id").agg(F.count("*").alias("n"), is_("failed").alias("failed"), is_("ready", "archived", "rejected").alias("finished"), is_("awaiting_review").alias("review"))
    state = F.when(F.col("failed") == F.col("n"), "failed").when(F.col("failed") + F.col("finished") == F.col("n"), "done").when(F.col("review") > 0, "review").otherwise("running")
    return counts.withColumn("state", state)


def batch_flags(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """What each item of a batch needs: it failed, waits, needs a review (and why), or can be confirmed."""
    met = items.join(decisions.select("document_id", "decision", F.col("policy_id").alias("best_policy_id")), "document_id", "left")
    other = F.col("policy_id").isNotNull() & F.col("best_policy_id").isNotNull() & (F.col("policy_id") != F.col("best_policy_id"))
    flag = (
        F.when(F.col("status") == "failed", "failed").when(F.col("status") == "processing", "waiting").when(F.col("decision") == "duplicate", "duplicate")
        .when(F.col("decision") == "conflict", "conflict").when(other, "other_policy").otherwise("confirm")
    )
    return met.select("batch_id", "document_id", flag.alias("flag"))


def sort_category(policies: DataFrame, versions: DataFrame, mode: str) -> DataFrame:
    """Policies of each category with their place in it: by arranged order, name, latest upload or highest version; nothing known last."""
    facts = versions.groupBy("policy_id").agg(F.max("effective_from").alias("latest"), F.count("*").alias("n_versions"))
    met = policies.join(facts, "policy_id", "left")
    order = {
        "custom": [F.asc_nulls_last("display_order"), F.lower("name")], "name": [F.lower("name")], "latest": [F.desc_nulls_last("latest")], "versions": [F.desc_nulls_last("n_versions")],
    }[mode]
    return met.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(*order, "policy_id")))


def newest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each group in `order`."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)


def inbox(notices: DataFrame, n: int) -> DataFrame:
    """Each user's newest notices, with how many of all are unread."""
    unread = notices.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"))
    return newest(notices, ["user_id"], [F.desc("created_at"), F.desc("notice_id")], n).join(unread, "user_id")


def outline(sections: DataFrame, key: str, most: int = 2000) -> DataFrame:
    """Headed sections of each document in order, at most `most`."""
    return newest(sections.filter("level > 0"), [key], [F.col("order_index")], most)


def reembed_plan(chunks: DataFrame, model: str) -> DataFrame:
    """Documents with chunks of another model, or of none, and how many."""
    return chunks.filter(F.coalesce("model", F.lit("")) != model).groupBy("document_id").agg(F.count("*").alias("n_chunks"))


def reuse_embeddings(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Each chunk with what is to be done: its vector is in the cache by (model, hash), or it is the first of its hash
    that must be embedded, or it waits for that first."""
    known = cache.filter(F.col("model") == model).select("chunk_hash").distinct().withColumn("cached", F.lit(True))
    first = chunks.groupBy("chunk_hash").agg(F.min("chunk_id").alias("first_id"))
    met = chunks.join(known, "chunk_hash", "left").join(first, "chunk_hash")
    what = F.when(F.col("cached"), "reuse").when(F.col("chunk_id") == F.col("first_id"), "embed").otherwise("wait")
    return met.select("chunk_id", "chunk_hash", what.alias("action"))


def named_files(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Queries that name a file with its whole name, in any case. Names are looked for only where a word of the query ends like a file."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z0-9][a-z0-9_\-]*\.(?:pdf|docx?|txt|rtf))\b"), F.lit(1)))
    said = queries.select("query_id", F.explode(words).alias("name"))
    return said.join(docs.select(F.lower("file_name").alias("name"), "document_id"), "name").select("query_id", "document_id")


def relations(edges: DataFrame) -> DataFrame:
    """Each policy's relations to others, seen from both ends: (policy_id, direction, kind, other_id)."""
    out = edges.select(F.col("from_id").alias("policy_id"), F.lit("outgoing").alias("direction"), "kind", F.col("to_id").alias("other_id"))
    back = edges.select(F.col("to_id").alias("policy_id"), F.lit("incoming").alias("direction"), "kind", F.col("from_id").alias("other_id"))
    return out.unionByName(back)
