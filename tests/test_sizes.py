"""Plans and rows of queries whose work once grew faster than their tables."""

import hashlib
import itertools
import math
import re

from pyspark.sql import functions as F

from codicil.functions import text
from codicil.operators import amendments, batches, compare, fingerprints, hybrid, matching, metadata, retrieval, scope, structure, titles, worklists
from codicil.plans import catalog_hybrid, catalog_structure, catalog_work
from codicil.plans.views import Views


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_clauses_are_cut_to_their_first_chunks_before_queries_meet_them(spark):
    queries = spark.createDataFrame([(i, f"What does clause {i % 2 + 1} say?") for i in range(30)], "query_id long, text string")
    chunks = spark.createDataFrame([(i, "1.2" if i % 3 else "2") for i in range(100)], "chunk_id long, number string")
    found = structure.clause_lane(queries, chunks, 4)
    rows = [(r.query_id, r.chunk_id) for r in found.collect()]
    assert len(rows) == 120 and sorted(c for q, c in rows if q == 1) == [0, 3, 6, 9] and sorted(c for q, c in rows if q == 2) == [1, 2, 4, 5]
    plan = optimized(found)
    assert plan.index("Join") < plan.index("Window")


def test_exploded_assignments_are_not_broadcast_to_amended_passages(spark):
    items = spark.createDataFrame([(1, 1, 7, "5.2"), (2, 2, 7, "5.2"), (3, 3, 7, "5.2")], "query_id long, user_id long, policy_id long, number string").selectExpr("*", "query_id * 10 as item_id", "cast(null as date) as as_of")
    relations = spark.createDataFrame([(i, "t", 7, "AMENDS", "confirmed", True, ["5"], i % 2, None if i % 3 else i % 4, i) for i in range(12)], "source_document_id long, title string, policy_id long, relation_type string, status string, ready boolean, clauses array<string>, organization_id long, branch_id long, own_policy_id long").withColumn("effective_from", F.lit("2020-01-01").cast("date"))
    people = spark.createDataFrame([(1, 1, 1, "admin"), (2, 1, 1, "manager"), (3, 1, 1, "user")], "user_id long, organization_id long, branch_id long, role string")
    mine = spark.range(12).select(F.lit(3).cast("long").alias("user_id"), F.explode(F.array(F.col("id"), F.col("id") + 100)).alias("policy_id")).filter("policy_id in (5, 9, 4)")
    found = amendments.attach_amendments(items, relations, people, mine)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, set()).add(r.source_document_id)
    assert got == {1: {1, 3, 5, 7, 9, 11}, 2: {1, 5, 7, 9, 11}, 3: {5, 9}}
    assert not re.search(r"BroadcastHashJoin \[[^]]*own_policy_id", executed(found))


def test_keys_of_fingerprints_are_not_broadcast(spark):
    prints = spark.createDataFrame([(1, 0), (2, 7), (3, 15), (4, -1), (5, -2), (6, -2)], "doc_id long, simhash long")
    found = fingerprints.near_fingerprints(prints)
    assert {(r.doc_id, r.other_id, r.n_copies, r.n_other, r.distance) for r in found.collect()} == {(1, 2, 1, 1, 3), (2, 3, 1, 1, 1), (4, 5, 1, 2, 1)}
    assert "Broadcast" not in executed(found)


def test_audiences_are_not_shuffled_to_be_distinct(spark):
    policies = spark.createDataFrame([(1, 1, 1), (1, 1, None), (2, 1, None), (3, 2, 1), (4, 1, 1), (4, 1, 1)], "policy_id long, organization_id long, branch_id long")
    users = spark.createDataFrame([(1, "manager", 1, 1), (2, "manager", 1, 2), (2, "user", 1, 2), (3, "user", 1, 1), (5, "admin", 1, 1)], "user_id long, role string, organization_id long, branch_id long")
    mine = spark.createDataFrame([(1, 4), (2, 4), (2, 1), (3, 3), (3, 3), (3, 9)], "user_id long, policy_id long")
    found = scope.audience(policies, users, mine)
    rows = sorted((r.policy_id, r.user_id) for r in found.collect())
    assert rows == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3), (4, 1), (4, 2)]
    assert optimized(found).startswith("Union")


def test_policies_of_a_number_are_cut_before_uploads_meet_them(spark):
    kind = "u_number string, u_document_number string, u_title string, u_category string, u_issuer string, u_simhash long, u_keys array<string>"
    uploads = spark.createDataFrame([(1, "PN 1", None, None, None, None, None, None, None), (2, "PN 1", None, None, None, None, None, None, 40), (3, None, "D1", "Gold rules", None, None, None, None, None)], "document_id long, " + kind + ", intended_policy_id long")
    policies = spark.createDataFrame([(i, "PN-1", "D-1", f"Gold rule {i}", None, None, None, None) for i in range(60)], ("policy_id long, " + kind).replace("u_", "p_"))
    found = batches.existing_policy(uploads, policies)
    assert {(r.document_id, r.policy_id, r.reason) for r in found.collect()} == {(1, 0, "policy_number"), (2, 40, "policy_number"), (3, 0, "document_number")}
    assert len(re.findall(r"windowspecdefinition\(key#", optimized(found))) >= 2


def test_deletions_of_words_are_not_broadcast(spark):
    broken = spark.createDataFrame([(1, "manul"), (1, "gidlines")], "doc_id long, word string")
    words = spark.createDataFrame([(1, "manual", 2), (1, "guidelines", 3)], "doc_id long, term string, n long")
    found = titles.close_words(broken, words)
    assert {(r.word, r.term) for r in found.collect()} == {("manul", "manual"), ("gidlines", "guidelines")}
    assert "Broadcast" not in executed(found)


def test_best_texts_are_found_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SCORES", 12)  # a few texts at a time
    words = ["gold", "loan", "rate", "year", "home"]
    texts = {i: " ".join(words[j] for j in range(5) for _ in range((i * (j + 3)) % 4)) for i in range(80)} | {80: None, 81: ""}
    weight = {"gold": 1.000001, "loan": 2.5, "rate": 0.0, "year": 0.333333, "home": 3.0}
    asked = {1: ["gold", "loan"], 2: ["rate"], 3: words, 4: ["none"]}
    queries = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in ts], "query_id long, term string")
    rows, weights = spark.createDataFrame(list(texts.items()), "row_id long, text string").repartition(3), spark.createDataFrame(list(weight.items()), "term string, weight double")
    for block in (4096, 1):
        found = retrieval.best_texts(queries, rows, weights, 5, block)
        got = {}
        for r in found.collect():
            got.setdefault(r.query_id, []).append((-r.score, r.row_id))
        for q, terms in asked.items():
            every = []
            for i, text in texts.items():
                tf = {t: (text or "").split().count(t) for t in terms}
                if any(tf.values()):
                    every.append((-sum((2 * round(weight[t] * 1e6) * n + n + 1) // (2 * (n + 1)) for t, n in tf.items() if n), i))
            assert sorted(got.get(q, [])) == sorted(every)[:5]
        assert len(re.findall(r"\bExchange hashpartitioning", executed(found).split("Initial Plan")[-1])) == 1


def test_titles_are_mended_in_their_rows(spark):
    """Two shuffles, of titles and of texts; pages of one document are one text."""
    broken = spark.createDataFrame([(1, "OUR CODE OF E HICS"), (2, "T H E annul manul"), (3, ""), (4, None), (5, "X Y")], "doc_id long, title string")
    pages = spark.createDataFrame([(1, "our our code code ethics"), (1, "ethics"), (2, "annual annual manual"), (2, None), (2, "manual")], "doc_id long, text string")
    found = titles.repair_titles(broken, pages)
    assert {r.doc_id: r.repaired for r in found.collect()} == {1: "OUR CODE OF ETHICS", 2: "T H E annual manual", 3: "", 4: None, 5: "X Y"}
    plan = executed(found).split("Initial Plan")[-1]
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 2 and "term" not in "".join(re.findall(r"hashpartitioning\((.*?),", plan))


def test_terms_meet_only_chunks_that_the_asker_may_see(spark):
    chunks = spark.createDataFrame([(i, f"gold loan w{i}", 1 if i < 8 else 2, i % 2 if i % 3 else None, i) for i in range(16)], "chunk_id long, content string, organization_id long, branch_id long, policy_id long")
    people = spark.createDataFrame([(1, 1, 1, "admin"), (2, 1, 1, "manager"), (3, 1, 1, "user"), (4, 2, None, "manager"), (5, None, 1, "admin"), (6, 1, 0, None)], "user_id long, organization_id long, branch_id long, role string")
    queries = spark.createDataFrame([(i * 10, i, "gold") for i in range(1, 8)], "query_id long, user_id long, text string")
    mine = spark.createDataFrame([(3, 0), (3, 1), (3, 2), (3, 9), (3, 1), (6, 4), (6, 1), (1, 9)], "user_id long, policy_id long")
    found = retrieval.scoped_lane(queries, chunks, people, mine)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert {q: sorted(c) for q, c in got.items()} == {10: list(range(8)), 20: [0, 1, 3, 5, 6, 7], 30: [0, 1], 40: [9, 12, 15], 60: [4]}
    joins = re.findall(r"Join \w+, (.*)", optimized(found))
    assert any("organization_id" in j and "term" in j for j in joins) and not any("term" in j and "organization_id" not in j for j in joins)


def test_scoped_search_counts_every_term_at_any_size(spark):
    """2,100 chunks: terms of all of them count as they do for fewer, and a frequency is no capped one."""
    for n in (90, 2100):
        rows = spark.range(n).selectExpr("id as chunk_id", "concat('exceed', if(id % 3 = 0, ' gold', ''), if(id % 30 = 0, ' loan', '')) as content", "1L as organization_id", "cast(null as long) as branch_id", "id % 40 as policy_id")
        people = spark.createDataFrame([(1, 1, 1, "admin"), (2, 1, 1, "manager"), (3, 1, 1, "user")], "user_id long, organization_id long, branch_id long, role string")
        queries = spark.createDataFrame([(10 * u + i, u, text) for u in (1, 2, 3) for i, text in enumerate(("exceed gold loan", "exceed", "exceed gold months"))], "query_id long, user_id long, text string")
        mine = spark.createDataFrame([(3, 0), (3, 1)], "user_id long, policy_id long")
        weight = lambda df: math.floor(math.log(1 + (n - df + 0.5) / (df + 0.5)) * 1e6 + 0.5)  # noqa: B023, E731
        part = {"exceed": (weight(n) + 1) // 2, "gold": (weight(n // 3) + 1) // 2, "loan": (weight(n // 30) + 1) // 2}
        has = lambda i: {"exceed", *(["gold"] if i % 3 == 0 else []), *(["loan"] if i % 30 == 0 else [])}
        got = {}
        for r in retrieval.scoped_lane(queries, rows, people, mine).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id, r.score))
        assert len(got) == 9
        for u in (1, 2, 3):
            for i, text in enumerate(("exceed gold loan", "exceed", "exceed gold months")):
                all_ = sorted((-sum(part[t] for t in has(c) & set(text.split())), c) for c in range(n) if u < 3 or c % 40 < 2)[:50]
                assert sorted(got[10 * u + i]) == [(k + 1, c, -s / 1e6) for k, (s, c) in enumerate(all_)]


def test_ties_of_parts_of_scores_go_up_whatever_the_last_bit(spark):
    rows = spark.range(1_000_001, 1_002_000).selectExpr("id", "id / 1000000D as weight", "explode(sequence(1L, 5L)) as tf").withColumn("part", retrieval.exact_part())
    for r in rows.collect():
        assert r.part == (2 * r.id * r.tf + r.tf + 1) // (2 * (r.tf + 1))


def test_vectors_of_chunks_are_not_shuffled_to_meet_questions(spark):
    chunks, _ = catalog_hybrid.library(Views(spark, "/root/testdata/sf0.001"))
    plan = executed(chunks)
    assert re.search(r"BroadcastHashJoin \[at#", plan) and not re.search(r"Exchange hashpartitioning\(at#", plan)
    c = catalog_hybrid.corpus(Views(spark, "/root/testdata/sf0.001"))[0]
    whole, cut = hybrid.vector_lane(c), hybrid.vector_lane(c, 8)
    assert "CoGroup" not in executed(whole)
    rows = lambda df: sorted((r.query_id, r.rank, r.chunk_id) for r in df.collect())
    assert rows(whole) and rows(whole) == rows(cut)


def test_patterns_of_headings_are_matched_once_for_a_line(spark):
    lines = spark.createDataFrame([(1, 1, i, t, s, b) for i, (t, s, b) in enumerate([("Chapter  2: Loans", 10.0, False), ("3.1  Gold loans", 10.0, False), ("plain text, 3 words", 10.0, False), ("Big Title", 14.0, True), ("\tsection 4 \n Fees", 10.0, False), ("section 4 (a) applies", 10.0, False), ("3. Not set off", 10.0, False)])], "doc_id long, page int, line_no int, text string, size double, bold boolean")
    found = structure.classify_lines(lines, structure.body_size(lines)).filter("level is not null")
    assert sorted((r.line_no, r.level, r.number, r.title) for r in found.collect()) == [(0, 1, "Chapter 2", "Loans"), (1, 2, "3.1", "Gold loans"), (3, 1, None, "Big Title"), (4, 2, "Section 4", "Fees")]
    assert optimized(found).count("regexp_replace(text") == 1


def test_sections_are_shuffled_by_version_once(spark):
    plan = executed(catalog_structure.classified(Views(spark, "/root/testdata/sf0.001")))
    assert not re.search(r"hashpartitioning\((?:version_id|doc_id)#[^)]*\), ENSURE_REQUIREMENTS", plan) and "REPARTITION_BY_COL" in plan


def test_tickets_are_counted_without_pairs_of_principals_and_tickets(spark):
    tickets = spark.createDataFrame([(i, i % 4 if i % 7 else None, i % 2, "help" if i % 3 else "data", "error" if i % 5 else "login", ["open", "in_progress", "closed"][i % 3]) for i in range(80)], "ticket_id long, author_id long, organization_id long, queue string, kind string, status string")
    people = spark.createDataFrame([(0, 0, "user"), (1, 1, "manager"), (2, 0, "manager"), (3, None, "manager"), (None, 1, "manager"), (9, 1, "admin"), (9, 0, "manager")], "user_id long, organization_id long, role string")
    queues = spark.createDataFrame([("manager", "help"), ("admin", "help"), ("admin", "data")], "role string, queue string")
    seen = worklists.visible_tickets(tickets, people, queues)
    told = lambda df: sorted(tuple(r) for r in df.collect())
    for box, f in (("all", {}), ("mine", {"status": "open"}), ("queue", {"kind": "error"}), ("open", {}), ("queue", {"status": "none"})):
        ends = [] if box == "queue" else [F.min("ticket_id"), F.max("ticket_id")]
        got = worklists.ticket_counts(tickets, people, queues, box, **f)
        assert told(got) == told(worklists.find_tickets(seen, box, **f).groupBy("user_id").agg(F.count("*"), *ends))
    # whoever joins the tickets' columns makes pairs
    assert not re.search(r"Join Inner, [^\n]*author_id", optimized(catalog_work.visible_tickets(Views(spark, "/root/testdata/sf0.001"))))


def test_features_of_texts_are_summed_where_they_are_read(spark):
    texts = [(1, "Gold loan gold-loan, gold loan 7.5 rates"), (2, None), (3, ""), (4, "interest " * 40 + "x1 interests"), (4, "Limits"), (None, "limits apply"), (5, "a of ö")]
    found = metadata.hash_embedding(spark.createDataFrame(texts, "doc_id long, text string"), 16, 3)
    sums = {}
    for doc, t in texts:
        words = [w for w in re.findall(text.TOKEN, (t or "").lower()) if len(w) > 1 and w not in text.STOP_WORDS]
        every = [(w, 10) for w in words] + [(f"{a} {b}", 7) for a, b in itertools.pairwise(words)] + [("#" + w[i : i + 3], 3) for w in words if len(w) > 4 for i in range(len(w) - 2)]
        for f, weight in every:
            h, one = hashlib.md5(f.encode()).hexdigest(), sums.setdefault(doc, {})
            one[int(h[:8], 16) % 16] = one.get(int(h[:8], 16) % 16, 0) + (weight if int(h[8], 16) % 2 else -weight)
    length = {d: math.sqrt(sum((v / 10) ** 2 for v in s.values())) for d, s in sums.items()}
    want = {(d, p): round(v / 10 / length[d], 6) for d, s in sums.items() for p, v in s.items() if v}
    assert {(r.doc_id, r.place): r.value for r in found.collect()} == want and len(want) > 20
    assert not re.search(r"hashpartitioning\([^)]*\bf#", executed(found))  # no feature is shuffled


def test_pages_are_joined_inside_their_rows(spark):
    pages = spark.createDataFrame([(1, 2, [(0, "b-"), (1, "x"), (0, "a ")]), (1, 1, [(0, "Chapter 1\n and-"), (0, "chapter 2")]), (2, 3, [(5, "contents")])], "doc_id long, page int, lines array<struct<block:int,text:string>>")
    found = structure.paragraphs(pages)
    assert sorted((r.doc_id, r.page, r.block, r.text) for r in found.collect()) == [(1, 1, 0, "Chapter 1 andchapter 2"), (1, 2, 0, "ba "), (1, 2, 1, "x"), (2, 3, 5, "contents")]
    v = Views(spark, "/root/testdata/sf0.001")
    for name in ("paragraphs", "contents_chunks"):
        assert "ObjectHashAggregate" not in executed(catalog_structure.QUERIES[name](spark, v.directory))
    texts = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 3, "c")], "doc_id long, page int, text string")
    assert sorted((r.doc_id, r.chunk_index, r.text) for r in structure.page_chunks(texts).collect()) == [(1, 0, "a\nb"), (1, 1, "b"), (2, 0, "c"), (2, 2, "c")]


def test_uploads_do_not_meet_every_version_of_their_policy(spark):
    known = spark.createDataFrame([(1, 10, "v1", "2020-01-01", "a"), (1, 11, "v2", "2021-01-01", None), (None, 12, "v9", "2022-01-01", "b"), (2, 13, None, None, "c")], "policy_id long, version_id long, version_label string, effective_from string, content_hash string")
    asked = [(1, 1, "v7", "2023-01-01", "a"), (2, 1, "v2", "2023-01-01", None), (3, 1, "v3", "2020-01-01", "x"), (4, 1, "v3", "2020-06-01", "x"), (5, 1, "v1.5", "2020-06-01", "x"), (6, 1, "v3", "2022-01-01", "x"), (6, 1, "v3", "2022-01-01", "x"), (7, None, "v9", "2022-01-01", "b"), (8, 2, None, None, None), (9, 3, "v1", "2020-01-01", "a")]
    days = lambda df, c: df.withColumn(c, F.col(c).cast("date"))
    found = matching.version_check(days(spark.createDataFrame(asked, "document_id long, policy_id long, label string, day string, content_hash string"), "day"), days(known, "effective_from"))
    want = [(1, "content_duplicate"), (2, "label_exists"), (3, "day_exists"), (4, "order_mismatch"), (5, "historical"), (6, "new_version"), (7, "new_version"), (8, "new_version"), (9, "new_version")]
    assert sorted((r.document_id, r.finding) for r in found.collect()) == want
    assert "Join" not in optimized(found)


def test_patterns_of_figures_are_matched_once_for_a_text(spark):
    rows = spark.createDataFrame([(1, "Rs. 1,200 and 7.5% on 2024-01-02 for 3 years, 5 % or INR 40"), (2, None), (3, "no figure")], "id long, content string")
    found = compare.numeric_facts(rows, ["id"])
    assert sorted((r.id, r.kind, r.value, r.place) for r in found.collect()) == [(1, "amount", "1200", 1), (1, "amount", "40", 2), (1, "date", "2024-01-02", 1), (1, "duration", "3 year", 1), (1, "percent", "5", 2), (1, "percent", "7.5", 1)]
    assert optimized(found).count(compare.PATTERNS["date"]) == 2  # to find and to blank
