"""Literal cases of single operators."""

import datetime as dt

from pyspark.sql import functions as F

from codicil.functions import text
from codicil.operators import compare, evidence, fingerprints, retrieval, timeline
from codicil.sources import tables

D = dt.date


def test_make_room_moves_an_unbroken_run_of_placeholders(spark):
    versions = spark.createDataFrame(
        [(1, 1, D(2024, 1, 3), "upload_date"), (1, 2, D(2024, 1, 4), "inferred"), (1, 3, D(2024, 1, 5), "upload_date"), (1, 4, D(2024, 1, 1), "entered"), (2, 5, D(2024, 1, 5), "entered")],
        "policy_id long, version_id long, effective_from date, date_source string",
    )
    new = spark.createDataFrame([(1, D(2024, 1, 5)), (2, D(2024, 1, 5))], "policy_id long, day date")
    got = {r.version_id: (r.effective_from, r.moved, r.conflict) for r in timeline.make_room(versions, new).collect()}
    assert got == {
        1: (D(2024, 1, 2), True, False), 2: (D(2024, 1, 3), True, False), 3: (D(2024, 1, 4), True, False), 4: (D(2024, 1, 1), False, False), 5: (D(2024, 1, 5), False, True),
    }


def test_asof_join_is_half_open(spark):
    versions = spark.createDataFrame(
        [(1, 10, D(2024, 1, 1), D(2024, 2, 1), "active"), (1, 11, D(2024, 2, 1), None, "active"), (1, 12, D(2023, 1, 1), None, "withdrawn")],
        "policy_id long, version_id long, effective_from date, effective_to date, status string",
    )
    facts = spark.createDataFrame([(1, D(2023, 6, 1)), (1, D(2024, 1, 1)), (1, D(2024, 1, 31)), (1, D(2024, 2, 1)), (2, D(2024, 2, 1)), (1, None)], "policy_id long, day date")
    got = sorted([(r.policy_id, str(r.day), r.version_id) for r in timeline.asof_join(facts, versions, "policy_id", "day").collect()], key=str)
    assert got == sorted([(1, "2023-06-01", None), (1, "2024-01-01", 10), (1, "2024-01-31", 10), (1, "2024-02-01", 11), (2, "2024-02-01", None), (1, "None", None)], key=str)


def test_numeric_facts_do_not_overlap(spark):
    rows = spark.createDataFrame([(1, "Pay Rs. 3,50,000 by 2024-05-01: 7.5% for 30 years"), (2, None), (3, "")], "id long, content string")
    got = sorted((r.kind, r.value) for r in compare.numeric_facts(rows, ["id"]).collect())
    assert got == [("amount", "350000"), ("date", "2024-05-01"), ("duration", "30 year"), ("percent", "7.5")]


def test_numeric_changes_pair_by_kind(spark):
    diff = spark.createDataFrame([(1, 2, 5, "Rate 4% and 6%. Term 3 years.", "Rate 4% and 7%. Term 3 years.", "modified")], "old_id long, new_id long, number int, old_content string, new_content string, change string")
    changes = compare.numeric_changes(diff)
    assert [(r.kind, r.old_value, r.new_value) for r in changes.collect()] == [("percent", "6", "7")]
    assert compare.summary_lines(changes).first().line == "Changed: 5 percent (6 → 7)"
    r = compare.changed_sentences(diff).first()
    assert (r.removed, r.added) == ("Rate 4% and 6%.", "Rate 4% and 7%.")


def test_text_columns(spark):
    row = spark.createDataFrame([("Policy v2.0 (Draft) 2024", "v1.0.0", 1234567, "key: api_key=abc123, Bearer x.y")], "t string, v string, n long, s string").select(
        text.title_key(F.col("t")).alias("t"), text.version_key(F.col("v")).alias("v"), text.indian_digits(F.col("n")).alias("n"), text.redacted(F.col("s")).alias("s"), text.tokens(F.lit("The 5.2 rule of AND-gates, a b")).alias("k"),
    ).first()
    assert row.t == "policy" and row.v == [1] and row.n == "12,34,567" and row.s == "key: api_key=***, Bearer ***" and row.k == ["5.2", "rule", "and-gates"]


def test_simhash_equals_its_definition(spark):
    import hashlib

    words = "one two three four five two three four".split()
    votes = [0] * 64
    for i in range(len(words) - 2):
        h = int(hashlib.md5(" ".join(words[i : i + 3]).encode()).hexdigest()[:16], 16)
        votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
    want = sum(1 << b for b, v in enumerate(votes) if v > 0)
    got = fingerprints.simhash(spark.createDataFrame([(1, "One two  three four, five two three four.")], "doc_id long, text string")).first().simhash
    assert got % (1 << 64) == want


def test_near_fingerprints_equal_all_pairs(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(62) for _ in range(20)]
    rows = [(i, rng.choice(base) ^ sum(1 << rng.randrange(62) for _ in range(rng.randrange(4)))) for i in range(150)]
    got = {(r.doc_id, r.other_id) for r in fingerprints.near_fingerprints(spark.createDataFrame(rows, "doc_id long, simhash long")).collect()}
    first = {}
    for i, h in rows:
        first.setdefault(h, i)
    want = {tuple(sorted((i, j))) for h, i in first.items() for g, j in first.items() if i < j and bin(h ^ g).count("1") <= 3}
    assert got == want


def test_fusion_and_latency(spark):
    lane = spark.createDataFrame([(1, 7, 1), (1, 8, 2)], "query_id long, doc_id long, rank int")
    got = [(r.doc_id, r.fused, r.rank) for r in retrieval.fuse({"exact": lane, "keyword": lane}).orderBy("rank").collect()]
    assert got == [(7, round(2.5 / 61, 5), 1), (8, round(2.5 / 62, 5), 2)]
    rows = spark.createDataFrame([("a", float(i)) for i in range(10)], "k string, v double")
    r = evidence.latency(rows, "k", "v").first()
    assert (r.p50, r.p95, r.p99) == (5.0, 9.0, 9.0)


def test_sinks_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, n int")
    target = spark.createDataFrame([(2, "old", 5)], "k int, v string, n int")
    assert [r.k for r in tables.append_new(rows, target, ["k"]).collect()] == [1]
    assert sorted((r.k, r.v) for r in tables.upsert(rows, target, ["k"], "n").collect()) == [(1, "b"), (2, "c")]
    path = str(tmp_path / "t")
    rows.write.partitionBy("k").parquet(path)
    tables.overwrite_partition(rows.filter("k = 1").limit(1), path, "k")
    assert spark.read.parquet(path).count() == 2
    cells = spark.createDataFrame([(["Rate", "", "Term"], [" 4% ", "x", ""])], "h array<string>, c array<string>")
    assert cells.select(tables.render_rows(cells, "h", "c").alias("r")).first().r == "Rate: 4% | x"
    tables.write_grades(rows, str(tmp_path / "g"))
    assert spark.read.csv(str(tmp_path / "g"), header=True).count() == 3
