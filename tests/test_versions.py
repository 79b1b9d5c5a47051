"""Alignment and comparison of versions against plain passes, on odd rows and on a large document."""

import random
import re
import time
from collections import Counter, deque
from difflib import SequenceMatcher

from codicil.operators import compare, structure

SCHEMA = "old_id long, new_id long, place int, number string, level int, title string, content string"


def title_key(t):
    t = (t or "").lower()
    for pattern in (r"\b(?:version|ver|v)\s*\.?\s*\d+(?:\.\d+)*\b", r"\b(?:19|20)\d\d\b", r"\b(?:draft|final|revised|updated|copy)\b", r"[^a-z0-9]+"):
        t = re.sub(pattern, " ", t)
    return t.strip()


def plain_alignment(old, new):
    """Rows (old place, new place, by) of one pair, by passes over lists."""
    out, left, right = [], list(old), list(new)
    for by, key in (("number", lambda r: r[3]), ("front", lambda r: "f" if r[4] == 0 else None), ("title", lambda r: title_key(r[5]))):
        waiting = {}
        for n in right:
            if key(n) is not None:
                waiting.setdefault(key(n), deque()).append(n)
        for o in list(left):
            if key(o) is not None and waiting.get(key(o)):
                n = waiting[key(o)].popleft()
                out.append((o[2], n[2], by))
                left.remove(o)
                right.remove(n)

    def nested(o, n):
        a, b = title_key(o[5]), title_key(n[5])
        x, y = Counter(o[6] or ""), Counter(n[6] or "")
        total = x.total() + y.total()
        return a and b and (a in b or b in a) and (2 * (x & y).total() / total if total else 1) >= 0.6

    alike = lambda o, n: SequenceMatcher(None, title_key(o[5]), title_key(n[5])).ratio() >= 0.75
    for by, match in (("nested title", nested), ("alike title", alike)):
        for o in list(left):
            for n in list(right):
                if match(o, n):
                    out.append((o[2], n[2], by))
                    left.remove(o)
                    right.remove(n)
                    break
    return out + [(o[2], None, "removed") for o in left] + [(None, n[2], "added") for n in right]


def test_alignment_equals_plain_passes(spark):
    rng = random.Random(3)
    titles = [None, "", "Loan Limits", "Limits", "Loan Limit 2024", "Loan limits Version 2", "Loan Amounts", "Eligible Borrowers", "Eligibility of borrowers", "Draft Fees", "Fees", "A", "AB"]
    made = lambda pair: [(*pair, i, rng.choice([None, "1", "1.1", "2", "2.2"]), rng.choice([0, 1, 1, 2, None]), rng.choice(titles), rng.choice([None, "", "the rate is 5%", "a rate of 6 %", "zzz"])) for i in range(rng.randrange(9))]
    sides = {(p, p + 100): (made((p, p + 100)), made((p, p + 100))) for p in range(60)}
    old = spark.createDataFrame([r for a, _ in sides.values() for r in a], SCHEMA)
    new = spark.createDataFrame([r for _, b in sides.values() for r in b], SCHEMA)
    got = sorted(tuple(map(str, r)) for r in compare.align_sections(old, new).collect())
    want = sorted(tuple(map(str, (*pair, *row))) for pair, (a, b) in sides.items() for row in plain_alignment(a, b))
    assert got == want and {w[4] for w in want} >= {"number", "front", "title", "nested title", "alike title", "removed", "added"}
    assert compare.align_sections(old.limit(0), new.limit(0)).count() == 0


def test_a_document_of_14000_sections(spark):
    rows = spark.range(14_000).selectExpr("1L as version_id", "cast(id as int) as order_index", "if(id % 70 = 0, null, cast(id as string)) as number", "1 as level", "concat('Rule on matter ', id) as title", "concat('The rate is ', id % 97, ' %.') as content")
    after = rows.selectExpr("2L as version_id", "order_index", "number", "level", "if(order_index % 70 = 0, concat('New ', title), title) as title", "if(order_index % 2 = 0, content, 'The rate is 99 %.') as content")
    pairs = spark.createDataFrame([(1, 2)], "old_id long, new_id long")
    began = time.time()
    found = compare.compare_versions(rows.unionByName(after), pairs)
    counts = {(r["by"], r["change"]): r["count"] for r in found.groupBy("by", "change").count().collect()}
    assert counts[("number", "unchanged")] + counts[("number", "modified")] == 13_800 and counts[("nested title", "modified")] == 200
    assert time.time() - began < 60


def test_parts_join_only_their_section(spark):
    rows = [(1, 1, "1", "A (continued)", "x"), (1, 2, "1", "A (continued)", "y"), (1, 3, "2", "B", "b"), (1, 4, "2", "B (continued)", "c"), (1, 5, "2", "B (continued)", None), (1, 6, "3", "B (continued)", "d"), (1, 7, None, None, "e"), (1, 8, None, "C", ""), (1, 9, None, "C (continued)", "f")]
    got = structure.merge_continuations(spark.createDataFrame(rows, "version_id long, order_index int, number string, title string, content string")).orderBy("order_index").collect()
    assert [(r.order_index, r.title, r.content) for r in got] == [(1, "A (continued)", "x"), (2, "A (continued)", "y"), (3, "B", "b\n\nc"), (6, "B (continued)", "d"), (7, None, "e"), (8, "C", "\n\nf")]


def test_changed_figures_and_similarity_of_odd_texts(spark):
    rows = [
        (1, 2, "1", "modified", "5% and 5% and 6%", "6% and 5% and Rs. 7"), (1, 2, "2", "modified", None, "10% of Rs. 1,00,000"), (1, 2, "3", "modified", "", ""), (1, 2, "4", "unchanged", "1%", "2%"),
        (1, 2, "5", "modified", " ".join(f"{i}%" for i in range(3000)), " ".join(f"{i}%" for i in range(1, 3001))),
    ]
    diff = spark.createDataFrame(rows, "old_id long, new_id long, number string, change string, old_content string, new_content string")
    got = sorted((r.number, r.kind, str(r.old_value), str(r.new_value)) for r in compare.numeric_changes(diff).collect())
    assert got == [("1", "amount", "None", "7"), ("1", "percent", "5", "None"), ("2", "amount", "None", "100000"), ("2", "percent", "None", "10"), ("5", "percent", "0", "3000")]
    ratio = {r.number: r.ratio for r in compare.section_similarity(diff).collect()}
    assert ratio["2"] == 0.0 and ratio["3"] == 1.0 and ratio["5"] > 0.99
    assert ratio["1"] == round(2 * (Counter(rows[0][4]) & Counter(rows[0][5])).total() / (len(rows[0][4]) + len(rows[0][5])), 6)


def test_versions_meet_in_one_shuffle_by_pair(spark):
    rows = spark.createDataFrame([(1, 1, "A", "x"), (2, 1, "A", "y"), (2, 2, "B", None)], "version_id long, number int, title string, content string")
    found = compare.compare_versions(rows, spark.createDataFrame([(1, 2)], "old_id long, new_id long"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [old_id") == 1 and plan.count("Join") == 1 and not re.search(r"Window .*old_id", plan)
    assert sorted((r.number, r.by, r.change, r.old_content, r.new_content) for r in found.collect()) == [(1, "number", "modified", "x", "y"), (2, "added", "added", None, "")]


def test_pairs_that_batches_cut_are_aligned_whole(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "7")
    try:
        test_alignment_equals_plain_passes(spark)
    finally:
        spark.conf.set(setting, before)


def test_similarity_counts_each_text_in_its_own_row():
    import pyarrow as pa

    texts = [("aab", "abb"), ("", "x"), ("", ""), ("é😀" * 5, "😀"), ("q" * 3_000_000, "qr"), ("ab", "ab")]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), *(pa.array([t[i] for t in texts]) for i in range(2))], names=["k", "o", "n"])
    got = [tuple(r.values()) for b in compare.shared_characters(iter([batch])) for r in b.to_pylist()]
    assert got == [(k, (Counter(o) & Counter(n)).total(), len(o) + len(n)) for k, (o, n) in enumerate(texts)]


def test_figures_meet_inside_their_row(spark):
    rng = random.Random(5)
    text = lambda: rng.choice([None, "", " ".join(rng.choice(["5%", "6 %", "Rs. 7", "2020-01-02", "3 months", "4 Days", "INR 1,00,000", "word"]) for _ in range(rng.randrange(9)))])
    rows = [(1, 2, i, "modified", text(), text()) for i in range(80)]
    diff = spark.createDataFrame(rows, "old_id long, new_id long, number int, change string, old_content string, new_content string")
    found = compare.numeric_changes(diff)
    assert not re.search("Repartition|Window|Aggregate", found._jdf.queryExecution().optimizedPlan().toString())
    got = Counter(map(tuple, found.collect()))
    want = Counter()
    for o, n, i, _, *texts in rows:
        facts = []
        for t in texts:
            each, left = {}, t or ""
            for kind, pattern in compare.PATTERNS.items():
                each[kind] = [re.sub(r"^(\S+)\s+(\w+?)s?$", r"\1 \2", v) if kind == "duration" else v for v in (m.lower().replace(",", "") for m in re.findall(pattern, left))]
                left = re.sub(pattern, " ", left)
            facts.append(each)
        for kind in compare.PATTERNS:
            only = []
            for a, b in ((facts[0][kind], facts[1][kind]), (facts[1][kind], facts[0][kind])):
                have, kept = Counter(b), []
                for v in a:
                    have[v] -= 1
                    kept += [v] if have[v] < 0 else []
                only.append(kept)
            for j in range(max(map(len, only))):
                want[(o, n, i, kind, *(x[j] if j < len(x) else None for x in only))] += 1
    assert got == want and len(want) > 50
