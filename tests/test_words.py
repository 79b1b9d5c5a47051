"""Titles, phrases, acronyms, stems, layouts and page marks on literal cases and odd rows."""

import pytest
from pyspark.sql import functions as F

from codicil.functions.stems import stem
from codicil.operators import batches, phrases, structure, titles


def test_stems(spark):
    want = {
        "Policies": "policy", "loans": "loan", "analysis": "analysis", "status": "status", "planned": "plan", "planning": "plan", "classes": "class", "processes": "process", "applied": "apply", "5.2s": "5.2s", "children": "child",
        "frozen": "freez", "authorisations": "authoriz", "'rates.'": "rate", "is": "is", "ties": "tie", "economically": "economic", "stopped": "stop", "bus": "bus", "ally": "ally", "misses": "misse", "": "",
    }
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in want], "w string").select("w", stem(F.col("w")).alias("s")).collect()}
    assert got == want
    assert spark.createDataFrame([(None,)], "w string").select(stem(F.col("w")).alias("s")).first().s is None


def test_coverage_counts_forms_of_a_term(spark):
    queries = spark.createDataFrame([(1, "renewables generation FIU-IND 4.25"), (2, "the of"), (3, None), (4, "gold")], "query_id int, text string")
    items = spark.createDataFrame([(1, 1, "Renewable power is generated; FIU of IND."), (1, 2, None), (4, 1, "golden")], "query_id int, item_id int, text string")
    got = {r.query_id: (r.coverage, r.missing) for r in phrases.stem_coverage(queries, items).collect()}
    assert got[2] == (1.0, "") and got[3] == (1.0, "") and got[4] == (0.0, "gold") and got[1] == (0.75, "4.25")


def test_key_phrases_leave_out_nested_ones(spark):
    text = "gold loan limit. " * 4 + "gold loan. " * 3 + "terms of the loan; " * 5 + "branch staff, " * 3 + "home rule. " * 9 + "rare pair. " * 2
    docs = spark.createDataFrame([(1, text, "The Home Rule"), (2, None, None), (3, "", "x"), (4, "a b " * 50, None)], "doc_id long, text string, name string")
    got = [(r.doc_id, r.place, r.phrase, r.n) for r in phrases.key_phrases(docs).orderBy("doc_id", "place").collect()]
    assert got == [(1, 1, "gold loan", 7), (1, 2, "loan limit", 4), (1, 3, "branch staff", 3)]


def test_acronyms_must_be_spelt(spark):
    texts = [
        "HVDC\nHigh Voltage Direct Current", "TBCB | Under Bidding 2028-29", "Acronym: EMI | Meaning: Equated Monthly Instalment", "by State Transmission Utilities (STUs), and XB (XB)", "HVDC is used for HVDC", "KYC: Know Your Customer", "LTV", None, "",
    ]
    got = {(r.chunk_id, r.acronym, r.expansion, r.way) for r in phrases.acronyms(spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string")).collect()}
    assert got == {(0, "HVDC", "High Voltage Direct Current", "stack"), (2, "EMI", "Equated Monthly Instalment", "row"), (3, "STU", "State Transmission Utility", "text"), (5, "KYC", "Know Your Customer", "line")}


def test_titles_are_found_and_mended(spark):
    line = "doc_id long, line_no int, text string, size double, bold boolean"
    lines = [(1, 1, "Circular", 10.0, False), (1, 2, "HOME LOAN", 20.0, True), (1, 3, "CREDIT POLICY", 19.9, True), (1, 4, "Part B", 12.0, False), (2, 1, None, None, None), (2, 2, "Policy on", 14.0, True), (2, 3, "‘Gold Loans’", 14.0, True), (3, 1, "of", 9.0, False)]
    opening = [(1, None, 10.0, None), (2, "policy on gold loans", 14.0, "scan_01.pdf"), (3, "", 9.0, None), (4, "x", 9.0, "Guide of Things")]
    got = {r.doc_id: (r.title, r.source) for r in titles.detect_title(spark.createDataFrame(lines, line), spark.createDataFrame(opening, "doc_id long, text string, body double, pdf_title string")).collect()}
    assert got[1] == ("HOME LOAN Credit Policy – Part B", "largest_font") and got[2] == ("Policy on Gold Loans", "heading_keyword") and got[4] == ("Guide of Things", "pdf_metadata") and 3 not in got
    broken = spark.createDataFrame([(1, "OUR CODE OF E HICS"), (2, "annul report"), (3, "Loan Rules"), (4, None), (5, "manul")], "doc_id long, title string")
    texts = spark.createDataFrame([(1, "our our our code code code ethics ethics"), (2, "annual annual report report report annul"), (3, "loans loans rules rules rules"), (5, "annual annual manual")], "doc_id long, text string")
    mended = {r.doc_id: r.repaired for r in titles.repair_titles(broken, texts).collect()}
    assert mended[1] == "OUR CODE OF ETHICS" and mended[2] == "annual report" and mended[3] == "Loan Rules" and mended[5] == "manul"


def test_pages_of_offsets(spark):
    df = spark.createDataFrame([(0,), (9,), (10,), (25,)], "x int")
    marks = F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(p).alias("page")) for o, p in ((5, 3), (10, 4), (20, 6))])
    assert [r.p for r in df.select(structure.page_at(marks, F.col("x"), F.lit(1)).alias("p")).collect()] == [3, 3, 4, 6]
    empty = F.array().cast("array<struct<offset:int,page:int>>")
    assert df.select(structure.page_at(empty, F.col("x"), F.lit(1)).alias("p")).first().p == 1


def test_chunks_know_their_pages_in_odd_sections(spark):
    one = "word " * 250
    rows = [(1, "A > B", f"{one}\n\n{one}\n\n{one}", [(0, 1), (1300, 2), (2600, 3)], 1), (2, None, None, [], 7), (3, "", "short", None, 9), (4, "x", "  \n\n ", [], 1)]
    df = spark.createDataFrame(rows, "doc_id int, path string, content string, page_marks array<struct<offset:int,page:int>>, page_start int")
    got = [(r.doc_id, r.chunk_index, r.char_start, r.page_start, r.page_end) for r in structure.chunk_sections(df, ["doc_id"]).orderBy("doc_id", "chunk_index").collect()]
    assert got == [(1, 0, 0, 1, 1), (1, 1, 1252, 1, 2), (1, 2, 2504, 2, 3), (3, 0, 0, 9, 9)]


LINE = "doc_id long, page int, block int, line_no int, text string, size double, bold boolean, y double"


def test_rows_merge_outside_of_tables(spark):
    rows = [(1, 1, 1, 1, "3.2", 10.0, True, 50.0), (1, 1, 2, 2, " Criteria ", 12.0, False, 52.5), (1, 1, 3, 3, "3.3.", 10.0, False, 70.0), (1, 1, 3, 4, "3.4", 10.0, False, 71.0), (1, 1, 3, 5, "Late", 10.0, False, 72.0), (1, 2, 1, 1, "3.5", 10.0, False, 1.0), (1, 2, 1, 2, "far", 10.0, False, 9.0)]
    rows += [(2, 1, 1, i, t, 10.0, b, y) for i, (t, b, y) in enumerate([("1.1", True, 1.0), ("x", False, 2.5), ("1.2", True, 10.0), ("y", False, 10.0), ("1.3", True, 20.0), ("z", False, 19.0)])]
    df = spark.createDataFrame(rows, LINE)
    assert [(r.doc_id, r.page, r.block, r.n_rows) for r in structure.table_blocks(df).collect()] == [(2, 1, 1, 3)]
    got = [(r.doc_id, r.page, r.text, r.size, r.bold) for r in structure.merge_rows(df).orderBy("doc_id", "page", "line_no").collect()]
    assert got[:6] == [(1, 1, "3.2 Criteria", 12.0, True), (1, 1, "3.3 3.4", 10.0, False), (1, 1, "Late", 10.0, False), (1, 2, "3.5", 10.0, False), (1, 2, "far", 10.0, False), (2, 1, "1.1", 10.0, True)]
    assert structure.merge_rows(df.limit(0)).count() == 0


def test_headings_carry_over_the_windows_of_a_large_document(spark):
    pages = spark.range(10_000).selectExpr("1L as doc_id", "cast(id div 10 + 1 as int) as page", "cast(id % 10 as int) as line_no", "if(id % 701 = 5, 1 + int(id % 3), null) as level", "if(id % 701 = 5, string(id), null) as number", "if(id % 701 = 5, concat('T', id), null) as title")
    got = structure.carry_headings(pages, 7).orderBy("page", "line_no").collect()
    count, last = 0, None
    for i, r in enumerate(got):
        if i % 701 == 5:
            count, last = count + 1, f"T{i}"
        assert (r.section, r.under_title, r.window) == (count, last, (r.page - 1) // 7)


def test_paths_name_the_headings_above(spark):
    heads = [(1, "A"), (3, "B"), (2, "C"), (4, "D"), (3, "E"), (1, "F"), (2, None)]
    rows = [(1, 1, 2 * i + 1, t or "", level, None, t) for i, (level, t) in enumerate(heads)] + [(1, 1, 0, "before", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string, level int, number string, title string")
    none = spark.createDataFrame([], "doc_id long, key string")
    got = [r.path for r in structure.build_sections(df, none).orderBy("section").collect()]
    assert got == ["", "A", "A > B", "A > C", "A > C > D", "A > C > E", "F", "F > "]


def test_summaries_keep_their_quotas(spark):
    text = "The branch must report each loan now. " * 20 + "Short one. Nothing applies unless a rule is there."
    df = spark.createDataFrame([(1, 1, "1", "Scope", text), (1, 2, "2", None, text), (2, 1, None, "x", None)], "doc_id long, place int, number string, title string, text string")
    counts = {r.kind: r["count"] for r in phrases.extractive_summary(df).groupBy("kind").count().collect()}
    assert counts == {"overview": 2, "purpose": 1, "rule": 8, "action": 5, "exception": 2}


@pytest.mark.parametrize(("given", "want"), [
    ([("2020-01-05", None, "2021-01-01"), (None, "2020-03-01", "2021-01-02"), (None, None, "2021-01-03")], [("2020-01-05", "entered"), ("2020-03-01", "detected"), ("2021-01-03", "upload_date")]),
    ([(None, None, "2021-01-01"), (None, "2022-01-01", "2021-01-02"), ("2020-06-01", None, "2021-01-03")], [("2020-05-30", "inferred"), ("2020-05-31", "inferred"), ("2020-06-01", "entered")]),
])
def test_dates_keep_the_order_of_a_batch(spark, given, want):
    rows = [(1, i, *r) for i, r in enumerate(given)]
    df = spark.createDataFrame(rows, "batch_id int, place int, entered string, stated string, uploaded_on string").withColumns({c: F.to_date(c) for c in ("entered", "stated", "uploaded_on")})
    assert [(str(r.effective_from), r.source) for r in batches.plan_dates(df).orderBy("place").collect()] == want


def test_bodies_of_pages_are_those_of_lines(spark):
    line = lambda text, size: (text, float(size), False)
    rows = [(1, 1, [line("abc", 10), line("de", 9)]), (1, 2, [line("fgh", 9), line("x", 10)]), (2, 1, [line("ab", 12), line("cd", 11)]), (3, 1, []), (4, 1, [line("a", 8)]), (4, 2, [line("bb", 8.5)])]
    pages = spark.createDataFrame(rows, "doc_id long, page int, lines array<struct<text:string,size:double,bold:boolean>>")
    with_body = structure.with_body(pages)
    assert "Join" not in with_body._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.doc_id, r.body) for r in with_body.collect()}
    lines = pages.selectExpr("doc_id", "inline(lines)")
    assert got - {(3, None)} == {(r.doc_id, r.body) for r in structure.body_size(lines).collect()} and (1, 9.0) in got and (2, 11.0) in got
    numbered = pages.selectExpr("doc_id", "page", "posexplode(lines) as (line_no, l)").selectExpr("doc_id", "page", "line_no", "l.*")
    joined = structure.classify_lines(numbered, structure.body_size(lines))
    inside = structure.classify_lines(with_body.selectExpr("doc_id", "page", "body", "posexplode(lines) as (line_no, l)").selectExpr("doc_id", "page", "line_no", "l.*", "body"))
    assert inside.columns == joined.columns and sorted(map(str, inside.collect())) == sorted(map(str, joined.collect()))
