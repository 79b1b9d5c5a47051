"""Stages of the pipeline, each against a brute-force version over odd rows."""

import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_text_operators import brute_components, brute_repeats, odd_texts

import corpus_pipeline as p
from codicil.llm import mixing, queries, toxicity

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("score", "predicted", "held_out", "component_id", "root", "node", "keep_", "k", "runs", "kept", "epoch", "took_", "words_", "n_tokens", "take_tokens", "ids")


def odd_rows():
    texts = [*odd_texts(9, 60), (None, "a null id"), (None, None), (77, "same id, other text of some words"), (77, "same id, second text of some words"), (950, "long " * 60_000)]
    rows = [(i, t, ("en", "fr", None)[k % 3], f"src{k % 5}" if k % 7 else None, len(t or "")) for k, (i, t) in enumerate(texts)]
    return rows + rows[:5]


@pytest.fixture
def odd(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df


def texts_of(rows):
    return sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in rows)


def test_stages_take_an_empty_table(spark, odd):
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, odd.limit(0), DATA)
        assert out.columns == p.COLUMNS and out.count() == 0, name
    assert p.STAGES[-1][1](spark, odd.limit(0), DATA).count() == 0


def test_toxic_texts_go(spark, tmp_path, odd):
    rng = np.random.default_rng(1)
    words = lambda bad: " ".join(rng.choice(["table", "river", "green", "walk", "paper"], 30)) + (" vilescum rotten" if bad else "")
    marked = [(10_000 + i, words(i % 3 == 0), "en", "src0", 0) for i in range(400)]
    spark.createDataFrame([(r[0], int((r[0] - 10_000) % 3 == 0)) for r in marked], "doc_id long, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    docs = odd.select(*p.COLUMNS).unionByName(spark.createDataFrame(marked, SCHEMA))
    got = p.drop_toxic(spark, docs, str(tmp_path)).collect()
    assert texts_of(got) == texts_of([r for r in odd_rows() + marked if "vilescum" not in (r[1] or "")])
    scores = toxicity.toxicity(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    by_text = {}
    for r, t in zip(scores, docs.collect(), strict=True):
        by_text.setdefault(t.text or "", set()).add(r.score)
    assert all(len(v) == 1 for v in by_text.values()) and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scores)


def test_one_of_each_group_of_near_copies_stays(spark, odd):
    got = p.drop_near_copies(spark, odd, DATA).collect()
    rows = [(-1 if r[0] is None else r[0], r[1]) for r in odd_rows()]
    lowest = {}
    found = [(k, c) for k, _, c in brute_components([(k, t) for k, (_, t) in enumerate(rows)])]
    for k, c in found:
        lowest[c] = min(lowest.get(c, rows[k][0]), rows[k][0])
    assert texts_of(got) == sorted({(rows[k][0], rows[k][1] or "") for k, c in found if rows[k][0] == lowest[c]})


def test_repeats_go_from_texts(spark, odd):
    rows = [r for r in odd_rows() if r[0] is not None and r[0] != 77][:-5]  # ids of their own; ties are tested with the operator
    docs = odd.filter("doc_id <> 77").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in p.drop_repeats(spark, docs, DATA).collect()}
    own = {r[0]: r for r in rows}
    want = {i: (n, gone) for i, n, gone, *_ in brute_repeats([(i, r[1]) for i, r in own.items()])}
    assert set(got) == {i for i, (n, gone) in want.items() if gone == 0 or gone < n}
    for i, r in got.items():
        n, gone = want[i]
        assert r.n_chars == len(r.text) and (r.text == (own[i][1] or "") if gone == 0 else len(r.text.encode()) <= n - gone)


def test_mixed_texts_are_token_prefixes(spark, odd):
    got = p.mix_sources(spark, odd, DATA).collect()
    chosen = mixing.mix(odd.select(*p.COLUMNS), mixing.document_tree(), mixing.DOCUMENT_WEIGHTS, percent=100, max_epochs=2, seed=7).collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in got) == sum(r.take_tokens for r in chosen)
    texts = {}
    for r in odd_rows():
        texts.setdefault(r[0], []).append(r[1] or "")
    assert got and all(any(t == r.text or t.startswith(r.text) for t in texts[r.doc_id]) and r.n_chars == len(r.text) for r in got)
    assert any(r.take_tokens < r.n_tokens for r in chosen)


def test_encoded_ids_equal_the_librarys(spark, odd):
    got = p.encode(spark, odd, DATA).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=queries.public_file("piece_bpe_32k.model", "PIECE_MODEL"))
    want = sorted((-1 if r[0] is None else r[0], model.encode(r[1] or "")) for r in odd_rows())
    assert sorted((-1 if r.doc_id is None else r.doc_id, list(r.ids)) for r in got) == want


def test_run_writes_each_stage_for_the_next(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = p.run(spark, DATA)
    assert 0 < out.count() <= 2 * docs.count() and out.filter("not round_trip").count() == 0 and out.filter("size(ids) <> n_tokens").count() == 0


def test_repeats_stage_cuts_characters_whole_and_leaves_the_rest(spark):
    again = "é漢" * 30 + "z"
    texts = ["a\ufffdb", "\ufffd" + again + "é", "\ufffdé" + again + "è\ufffd", "", again[1:101]]
    docs = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in p.drop_repeats(spark, docs, DATA).collect()}
    first = texts[1].encode()
    want = {}
    for i in (0, 1, 2, 3):
        data, gone, before = texts[i].encode(), set(), texts[1].encode() if i == 2 else b""
        for k in range(len(data) - 99):
            seen = data[k : k + 100]
            if seen in before or data.find(seen) < k:
                gone |= set(range(k, k + 100))
        at, out = 0, ""
        for c in texts[i]:
            out += "" if gone & set(range(at, at + len(c.encode()))) else c
            at += len(c.encode())
        want[i] = (out, len(out))
    assert want[0] == ("a\ufffdb", 3) and "\ufffd" in want[2][0] and len(first) > 100
    assert got == want


def test_scores_equal_a_plain_version(monkeypatch):
    import math

    import pyarrow as pa

    s = toxicity.Settings(buckets=1 << 10)
    odds = np.random.default_rng(3).normal(0, 1, s.buckets).astype(np.float32)
    texts = [None, "", " ?! ", "one", "Ä é one ONE one two", " ".join(f"w{i % 37} x{i % 5}" for i in range(500)), "tie tie. tie", "x" * 3000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text_"])
    want = []
    for t in texts:
        words = [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
        words = [w for k, w in enumerate(words) if k == 0 or w != words[k - 1]]
        values = []
        for k in range(0, len(words), s.window):
            feats = [toxicity.word_features([w], s.buckets)[0] for w in words[k : k + s.window]]
            total = sum(float(odds[f].astype(np.float64).sum()) for f in feats)
            values.append(total / max(sum(map(len, feats)), 12 * s.window) + 0.25)
        z = max(values, default=0.25)
        want.append(1 / (1 + math.exp(-(z - 1.5 + math.log(0.7 / 0.3)))))
    for size in (10**9, 40):
        monkeypatch.setattr(toxicity, "CHUNK", size)
        got = [x for b in toxicity.score_batches(iter([batch]), odds, 0.25, 1.5, s) for x in b.column(1).to_pylist()]
        assert np.allclose(got, want, atol=1e-6)
