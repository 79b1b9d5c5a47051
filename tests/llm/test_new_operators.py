"""Language model, runs of words and hard negatives against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from codicil.llm import hmm, queries, residues, runs

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# language model


def random_model(rng, states, classes):
    start, move, emit = rng.random(states) + 0.01, rng.random((states, states)) + 0.01, rng.random((classes, states)) + 0.01
    return hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def plain_counts(model, classes, lengths):
    """Likelihoods and expected counts of sequences, one entry after another."""
    states = len(model.start)
    sums, out, at = hmm.Sums(states, len(model.emit)), [], 0
    for n in lengths:
        c = classes[at : at + n]
        at += n
        alpha, beta = np.zeros((n, states)), np.ones((n, states))
        alpha[0] = model.start * model.emit[c[0]]
        for t in range(1, n):
            alpha[t] = alpha[t - 1] @ model.move * model.emit[c[t]]
        for t in range(n - 2, -1, -1):
            beta[t] = model.move @ (model.emit[c[t + 1]] * beta[t + 1])
        p = alpha[-1].sum()
        out.append(math.log10(p))
        gamma = alpha * beta / p
        sums.start += gamma[0]
        for t in range(n):
            sums.emit[c[t]] += gamma[t]
        for t in range(n - 1):
            sums.move += np.outer(alpha[t], model.emit[c[t + 1]] * beta[t + 1]) * model.move / p
    return np.array(out), sums


def test_recursion_equals_a_plain_one_at_any_cut(monkeypatch):
    rng = np.random.default_rng(0)
    model = random_model(rng, 4, 50)
    lengths = np.array([1, 5, 33, 2, 20, 21, 100, 1, 45])
    classes = rng.integers(0, 50, lengths.sum()).astype(np.int32)
    want, counts = plain_counts(model, classes, lengths)
    for limit, segment, group in ((2048, 1024, 1 << 19), (20, 7, 60), (1, 2, 1)):
        monkeypatch.setattr(hmm, "LIMIT", limit)
        monkeypatch.setattr(hmm, "SEGMENT", segment)
        monkeypatch.setattr(hmm, "GROUP", group)
        sums = hmm.Sums(4, 50)
        assert np.allclose(hmm.likelihoods(model, classes, lengths, sums), want, atol=1e-9)
        assert np.allclose(sums.emit, counts.emit) and np.allclose(sums.move, counts.move) and np.allclose(sums.start, counts.start)
        assert np.allclose(hmm.likelihoods(model, classes, lengths), want, atol=1e-9)


def test_a_long_sequence_does_not_underflow():
    rng = np.random.default_rng(1)
    model = random_model(rng, 3, 5000)
    classes = rng.integers(0, 5000, 60_000).astype(np.int32)
    one = hmm.likelihoods(model, classes, np.array([60_000]))[0]
    now, total = model.start * model.emit[classes[0]], 0.0
    for c in classes[1:]:
        total += math.log10(now.sum())
        now = now / now.sum() @ model.move * model.emit[c]
    assert abs(one - total - math.log10(now.sum())) < 1e-6


def plain_base(rows):
    """Per row: held out, tokens, known tokens, base score; and all training tokens."""
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    cut = lambda t: [w.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for w in WORD.findall(t or "")]
    tokens = [[("w", w) for w in cut(t)] + ["end"] for _, t in rows]
    counts = Counter(w for h, t in zip(held, tokens, strict=True) if not h for w in t)
    n, v = counts.total(), len(counts)
    score = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    return [(h, len(t), sum(w in counts for w in t), score(t)) for h, t in zip(held, tokens, strict=True)], n


def test_scores_of_the_query(spark):
    got = {r.doc_id: r for r in queries.op11_hmm(spark, DATA).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want, n = plain_base(rows)
    assert len(got) == len(rows)
    for (i, _), (held, tokens, known, base) in zip(rows, want, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, n) and abs(r.base_score - base) < 1e-6 * max(1, -base)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_odd_texts_have_defined_scores(spark):
    rows = [(1, "Über über A a"), (1, "Über über A a"), (2, None), (3, ""), (None, "x\ty\x0bz"), (4, " \n "), (9, "new words only"), (7, "word " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("piece", F.lit("clash")).withColumn("held", F.lit("clash"))
    settings = hmm.Settings(states=3, own=2, start_rounds=3, rounds=1)
    got = hmm.score_texts(df.repartition(3), settings).collect()
    want, n = plain_base(rows)
    key = lambda i, t: (i is not None, i or 0, t)
    found = sorted((key(r.doc_id, r.n_tokens), r.held_out, r.n_known, round(r.base_score, 4), r.train_tokens) for r in got)
    assert found == sorted((key(i, t), h, k, round(b, 4), n) for (i, _), (h, t, k, b) in zip(rows, want, strict=True))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got) and len({r.score for r in got if r.doc_id == 1}) == 1
    assert hmm.score_texts(df.limit(0), settings).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    alone = hmm.score_texts(spark.createDataFrame([(only, "a b")], "doc_id long, text string"), settings).first()
    assert (alone.held_out, alone.n_known, alone.train_tokens, alone.base_score) == (True, 0, 0, 0.0)


def test_class_probabilities_sum_to_one(spark):
    """Over the words of a small vocabulary and one unknown word of each ending, one-word texts and the empty one."""
    words = ["aa", "ab", "bca", "dca", "eca"]
    rows = [(i, " ".join(words[: 1 + i % 5])) for i in range(1, 60) if zlib.crc32(str(i).encode()) % 10]
    settings = hmm.Settings(states=2, own_classes=64, ending_classes=64, own=1000, start_rounds=2, rounds=1)
    asked = [next(k for k in range(n, n + 100_000, 977) if zlib.crc32(str(k).encode()) % 10 == 0) for n in range(1000, 1007)]
    texts = [*words, "zca", ""]
    got = {r.doc_id: r.score for r in hmm.score_texts(spark.createDataFrame(rows + list(zip(asked, texts, strict=True)), "doc_id long, text string"), settings).collect()}
    assert sum(10 ** got[i] for i in asked) < 1


# runs of words


def plain_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words):
    gone = {i for s, n, q in plain_runs(words) for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_runs_equal_plain_ones():
    rng = np.random.default_rng(5)
    for _ in range(150):
        docs = []
        for _ in range(rng.integers(1, 6)):
            n = int(rng.integers(0, 160))
            docs.append((
                lambda: rng.integers(0, 2, n), lambda: np.tile(rng.integers(0, 4, rng.integers(1, 30)), 8)[:n], lambda: np.zeros(n, int),
                lambda: np.concatenate([rng.integers(0, 50, 20), np.tile(rng.integers(0, 3, rng.integers(1, 20)), 5), rng.integers(0, 50, 9), np.tile(rng.integers(0, 3, rng.integers(1, 9)), 9)]),
            )[rng.integers(0, 4)]())
        sizes = np.array([len(d) for d in docs])
        edges = np.r_[0, np.cumsum(sizes)]
        got, drop = runs.runs_of(np.concatenate(docs).astype(np.int64), sizes)
        want = [(s + e, n, q) for d, e in zip(docs, edges, strict=False) for s, n, q in plain_runs(d.tolist())]
        assert [tuple(map(int, r)) for r in got] == want
        marks = np.zeros(edges[-1], bool)
        for s, n, q in want:
            marks[s + q : s + n] = True
        assert (marks == drop).all()


def test_grammar_derives_its_words():
    rng = np.random.default_rng(6)
    words, owner = np.tile(rng.integers(0, 5, 40), 5), np.repeat(np.arange(4), 50)
    g = runs.re_pair(words, owner)
    assert np.bincount(g.nodes).min() >= 1 and len(g.nodes) == len(words) - 4  # one tree for each text
    for node, place in zip(g.nodes, g.places, strict=True):
        a, n = g.first[node], g.size[node]
        assert (words[a : a + n] == words[place : place + n]).all() and owner[place] == owner[place + n - 1] and 0 < g.left[node] < n


def test_runs_of_odd_texts(spark):
    texts = [None, "", " \t\n ", "la " * 24, "la " * 23, "a b c d e f g h " * 3, "a b c d e f g h " * 3 + "x " + "y z " * 12, "é ü " * 20, "one two\nthree", "w " * 200_000, "A a " * 13]
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash")).withColumn("collapsed", F.lit("clash"))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(df.repartition(2)).collect())
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        found = plain_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        want.append((i is not None, i or 0, len(w), found, plain_collapse(w) if len(w) < 1000 else "w"))
    assert got == sorted(want)
    assert runs.find_runs(df.limit(0)).count() == 0


def test_query_of_runs_equals_brute_force(spark):
    got = {r.doc_id: tuple(r) for r in queries.op12_runs(spark, DATA).collect()}
    some = 0
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        w, h = WORD.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        if len(w) > 700:
            continue
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        found = plain_runs(w)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if found else (None, None, None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got[r.doc_id] == (r.doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha(lines), sha(plain_collapse(w)))
        some += bool(found)
    assert some > 5


# hard negatives


@pytest.mark.parametrize("scale", [1.0, 100.0, 1e15, 1e30])
def test_products_are_exact(scale):
    rng = np.random.default_rng(2)
    a, b = np.floor(rng.normal(size=(7, 70)) * 256 * scale), np.floor(rng.normal(size=(9, 70)) * 256 * scale)
    want = [[max(-residues.FAR, min(residues.FAR, sum(int(x) * int(y) for x, y in zip(p, q, strict=True)))) for q in b] for p in a]
    assert residues.products(a, b).tolist() == want


def plain_negatives(rows, anchors, label):
    scaled = {k: [math.floor(256 * x) for x in v] for k, (_, v) in enumerate(rows)}
    out = []
    for a in anchors:
        i, v = rows[a][0], scaled[a]
        scores = [(-sum(x * y for x, y in zip(v, scaled[k], strict=True)), rows[k][0], k) for k in range(len(rows)) if rows[k][0] != i]
        positives = sorted(s for s in scores if label[s[2]] == label[a])[:5]
        for ps, pid, _ in positives:
            fits = sorted(s for s in scores if label[s[2]] != label[a] and 80 * -ps <= 100 * -s[0] <= 100 * -ps)[:5]
            out += [(i, pid, k, s[1], -ps, -s[0]) for k, s in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(300)]
    label = [int(rng.integers(0, 3)) for _ in rows]
    table = [(i, v, c) for (i, v), c in zip(rows, label, strict=True)]
    odd = [(400, None, 1), (500, [1.0] * 6, None), (600, [float("nan")] * 6, 1), (700, [None] * 6, 1), (800, [1.0], 1), (900, [], 1), (None, [1.0] * 6, 1), (1000, [float("inf")] + [0.0] * 5, 2)]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("clash")).withColumn("h", F.lit("clash"))
    got = residues.hard_negatives(df, df.filter("vec_id % 20 = 0"), block_rows=64, block_anchors=8, slice_rows=3).collect()
    assert sorted(tuple(r) for r in got) == plain_negatives(rows, [i for i in range(300) if i % 20 == 0], label)
    assert residues.hard_negatives(df.limit(0), df.limit(0)).count() == 0


def test_hard_negatives_of_repeated_rows(spark):
    v, w = [1.0, 0.0], [0.9, 0.1]
    df = spark.createDataFrame([(0, v, 1), (0, v, 1), (5, v, 1), (5, v, 1), (6, w, 2), (6, w, 2), (7, v, 2)], "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in residues.hard_negatives(df, df.filter("vec_id = 0")).collect())
    first = [(0, 5, 1, 7, 65536, 65536), (0, 5, 2, 6, 65536, 58880), (0, 5, 3, 6, 65536, 58880)]
    assert got == sorted(first + first)  # the anchor counts once, its positive twice
