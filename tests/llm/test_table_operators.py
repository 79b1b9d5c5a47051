"""Dealt operators over vectors, metadata and mixtures."""

import itertools
import math
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from codicil.llm import hilbert, mixing, permutation, queries

DATA = "/root/testdata/sf0.001"


def test_search_recall_and_order(spark):
    got = queries.op4_permutation(spark, DATA).toPandas()
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(np.float64)
    hits = total = 0
    for q, part in got.groupby("query_id"):
        score = (x * x[ids == q][0]).sum(1)
        order = np.lexsort((ids, -score))
        want = ids[order][ids[order] != q][:20]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and (np.diff(part["score"]) <= 0).all()
        hits, total = hits + len(set(want) & set(part["vec_id"])), total + 20
    assert set(got["query_id"]) == set(ids[ids % 20 == 0]) and hits / total >= 0.9


def test_search_leaves_out_unusable_vectors_and_breaks_ties(spark):
    rows = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [2.0, 0.0]), (1, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (20, [0.0, 1.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = permutation.nearest(df, df.filter("vec_id % 20 = 0"), pivots=2, length=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 2, 2.0), (0, 2, 3, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 2, 0.0), (20, 3, 3, 0.0)]
    assert permutation.nearest(df.limit(0), df.limit(0)).count() == 0


def test_search_defines_repeated_ids_and_other_lengths(spark):
    rows = [(i, [float(i % 7 + 1), 1.0]) for i in range(30)] + [(0, [1.0, 5.0]), (0, [1.0, 5.0]), (50, [9.0]), (60, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    got = permutation.nearest(df, df.filter("vec_id in (0, 20, 50)"), k=3).collect()
    of = lambda q: sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
    assert of(50) == [] and {r.vec_id for r in got}.isdisjoint({50, 60})
    best = lambda v, own: sorted((-(a * v[0] + b * v[1]), i) for i, (a, b) in rows[:32] if i != own)[:3]
    want = lambda v, own: [(k, i, -s) for k, (s, i) in enumerate(best(v, own), 1)]
    assert of(20) == want((7.0, 1.0), 20) and of(0) == sorted(want((1.0, 1.0), 0) + want((1.0, 5.0), 0))


def test_hilbert_index_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 2)):
        grid = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=n)), [f"x{i}" for i in range(n)])
        rows = grid.withColumn("h", hilbert.hilbert_index([F.col(f"x{i}") for i in range(n)], bits)).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(1 << bits * n))
        assert all(sum(abs(a[i] - b[i]) for i in range(n)) == 1 for a, b in itertools.pairwise(rows))


def test_shards_keep_their_law(spark):
    rows = [(i, None if i % 50 == 0 else ("copy" if i % 3 == 0 else f"text {i}" * (i % 7)), "en" if i % 2 else None, f"src{i % 4}") for i in range(500)]
    df = spark.createDataFrame(rows + [(1, "again", "en", "src1")], "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("clash"))
    got = hilbert.shard_by_curve(df, 24, hilbert.document_dimensions()).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 501 and sizes.max() - sizes.min() <= 1 and set(got["shard"]) == set(range(24))
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    copies = got[got["size"] == 8 + len("copy")]["shard"]
    assert copies.nunique() <= math.ceil(len(copies) / sizes.min()) + 1
    assert hilbert.shard_by_curve(df.limit(0), 24, hilbert.document_dimensions()).count() == 0


def plain_curve(cells, bits):
    """Position of a point on the Hilbert curve, one bit plane after another."""
    x, n = list(cells), len(cells)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        if x[-1] & q:
            t ^= q - 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out * 2 + (((v ^ t) >> b) & 1)
    return out


def test_shards_equal_a_plain_version(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i == 7 else i % 290, None if i % 41 == 0 else "word é " * int(rng.integers(0, 60)) if i % 3 else "copy", ("en", "fr", None)[i % 3], f"src{i % 5}" if i % 11 else None) for i in range(300)]
    rows += rows[:9] + [(5000, "long " * 100_000, "en", "src1"), (5001, "", "", "")]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    for name in ("n_", "hot_", "warm_", "rep_", "key_", "cell_", "part_", "at_", "row_", "id_", "rank_"):
        df = df.withColumn(name, F.lit("clash"))
    got = hilbert.shard_by_curve(df.repartition(3), 24, hilbert.document_dimensions())
    assert {"n_", "hot_", "row_"} <= set(got.columns) and "text" not in got.columns
    hashed = lambda t: 42 if t is None else xxhash.xxh64((t or "").encode(), seed=42).intdigest()
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    items = []
    for i, t, lang, source in rows:
        size = len((t or "").encode())
        cells = (signed(hashed(lang)) % 64, signed(hashed(source)) % 64, min(63, math.floor(math.log(size + 1) / math.log(2) * 3)))
        items.append([signed(hashed(t or "")), -1 if i is None else i, cells, size + 8, zlib.crc32((t or "").encode()), t or ""])
    first = {}
    for key, i, cells, *_ in items:
        first[key] = min(first.get(key, (i, cells)), (i, cells))
    placed = sorted((plain_curve(first[key][1], 6), key, i, size, crc) for key, i, _, size, crc, _ in items)
    n = len(placed)
    want = []
    for rank, (curve, _, i, size, crc) in enumerate(placed):
        shard = rank * 24 // n
        want.append((i, size, crc, curve, "rows", shard, rank - (shard * n + 23) // 24, None))
    rows_of = lambda out: sorted(tuple(r) for r in out)
    names = ("size", "text_crc32", "curve", "law", "shard", "slot", "grown_shard")
    assert rows_of((-1 if r.doc_id is None else r.doc_id, *(r[c] for c in names)) for r in got.collect()) == rows_of(want)


def share(budget, items):
    """Plain water filling of [(name, weight, capacity)]."""
    got, left = {}, list(items)
    while left:
        total = sum(w for _, w, _ in left)
        full = [x for x in left if x[2] * total <= budget * x[1]]
        if not full:
            got |= {n: budget * w / total for n, w, _ in left}
            break
        for n, _, c in full:
            got[n] = c
            budget -= c
        left = [x for x in left if x not in full]
    return got


def test_budgets_go_to_siblings_before_ancestors(spark):
    docs = [(i, " ".join(["w"] * (1 + i % 13)), ("en", "fr", "de")[i % 3], f"src{i % 11}") for i in range(400)] + [(900, None, "en", "src0"), (901, "", None, None), (1, "a b", "en", "src0")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, mixing.document_tree(), mixing.DOCUMENT_WEIGHTS, percent=150, max_epochs=3, seed=1).toPandas()
    leaf = {}
    for _, t, lang, source in docs:
        n = len((t or "").split())
        k = int(source[3:]) % 4 if source else 9
        key = ({0: "web", 1: "books", 2: "code"}.get(k, "reference"), lang or "", source or "")
        if n:
            leaf[key] = leaf.get(key, 0) + 3 * n
    weight = lambda level, name: mixing.DOCUMENT_WEIGHTS[level].get(name, mixing.OTHER_WEIGHT)
    cap = lambda *p: sum(c for k, c in leaf.items() if k[: len(p)] == p)
    total = sum(leaf.values()) // 3 * 150 // 100
    want = {}
    for d, b in share(total, [(d, weight("domain", d), cap(d)) for d in sorted({k[0] for k in leaf})]).items():
        for lang, c in share(b, [(x, weight("language", x), cap(d, x)) for x in sorted({k[1] for k in leaf if k[0] == d})]).items():
            want |= {(d, lang, o): v for o, v in share(c, [(o, weight("origin", o), cap(d, lang, o)) for o in sorted({k[2] for k in leaf if k[:2] == (d, lang)})]).items()}
    took = got.groupby(["domain", "language", "origin"])["take_tokens"].sum().to_dict()
    assert sum(took.values()) == total
    assert all(abs(took.get(k, 0) - v) <= 3 for k, v in want.items())
    assert (got["take_tokens"] <= got["n_tokens"]).all() and not got.duplicated(["doc_id", "epoch", "origin", "n_tokens"]).any()
    assert mixing.mix(df.limit(0), mixing.document_tree(), mixing.DOCUMENT_WEIGHTS, 100, 2, 1).count() == 0
