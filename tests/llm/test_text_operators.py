"""Dealt operators over texts against brute force, with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codicil.llm import imatch, jaccard_join, pieces, queries, rans, repeats, toxicity, url_filter
from codicil.llm.components import components
from codicil.llm.tokens import encoder

SCHEMA = "doc_id long, text string"
DATA = "/root/testdata/sf0.001"


def odd_texts(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 8, 30, 90]))] for _ in range(15)]
    rows = []
    for i in range(n):
        b = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((i, " ".join(b)))
    return rows + [(900, None), (901, " \n"), (902, "A b"), (903, "a B"), (904, "a b c"), (905, ""), (906, "x" * 3000), (907, "é ß 漢字 " * 200)]


# --- n-gram Jaccard join


def word_sets(rows):
    lower = {i: i + 32 for i in range(65, 91)}
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_components(rows):
    sets = word_sets(rows)
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def test_jaccard_components_equal_all_pairs(spark):
    rows = odd_texts(5)
    got = jaccard_join.similarity_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == brute_components(rows)


def test_jaccard_join_reads_no_sets_that_meet_by_chance_and_keeps_every_linked_pair(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    texts = [[str(w) for w in rng.choice(words, 300)] for _ in range(12)]
    texts += [t[:k] + ["new"] + t[k:] for t in texts[:6] for k in (0, 150)]  # near copies
    texts += [t[:240] for t in texts[:3]]  # four fifths of another
    line = [f"line{i}" for i in range(6)]
    texts = [[*t, *line] for t in texts]  # all share two shingles
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([" ".join(t) for t in texts])], names=["doc_id", "text"])
    sets = pa.Table.from_batches(list(jaccard_join.describe(iter([batch]), np.zeros(0, np.int64)))).to_pylist()
    shared = spark.createDataFrame([(t, r["doc_id"], r["n"]) for r in sets for t in r["prefix"]], "token long, node long, n long")
    pairs = spark.createDataFrame([(a, b) for b in range(len(texts)) for a in range(b)], "a long, b long")
    kept = {tuple(r) for r in jaccard_join.sharing(pairs, jaccard_join.shared_elements(shared)).collect()}
    shingles = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    linked = {(a, b) for b in range(len(texts)) for a in range(b) if 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])}
    assert len(linked) >= 18 and linked <= kept and len(kept) < 2 * len(linked)


def test_jaccard_join_tests_some_routes_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "VALUES", 50)
    seen = []
    spied = jaccard_join.held_by_centers
    monkeypatch.setattr(jaccard_join, "held_by_centers", lambda route, *more: seen.append(len(route)) or spied(route, *more))
    row = lambda n: bytes([0] * n) + bytes(range(n))
    rows = [(i % 10, 100 + i % 10, 100 + i % 10 if i < 10 else i, 20, row(20)) for i in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["route", "center", "node", "n", "fine"])
    got = sorted((a, b) for out in jaccard_join.closer(iter([batch])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    assert got == sorted((100 + i % 10, i) for i in range(10, 30)) and len(seen) > 5


def test_jaccard_join_takes_empty_tables_null_ids_and_repeated_rows(spark):
    assert jaccard_join.similarity_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)]
    got = sorted((tuple(r) for r in jaccard_join.similarity_components(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, None), (3, 2, None), (4, 0, 4)], key=str)


def test_r_tree_leaves_out_only_what_the_bound_excludes():
    rng = np.random.default_rng(2)
    counts = rng.poisson(2, (200, jaccard_join.GROUPS)).astype(np.uint16)
    counts[100:] = counts[:100]
    counts[150:, 3] += 1
    sizes = counts.sum(1).astype(np.int64)
    q, p = jaccard_join.RTree(counts, sizes).pairs(counts, sizes)  # at any number of coordinates
    least = jaccard_join.least_overlap(sizes[:, None], sizes[None, :])
    want = np.minimum(counts[:, None], counts[None]).sum(2) >= least
    assert {*zip(q.tolist(), p.tolist(), strict=True)} == {*map(tuple, np.argwhere(want).tolist())}


def test_blocks_in_slices_lose_no_pair():
    rng = np.random.default_rng(3)
    n = 60
    counts = np.repeat(rng.poisson(3, (6, jaccard_join.GROUPS)), 10, axis=0).astype(np.uint16)
    sizes, node = counts.sum(1).astype(np.int64), np.arange(n)
    mine = node % 3
    rows = [(i * 10 + j, 2 if i == j else (0 if m == i else 1), x) for x, m in zip(node, mine, strict=True) for j_ in range(3) for i, j in [(min(m, j_), max(m, j_))]]
    route, side, who = (np.array(c) for c in zip(*rows, strict=True))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(route), pa.array(side), pa.array(who), pa.array(sizes[who]), pa.array(who), pa.array([counts[x].tobytes() for x in who], pa.binary())], names=["route", "side", "node", "n", "root", "counts"]
    )
    got = {(a, b) for out in jaccard_join.join_blocks(iter([batch])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
    least = jaccard_join.least_overlap(sizes[:, None], sizes[None, :])
    want = {(a, b) for a, b in np.argwhere(np.minimum(counts[:, None], counts[None]).sum(2) >= least).tolist() if a < b}
    assert want and got == want


@pytest.mark.parametrize("most", [17_188, 70_000])
def test_counts_of_huge_sets_do_not_wrap(most):
    counts = np.full((3, jaccard_join.GROUPS), most, np.int64)
    assert (jaccard_join.coarse(counts) == 4 * most).all()
    rows = pa.array([jaccard_join.narrow(c).tobytes() for c in [*counts, counts[0] // most]], pa.binary())
    assert jaccard_join.vectors(rows).tolist() == [*counts.tolist(), [1] * jaccard_join.GROUPS]
    sizes, node = counts.sum(1), np.arange(3)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (node * 0, node * 0 + 2, node, sizes, node)] + [rows.slice(0, 3)], names=["route", "side", "node", "n", "root", "counts"])
    got = {(a, b) for out in jaccard_join.join_blocks(iter([batch])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)}
    assert got == {(0, 1), (0, 2), (1, 2)}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 160)}}


@pytest.fixture
def many_partitions(spark):
    own = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_components_that_still_change_are_no_result(spark, many_partitions):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long").repartition(8)
    with pytest.raises(RuntimeError):
        components(links, rounds=0)


def test_components_of_random_links_over_many_partitions(spark, many_partitions):
    rng = np.random.default_rng(4)
    links = np.concatenate([rng.integers(0, 3000, (1400, 2)), np.column_stack([np.full(300, 5000), rng.integers(5001, 6000, 300)]), np.column_stack([np.arange(7000, 7400), np.arange(7001, 7401)])])
    want = {}
    for a, b in links.tolist():
        want.setdefault(a, {a}), want.setdefault(b, {b})
        if want[a] is not want[b]:
            want[a] |= want[b]
            for k in list(want[a]):
                want[k] = want[a]
    rows = [tuple(r) for r in links.tolist()]
    got = components(spark.createDataFrame(rows + [(r[1], r[0]) for r in rows[:50]], "a long, b long").repartition(24)).collect()
    linked = {k for r in rows if r[0] != r[1] for k in r}
    assert sorted((r.node, r.root) for r in got) == sorted((k, min(want[k])) for k in linked)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repeated passages


def brute_repeats(rows, size=100):
    seen, out = set(), []
    for i, t in sorted(rows):
        d = (t or "").encode()
        covered = np.zeros(len(d), bool)
        for s in range(len(d) - size + 1):
            if d[s : s + size] in seen:
                covered[s : s + size] = True
            seen.add(d[s : s + size])
        kept = np.frombuffer(d, np.uint8)[~covered].tobytes()
        spans = int((covered & ~np.r_[False, covered[:-1]]).sum()) if len(d) else 0
        out.append((i, len(d), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeated_texts(n=200):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    part = lambda: rng.choice([base[(a := rng.randrange(2800)) : a + rng.randrange(20, 300)], "xy" * rng.randrange(80), "z" * rng.randrange(200), str(rng.random())])
    return [(i, "".join(part() for _ in range(rng.randrange(6)))) for i in range(n)] + [(1000, None), (1001, ""), (1002, base), (1003, base * 2), (1004, "é" * 120)]


def test_removed_bytes_equal_brute_force(spark):
    rows = repeated_texts()
    got = repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(tuple(r) for r in got) == brute_repeats(rows)


def test_hot_buckets_take_another_way_to_the_same_passages(monkeypatch):
    monkeypatch.setattr(repeats, "SHARE", 2)
    rows = [(i, t or "") for i, t in repeated_texts(80)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[0] for r in part]), pa.array([0] * len(part), pa.int32()), pa.array([r[1] for r in part])], names=["doc_id", "k", "text"])
    removed = {}
    for hot in (1, 10**9):
        monkeypatch.setattr(repeats, "HOT", hot)
        found = [b for part in (rows[::3], rows[1::3], rows[2::3]) for b in repeats.find_groups(iter([batch(part)]))]
        judged = pa.Table.from_batches(list(repeats.judge_groups(iter(found)))).to_pandas()
        left = judged[judged.kind == repeats.OPEN]
        n = left.groupby("gram").size()
        texts = dict(rows)
        groups = [[{"lo": r.lo, "hi": r.hi, "gram": r.gram, "n": int(n[r.gram])} for r in g.itertuples()] for _, g in left.groupby("doc_id")]
        ids = [int(i) for i, _ in left.groupby("doc_id")]
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("gram", pa.int64()), ("n", pa.int64())]))
        cut = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([0] * len(ids), pa.int32()), pa.array([texts[i] for i in ids]), pa.array(groups, kind)], names=["doc_id", "k", "text", "groups"])
        out = pa.Table.from_batches(list(repeats.judge_passages(repeats.cut_passages(iter([cut]))))).to_pandas()
        removed[hot] = {(r.doc_id, s) for r in [*out.itertuples(), *judged[judged.kind == repeats.KNOWN].itertuples()] for s in range(r.lo, r.hi + 1)}
    seen, want = set(), set()
    for i, t in sorted(rows):
        for s in range(len(t.encode()) - 99):
            w = t.encode()[s : s + 100]
            want |= {(i, s)} if w in seen else set()
            seen.add(w)
    assert removed[1] == removed[10**9] == want


def test_long_texts_are_cut_into_stretches(spark, monkeypatch):
    rows = [(i, t or "") for i, t in repeated_texts(40)]
    rows += [(2000, "".join(t for _, t in rows)), (2001, "")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([0] * len(rows), pa.int32()), pa.array([r[1] for r in rows])], names=["doc_id", "k", "text"])
    monkeypatch.setattr(repeats, "CHUNK", 400)
    passages = {(i + k, at + s, t.encode()[at + s : at + s + 100]) for i, at, part in repeats.stretches([t.encode() for _, t in rows]) for k, x in enumerate(part) for s in range(len(x) - 99) for t in [rows[i + k][1]]}
    assert passages == {(i, s, t.encode()[s : s + 100]) for i, (_, t) in enumerate(rows) for s in range(len(t.encode()) - 99)}
    groups = pa.Table.from_batches(list(repeats.find_groups(iter([batch])))).to_pandas()
    starts = sorted((r.doc_id, s) for r in groups.itertuples() for s in range(r.lo, r.hi + 1))
    assert starts == sorted((rows[i][0], s) for i, s, _ in passages)  # each passage in one group


def test_buckets_are_refined_and_bytes_compared(monkeypatch):
    rng = np.random.default_rng(8)
    data = np.concatenate([rng.integers(97, 99, 900), np.full(300, 99), rng.integers(97, 99, 20)]).astype(np.uint8)
    data = np.concatenate([data, data[100:700], data[850:1100]])
    at = np.arange(len(data) - 99)
    seen, want = set(), []
    for i in at:
        want.append(data[i : i + 100].tobytes() in seen)
        seen.add(data[i : i + 100].tobytes())
    assert repeats.repeated(data, at, at).tolist() == want
    monkeypatch.setattr(repeats, "first_buckets", lambda d: (d > 98).astype(np.uint64))  # q-grams that share their hash
    assert repeats.repeated(data, at, at).tolist() == want


def test_digests_tell_bytes_apart():
    data = np.frombuffer(bytes(range(200)) * 2 + b"x", np.uint8).copy()
    begin, end = np.array([0, 200, 0, 1, 0]), np.array([150, 350, 151, 151, 200])
    first = repeats.digests(data, begin, end)
    assert first[0] == first[1] and len(set(first.tolist())) == 4
    data[149] ^= 1
    assert repeats.digests(data, begin, end)[0] not in first.tolist()


def test_repeats_take_clashing_columns(spark):
    rows = [(1, "a" * 120, "x"), (2, "b" * 120, None)]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string")
    for name in ("k", "runs", "groups", "gram", "n"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = repeats.remove_repeats(docs, carry=["lang"]).collect()
    assert sorted((r.doc_id, r.n_removed, r.lang) for r in got) == [(1, 119, "x"), (2, 119, None)]


def test_repeats_take_empty_tables_null_ids_and_shared_ids(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "q" * 150), (7, "r" * 99 + "t" * 60), (7, "r" * 99 + "t" * 60), (7, "other"), (8, "r" * 99 + "t" * 60)]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 150, 149), (7, 5, 0), (7, 159, 0), (7, 159, 0), (8, 159, 159)]


# --- token ids in blocks


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000, 70000])
def test_blocks_decode_to_their_ids(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 5000).astype(np.int64)
    table = rans.Table(np.bincount(ids))
    block = rans.encode_block(ids, table)
    assert (rans.decode_block(block, table) == ids).all()
    assert (rans.decode_block(block, table, n // 3, n // 2) == ids[n // 3 : n // 2]).all()
    assert (rans.decode_block(block, table, n - 1) == ids[n - 1 :]).all()
    with pytest.raises(ValueError):
        rans.decode_block(block[:-1] + bytes([block[-1] ^ 1]), table)


def test_files_hold_the_tokenizers_ids(spark):
    rows = odd_texts(1, 60) + [(None, "null id"), (5, "repeated id")]
    tokenizer = encoder(queries.public_file("byte_bpe_50k.json", "BYTE_TOKENIZER")).tokenizer
    got = rans.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3), queries.public_file("byte_bpe_50k.json", "BYTE_TOKENIZER")).collect()
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert rans.round_trip(spark.createDataFrame([], SCHEMA), queries.public_file("byte_bpe_50k.json", "BYTE_TOKENIZER")).count() == 0


@pytest.mark.parametrize("text", ["", "  a  b", "\n\nx \n y", "don't we'll 's", "a.b,c!! ??x", "é è\u00a0x\u2003y", "<|endoftext|> a", "a\r\n b\t\tc", "trail ", "1,000.5 a1b2", "(a) [b]\n- d\n", "日本語 です。 x"])
def test_pieces_of_texts_encode_as_the_whole(text):
    coder = encoder(queries.public_file("byte_bpe_50k.json", "BYTE_TOKENIZER"))
    ids, edges = coder.encode([text, text])
    want = coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert ids[: edges[1]].tolist() == want and ids[edges[1] :].tolist() == want


def test_added_tokens_in_texts_are_one_id(spark):
    from tokenizers import Tokenizer

    path = queries.public_file("byte_bpe_50k.json", "BYTE_TOKENIZER")
    plain = Tokenizer.from_file(path)
    texts = ["<|endoftext|> a", "", "x <|endoftext|>", "<|endoftext|><|endoftext|>b.c\n<|endoftext|>\nd <|endoftext|>  e", "<|endoftext>|", "<<|endoftext|>", "é<|endoftext|>漢字 "]
    assert plain.encode(texts[0], add_special_tokens=False).ids == [50256, 257]
    ids, edges = encoder(path).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    at, want = 0, []
    for i, t in enumerate(texts):
        own = plain.encode(t, add_special_tokens=False).ids + [2]
        want.append((i, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    got = rans.round_trip(spark.createDataFrame(list(enumerate(texts)), SCHEMA), path).collect()
    assert sorted(tuple(r) for r in got) == want


# --- piece Viterbi


def test_ids_equal_the_librarys():
    import sentencepiece

    path = queries.public_file("piece_bpe_32k.model", "PIECE_MODEL")
    p, model = pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(2)
    names = [model.id_to_piece(i).replace("▁", " ") for i in range(259, model.get_piece_size())]
    signs = list("ab et\n\tA.1é中☃▁\u0301\u2003") + ["  ", "ing", "😀"]
    texts = ["", " ", "hello world", " two  spaces", "naïve ☃ snow\nline", "unbelievable▁x", *("a" * n for n in range(1, 40)), *(" " * n for n in range(1, 40)), "x" * 5000]
    texts += ["".join(names[i] for i in rng.integers(0, len(names), rng.integers(1, 7))) for _ in range(3000)]
    texts += ["".join(signs[i] for i in rng.integers(0, len(signs), rng.integers(1, 30))) for _ in range(2000)]
    ids, edges = pieces.encode(texts, p)
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == model.encode(texts)
    assert pieces.decode(ids, edges, p) == [t.replace("▁", " ") for t in texts]


def test_a_word_longer_than_a_stretch_and_more_pairs_than_are_kept(monkeypatch):
    import sentencepiece

    path = queries.public_file("piece_bpe_32k.model", "PIECE_MODEL")
    monkeypatch.setattr(pieces, "STRETCH", 7)
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    p = pieces.load.__wrapped__(path)
    text = "".join(np.random.default_rng(1).choice(list("abcdefst"), 700))
    assert pieces.encode([text, text[:30]], p)[0].tolist() == [i for r in sentencepiece.SentencePieceProcessor(model_file=path).encode([text, text[:30]]) for i in r]


def test_best_paths_of_summed_scores_equal_a_plain_search():
    p = pieces.load.__wrapped__(queries.public_file("piece_bpe_32k.model", "PIECE_MODEL"))
    p.merges, p.scores = None, -np.log(10.0 - p.scores)  # as a unigram model would have them
    score = {bytes(p.raw[int(i)].as_py()).decode(): float(s) for i, s in zip(p.ids, p.scores, strict=True)}
    for text in ["hello world", " two  spaces", "naïve ☃ snow\nline", "a" * 40]:
        marked = " " + text
        best = [0.0] + [-1e18] * len(marked)
        for end in range(1, len(marked) + 1):
            for start in range(max(0, end - p.longest), end):
                worth = score.get(marked[start:end], p.unknown if end - start == 1 else None)
                if worth is not None:
                    best[end] = max(best[end], best[start] + worth)
        ids, edges = pieces.encode([text], p)
        spelled = [i for i in ids.tolist() if p.first_byte <= i < p.first_byte + 256]
        lone = len(bytes(i - p.first_byte for i in spelled).decode())
        got = sum(float(p.scores[np.flatnonzero(p.ids == i)[0]]) for i in ids.tolist() if i not in spelled) + lone * p.unknown
        assert abs(got - best[-1]) < 1e-6 and pieces.decode(ids, edges, p) == [text]


def test_pieces_round_trip(spark):
    rows = odd_texts(2, 40) + [(None, "x"), (1, "again")]
    got = pieces.round_trip(spark.createDataFrame(rows, SCHEMA), queries.public_file("piece_bpe_32k.model", "PIECE_MODEL")).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (900, 905)} == {0}
    assert pieces.round_trip(spark.createDataFrame([], SCHEMA), queries.public_file("piece_bpe_32k.model", "PIECE_MODEL")).count() == 0


# --- I-Match


def test_prints_and_edits(spark):
    rows = sorted(odd_texts(4, 80), key=lambda r: r[0])
    got = {r.doc_id: r for r in imatch.fingerprint_with_edits(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    texts = [t or "" for _, t in rows]
    same = collections.defaultdict(set)
    for k, (i, _) in enumerate(rows):
        t, following = texts[k], texts[(k + 1) % len(rows)]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        same[t].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and (r.near_edited == 1 or t != edited)
    assert all(len(v) == 1 for v in same.values())
    assert imatch.fingerprint_with_edits(spark.createDataFrame([], SCHEMA)).count() == 0


# --- toxicity


def test_held_out_insults_are_found(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        bad = i % 4 == 0
        for _ in range(3 if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["idiot", "moron", "idiots", "m0ron", "scumbag"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    got = toxicity.toxicity(spark.createDataFrame(rows + [(1000, None), (1001, "")], SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 602
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert held and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.9 * len(held)
    assert all((r.predicted == 1) == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(spark.createDataFrame(rows[:5], SCHEMA), none).collect()} == {0}


def test_a_long_labelled_text_does_not_end_the_sample(spark):
    order = sorted(range(400), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    own = [i for i in order if zlib.crc32(str(i).encode()) % 3 != 1]
    toxic = {*own[1:200:4]}
    rows = [(i, "word " * (2000 if i == own[2] else 4)) for i in range(400)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i in toxic)) for i in range(400)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, toxicity.Settings(sample_chars=8000)).collect()
    assert len(rows) == len(own) - 1 and sum(r.toxic for r in rows) == len(toxic)
    rows = toxicity.sample(docs, labels, toxicity.Settings(sample_chars=1000)).collect()
    assert sum(len(r.text) for r in rows) <= 1000 and sum(r.toxic for r in rows) == 25 and len(rows) == 50
    assert toxicity.fitting([50, 30, 5], [1, 1, 0], 20) == [1, 2]


# --- url rules


def test_urls_meet_the_longest_rule(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    urls = [None, "", "no scheme", "http://COM/", "http://com", "http://a.Example.com/en/x?y", "http://www.example.com/en/", "http://x.www.example.com/en", "https://notexample.com/en/", "ftp://net/es/#f", "http://a.b.net/fr/1", "http://q.net/en/", "http://é.com/ü", "x://h/" + "p/" * 3000]
    pages = spark.createDataFrame([(i % 9, u) for i, u in enumerate(urls)] + [(0, "http://com/")] * 2, "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = url_filter.judge_urls(pages, rules).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        u = r.url or ""
        rest = u[u.index("://") + 3 :] if "://" in u else None
        host = re.match(r"[^/?#]*", rest)[0] if rest is not None else ""
        path = re.match(r"[^?#]*", rest[len(host) :])[0] if rest is not None else ""
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h) + len(p), len(h), v, h + p) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, "allow", None))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[3], best[2])
    empty = url_filter.judge_urls(pages, rules.limit(0)).collect()
    assert {(r.rule, r.verdict) for r in empty} == {(None, "allow")}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
