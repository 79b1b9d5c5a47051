"""Toxicity: bags of subword embeddings, averaged over windows of words, under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.llm.common import stored, tidy
from codicil.llm.words import by_length, distinct_words, mix64, slices

CHUNK = 6_000_000  # bytes of text scored at a time, or one text

#: What parts words: anything but letters and digits.
BETWEEN = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample the model is fitted on, and the model's shape.

    The fit takes at most `toxic_rows` and `clean_rows` labelled documents, first by md5 of doc_id, and of these, label by
    label, those that fit into `sample_chars` characters together; everything else covers all rows.
    """

    toxic_rows: int = 1200
    clean_rows: int = 2000
    sample_chars: int = 12_000_000
    buckets: int = 1 << 18
    dim: int = 6
    window: int = 12
    least: int = 3
    steps: int = 100
    decay: float = 0.02
    rate: float = 0.1
    cut: float = 0.7
    seed: int = 11


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of each word (itself, and its character 3- to 5-grams with end marks) and how many it has.

    The buckets come word after word in one flat array.
    """
    counts = np.zeros(len(words), np.int64)
    groups = []
    for who, points in by_length(words):
        n, length = points.shape
        edge = np.full((n, 1), 2, np.uint64)
        marked = np.concatenate([edge, points.astype(np.uint64) + np.uint64(3), edge + np.uint64(1)], axis=1)
        whole = np.zeros(n, np.uint64)
        for i in range(length + 2):
            whole = whole * np.uint64(0x100000001B3) + marked[:, i]
        found = [mix64(whole + np.uint64(7))[:, None]]
        for size in (3, 4, 5):
            width = length + 3 - size
            if width < 1:
                break
            h = np.full((n, width), size, np.uint64)
            for i in range(size):
                h = h * np.uint64(0x9E3779B97F4A7C15) + marked[:, i : i + width]
            found.append(mix64(h))
        codes = (np.concatenate(found, axis=1) % np.uint64(buckets)).astype(np.int32)
        counts[who] = codes.shape[1]
        groups.append((who, codes))
    starts = np.r_[0, np.cumsum(counts)]
    flat = np.zeros(starts[-1], np.int32)
    for who, codes in groups:
        flat[(starts[who][:, None] + np.arange(codes.shape[1])).ravel()] = codes.ravel()
    return flat, counts


def read_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As `distinct_words`, a word that directly repeats the one before being left out."""
    words, tokens, counts = distinct_words(texts, BETWEEN)
    text = np.repeat(np.arange(len(counts)), counts)
    new = np.r_[True, (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])][: len(tokens)]
    return words, tokens[new], np.bincount(text[new], minlength=len(counts))


def room(n_feats: np.ndarray, size: int) -> np.ndarray:
    """What a window's sum is divided by: its features, short windows counting as filled up with empty words."""
    return np.maximum(n_feats, 12 * size)


def windows_of(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows of `size` words in the flat words of texts with `counts` words, and the text of each window."""
    per = -(-counts // size)
    text = np.repeat(np.arange(len(counts)), per)
    first = np.r_[0, np.cumsum(counts)][:-1]
    inside = np.arange(len(text)) - np.repeat(np.r_[0, np.cumsum(per)][:-1], per)
    return first[text] + inside * size, text


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows; `starts` are ascending and no run is empty."""
    return np.add.reduceat(values, starts, axis=0) if len(starts) else np.zeros((0, *values.shape[1:]), values.dtype)


def fit(texts: list[str], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float, float]:
    """Train embeddings and softmax jointly; returns each bucket's log-odds, the bias, and the log-odds of the cut.

    A text is judged by its most suspicious window, so that one insult in a long text counts: after a start on all
    windows, each step's gradient flows through the highest window of each text. A fifth of the texts sets the cut.
    """
    if not texts or labels.min() == labels.max():
        return np.zeros(s.buckets, np.float32), 0.0, 4.0
    rng = np.random.default_rng(s.seed)
    words, tokens, counts = read_words(pa.array(texts, pa.large_string()))
    flat, n_feats = word_features(words, s.buckets)
    feat_at = np.r_[0, np.cumsum(n_feats)][:-1]
    starts, owner = windows_of(counts, s.window)
    if not len(starts):
        return np.zeros(s.buckets, np.float32), 0.0, 4.0
    ends = np.minimum(starts + s.window, np.r_[0, np.cumsum(counts)][1:][owner])
    train = rng.random(len(texts)) < 0.8
    # features of fewer than `least` training texts stay out: their weight is 0
    text_of = np.repeat(np.arange(len(texts)), counts)
    pairs = np.unique(text_of[train[text_of]].astype(np.int64) * len(words) + tokens[train[text_of]])
    which = pairs % len(words)
    df = np.zeros(s.buckets, np.int64)
    for a in range(0, len(which), 100_000):
        some = which[a : a + 100_000]
        n_in = n_feats[some]
        df += np.bincount(flat[np.repeat(feat_at[some] - np.r_[0, np.cumsum(n_in)][:-1], n_in) + np.arange(n_in.sum())], minlength=s.buckets)
    del pairs, which, text_of
    known = df >= s.least + train.sum() // 800
    kept = known[flat]
    total_feats = n_feats  # unknown features count in the average
    n_feats = np.add.reduceat(kept.astype(np.int64), feat_at)
    number = np.cumsum(known) - 1
    flat = number[flat[kept]]
    feat_at = np.r_[0, np.cumsum(n_feats)][:-1]
    word_of = np.repeat(np.arange(len(words)), n_feats)
    weight = np.where(labels == 1, 0.5 / max(1, (labels[train] == 1).sum()), 0.5 / max(1, (labels[train] == 0).sum()))
    table = rng.normal(0, 0.1, (int(known.sum()), s.dim)).astype(np.float32)
    out = rng.normal(0, 0.3, (s.dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("t", table), ("o", out), ("b", bias))}

    def adam(key: str, value: np.ndarray, grad: np.ndarray, step: int) -> None:
        m, v = state[key]
        m *= 0.9
        m += 0.1 * grad
        v *= 0.99
        v += 0.01 * grad * grad
        value -= s.rate * ((m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) + s.decay * value)

    def word_odds() -> np.ndarray:
        return np.bincount(word_of, (table @ (out[:, 1] - out[:, 0]))[flat], len(words))

    def window_odds() -> np.ndarray:
        odds = word_odds()
        return sums(odds[tokens], starts) / room(sums(total_feats[tokens], starts), s.window) + float(bias[1] - bias[0])

    def highest(odds: np.ndarray) -> np.ndarray:
        order = np.lexsort((odds, owner))
        return order[np.r_[owner[order][1:] != owner[order][:-1], True]]

    trained = np.flatnonzero(train[owner])
    chosen = trained if len(trained) <= 20_000 else np.sort(rng.choice(trained, 20_000, replace=False))
    for step in range(1, s.steps + 1):
        if step >= 30 and step % 10 == 0:
            top = highest(window_odds())
            chosen = top[train[owner[top]]]
        if step <= 30 or step % 10 == 0:
            spans = ends[chosen] - starts[chosen]
            at = np.r_[0, np.cumsum(spans)][:-1]
            held = tokens[np.repeat(starts[chosen] - at, spans) + np.arange(spans.sum())]
            local, held = np.unique(held, return_inverse=True)
            sizes = n_feats[local]
            first = np.r_[0, np.cumsum(sizes)][:-1]
            feats = flat[np.repeat(feat_at[local] - first, sizes) + np.arange(sizes.sum())]
            word = np.repeat(np.arange(len(local)), sizes)
            total = room(sums(total_feats[local][held], at), s.window).astype(np.float32)
            y, w = labels[owner[chosen]], weight[owner[chosen]].astype(np.float32)
            w = w / w.sum()
        vectors = np.stack([np.bincount(word, table[feats, d], len(local)) for d in range(s.dim)], 1).astype(np.float32)
        mean = sums(vectors[held], at) / total[:, None]
        logits = mean @ out + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= w[:, None]
        back = (p @ out.T) / total[:, None]
        at_word = np.stack([np.bincount(held, np.repeat(back[:, d], spans), len(local)) for d in range(s.dim)], 1)
        grad = np.stack([np.bincount(feats, at_word[word, d], len(table)) for d in range(s.dim)], 1)
        g_out, g_bias = mean.T @ p, p.sum(0)
        adam("t", table, grad, step)
        adam("o", out, g_out.astype(np.float32), step)
        adam("b", bias, g_bias.astype(np.float32), step)
    odds = window_odds()
    top = highest(odds)
    held_out = top[~train[owner[top]]]
    spread = np.zeros(s.buckets, np.float32)
    spread[known] = table @ (out[:, 1] - out[:, 0])
    return spread, float(bias[1] - bias[0]), best_cut(odds[held_out], labels[owner[held_out]])


def best_cut(odds: np.ndarray, labels: np.ndarray) -> float:
    """Log-odds at which the F1 of label 1 is best: the middle between the two values around it.

    At least so high that no more than 2 % of label 0 lie above, since few texts may have label 1.
    """
    if not len(odds) or labels.min() == labels.max():
        return 2.0
    order = np.argsort(-odds)
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    k = int(np.argmax(f1))
    low = odds[order[k + 1]] if k + 1 < len(order) else odds[order[k]] - 1
    return max(float((odds[order[k]] + low) / 2), float(np.quantile(odds[labels == 0], 0.98)))


def score_batches(batches: Iterator[pa.RecordBatch], odds: np.ndarray, bias: float, cut: float, s: Settings) -> Iterator[pa.RecordBatch]:
    """Batches whose last column is the text, with its score in the text's place."""
    base = math.log(s.cut / (1 - s.cut))
    for batch in (part for whole in batches for part in slices(whole, whole.num_columns - 1, CHUNK)):
        words, tokens, counts = read_words(batch.column(batch.num_columns - 1))
        flat, n_feats = word_features(words, s.buckets)
        of_word = sums(odds[flat].astype(np.float64), np.r_[0, np.cumsum(n_feats)][:-1])
        starts, owner = windows_of(counts, s.window)
        z = np.full(len(counts), bias)
        if len(starts):
            value = sums(of_word[tokens], starts) / room(sums(n_feats[tokens], starts), s.window) + bias
            at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            z[owner[at]] = np.maximum.reduceat(value, at)
        score = 1 / (1 + np.exp(-np.clip(z - cut + base, -60, 60)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], names=[*batch.schema.names[:-1], "score"])


def fitting(sizes: list[int], labels: list[int], most: int) -> list[int]:
    """Which rows have at most `most` characters together: rows that do not fit are passed over.

    Each label has half of the room to itself, in the order of its rows; what is left then goes to any rows that fit. A
    label of which no row fits is stood for by its shortest row.
    """
    kept: set[int] = set()
    for v in sorted(set(labels)):
        own, room = [i for i, x in enumerate(labels) if x == v], most // 2
        before = len(kept)
        for i in own:
            if sizes[i] <= room:
                kept.add(i)
                room -= sizes[i]
        if len(kept) == before:
            kept.add(min(own, key=lambda i: sizes[i]))
    room = most - sum(sizes[i] for i in kept)
    for i in range(len(sizes)):
        if i not in kept and sizes[i] <= room:
            kept.add(i)
            room -= sizes[i]
    return sorted(kept)


def sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame | None:
    """The bounded sample (order, toxic, text) of labelled rows that the model is fitted on; None if a label has no text. Documents labelled both ways count as toxic.

    Rows with the same doc_id and text count once. Warns if a label of the table has no row in the sample.
    """
    own = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1
    marked = labels.filter("doc_id is not null and toxic is not null").filter(own).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    picked = [marked.filter(F.col("toxic") == v).orderBy(order, "doc_id").limit(n) for v, n in ((1, s.toxic_rows), (0, s.clean_rows))]
    ids = picked[0].unionByName(picked[1])  # at most toxic_rows + clean_rows rows
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(ids), "doc_id").withColumn("order", order).withColumn("digest", F.md5(F.col("text").cast("binary")))
    sizes = stored(found.groupBy("order", "digest", "toxic").agg(F.first(F.length("text")).alias("n")), "labelled")
    rows = [r for v, n in ((1, s.toxic_rows), (0, s.clean_rows)) for r in sizes.filter(F.col("toxic") == v).orderBy("order", "digest").limit(n).collect()]
    rows.sort(key=lambda r: (r["order"], r["digest"]))
    missing = {0, 1} - {r["toxic"] for r in rows}
    for v in sorted(missing):
        if not marked.filter(F.col("toxic") == v).isEmpty():
            logging.getLogger(__name__).warning("no text has a label toxic = %d, though the labels hold such rows; nothing will be flagged", v)
    if missing or not rows:
        return None  # one label alone teaches nothing
    kept = [rows[i] for i in fitting([r["n"] for r in rows], [r["toxic"] for r in rows], s.sample_chars)]
    keys = docs.sparkSession.createDataFrame([(r["order"], r["digest"]) for r in kept], "order string, digest string")
    texts = found.join(F.broadcast(keys), ["order", "digest"]).groupBy("order", "digest").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    return texts.select("order", F.col("toxic").cast("int").alias("toxic"), "text")


def fitted(texts: DataFrame | None, s: Settings) -> tuple[np.ndarray, float, float]:
    """`fit` over the bounded sample, in one task, so that its arrays take no memory of the driver."""
    if texts is None:
        return fit([], np.zeros(0, np.int64), s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((o, t, y) for b in batches for o, y, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        odds, bias, cut = fit([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.int64), s)
        yield pa.RecordBatch.from_arrays([pa.array([odds.astype("<f4").tobytes()], pa.binary()), pa.array([bias]), pa.array([cut])], names=["odds", "bias", "cut"])

    row = texts.repartition(1).mapInArrow(tidy(run), "odds binary, bias double, cut double").first()
    return np.frombuffer(row["odds"], "<f4"), row["bias"], row["cut"]


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, carry: list[str] | None = None) -> DataFrame:
    """Score every whole text of `docs` (doc_id, text) for toxicity as marked by `labels` (doc_id, toxic).

    Learns only from rows whose crc32(doc_id) mod 3 is not 1. Returns doc_id, held_out, score (0 to 1), predicted (1 from
    0.7). Null and empty texts are scored by the bias alone; null
    doc_ids are not held out, nor learned from; rows with equal texts get equal scores; without labels of
    both kinds nothing is flagged; an empty table gives no rows. Columns named in `carry` are handed on but for
    those named like an output, others ignored. Texts of any length are scored whole.
    """
    s = settings or Settings()
    carry = [c for c in carry or [] if c not in ("doc_id", "held_out", "score", "predicted")]
    base = docs.select("doc_id", "text")
    odds, bias, cut = fitted(sample(base, labels, s), s)
    shared = docs.sparkSession.sparkContext.broadcast(odds)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return score_batches(batches, shared.value, bias, cut, s)

    own = docs.select("doc_id", *carry, F.col("text").alias("text_"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    out = own.mapInArrow(tidy(run), schema + ", score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= s.cut, 1).otherwise(0).alias("predicted"), *carry)
