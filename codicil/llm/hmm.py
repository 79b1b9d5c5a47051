"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihoods by scaled forward recursion.

A state emits a class of words; a class emits its words by their counts. Words seen at least `own` times have classes of their
own (by hash), rarer and unknown ones share the class of their last three characters. So what states learn has a fixed size
(`classes` times `states` numbers) and can be broadcast at any size of corpus, while counts of words are a table that grows
with the corpus and is joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.llm.common import crc32_text, discard, small_batches, stored, tidy
from codicil.llm.words import joined, numbered, spans

END = 0  # class of the end of a text
PIECE_BYTES = 8 << 20  # about so much text makes one row of the encoded tables
LIMIT, SEGMENT = 2048, 1024  # longer sequences are cut into segments that are computed side by side
GROUP = 1 << 19  # tokens laid out at a time


@dataclass(frozen=True)
class Settings:
    """Size of the model and course of its training."""

    states: int = 8
    own_classes: int = 1 << 16
    ending_classes: int = 1 << 13
    own: int = 32  # least count of a word with a class of its own
    discount: float = 0.5  # taken from each seen word of an ending's class for its unknown words
    rounds: int = 3  # Baum-Welch rounds over all training documents
    start_rounds: int = 1  # earlier rounds, likewise over all
    weight: float = 100.0  # of the corpus' frequencies in a state's emissions

    @property
    def classes(self) -> int:
        return 1 + self.own_classes + self.ending_classes


@dataclass
class Model:
    """Probabilities of the first state, of moves from row to column, and of classes (rows) by state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def cast(self, kind: type) -> Model:
        """The model in another precision: that of the recursion over it."""
        return Model(*(x.astype(kind, copy=False) for x in (self.start, self.move, self.emit)))


class Sums:
    """Expected counts of first states, moves and emissions."""

    def __init__(self, states: int, classes: int):
        self.start, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))

    def model(self, prior: np.ndarray, weight: float) -> Model:
        start, move = self.start + 1.0, self.move + 1.0
        emit = (self.emit + weight * prior[:, None]) / (self.emit.sum(0) + weight)
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit)


class Layout:
    """Sequences side by side: entry t of all that are longer than t lie in a row, longest sequences first."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        falling = lengths[self.order]
        steps = int(falling[0]) if len(falling) else 0
        self.active = len(falling) - np.searchsorted(falling[::-1], np.arange(steps), side="right")
        self.edges = np.r_[0, np.cumsum(self.active)]
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        self.begins = np.r_[0, np.cumsum(lengths)][:-1]
        at = np.arange(lengths.sum()) - np.repeat(self.begins, lengths)
        self.place = self.edges[at] + np.repeat(rank, lengths)  # of every entry in its order of before


def chains(model: Model, classes: np.ndarray, lengths: np.ndarray, begin: np.ndarray, end: np.ndarray | None = None, sums: Sums | None = None, before: np.ndarray | None = None) -> np.ndarray:
    """log10 likelihoods of sequences (in a row, of `lengths`), whose first states have the probabilities `begin`.

    With `sums`, expected counts are added to it: `end` holds what follows each sequence's last state, and `before` the states
    before its first (a row of NaN where there are none).
    """
    lay, k = Layout(lengths), len(model.start)
    laid = np.empty(len(classes), classes.dtype)
    laid[lay.place] = classes
    emitted = model.emit[laid]
    alpha, scale, one = np.empty_like(emitted), np.empty(len(classes), emitted.dtype), np.ones(k, emitted.dtype)
    edges, active = lay.edges.tolist(), lay.active.tolist()
    for t, n in enumerate(active):
        now = alpha[edges[t] : edges[t + 1]]
        if t:
            np.matmul(alpha[edges[t - 1] : edges[t - 1] + n], model.move, out=now)
        else:
            now[:] = begin[lay.order]
        now *= emitted[edges[t] : edges[t + 1]]
        total = now @ one
        scale[edges[t] : edges[t + 1]] = total
        now /= total[:, None]
    likelihood = np.add.reduceat(np.log10(scale)[lay.place], lay.begins) if len(lengths) else np.zeros(0)
    if sums is None:
        return likelihood
    beta = np.ones_like(emitted)
    if end is not None:
        beta[lay.place[lay.begins + lengths - 1]] = end
    moved, back = np.zeros((k, k)), np.ascontiguousarray(model.move.T)
    for t in range(len(active) - 1, -1, -1):
        a, b = edges[t], edges[t + 1]
        n = active[t + 1] if t + 1 < len(active) else 0
        if n:
            after = emitted[b : b + n]
            np.matmul(after, back, out=beta[a : a + n])
            moved += alpha[a : a + n].T @ after
        emitted[a:b] *= beta[a:b]
        emitted[a:b] /= scale[a:b, None]
    firsts = lay.place[lay.begins]
    alpha *= beta
    heads = np.ones(len(lengths), bool)
    if before is not None:
        heads = np.isnan(before[:, 0])
        moved += before[~heads].T @ emitted[firsts[~heads]]
    sums.move += moved * model.move
    sums.start += alpha[firsts[heads]].sum(0)
    for s in range(k):
        sums.emit[:, s] += np.bincount(laid, weights=alpha[:, s], minlength=len(sums.emit))
    return likelihood


def transfers(model: Model, classes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each stretch, weights of its last state (columns) by the state before it (rows), up to a factor."""
    lay, k = Layout(lengths), len(model.start)
    out = np.tile(np.eye(k), (len(lengths), 1, 1))
    first, moved = begins[lay.order], np.empty((len(lengths) * k, k))
    for t, n in enumerate(lay.active.tolist()):
        np.matmul(out[:n].reshape(n * k, k), model.move, out=moved[: n * k])
        np.multiply(moved[: n * k].reshape(n, k, k), model.emit[classes[first[:n] + t]][:, None, :], out=out[:n])
        if t % 16 == 15:
            out[:n] /= out[:n].max(axis=(1, 2), keepdims=True)
    back = np.empty_like(out)
    back[lay.order] = out
    return back / back.max(axis=(1, 2), keepdims=True)


def around(model: Model, classes: np.ndarray, cuts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each long sequence, the states at the ends of its segments (between its `cuts`) from all before, and what follows them.

    The transfer matrices of all segments are made side by side, then multiplied from both ends, so segments can be computed apart.
    """
    begins = np.concatenate([np.r_[c[0] + 1, c[1:-1]] for c in cuts])
    lengths = np.concatenate([c[1:] for c in cuts]) - begins
    over = np.concatenate([transfers(model, classes, begins[a : a + 4096], lengths[a : a + 4096]) for a in range(0, len(lengths), 4096)])
    out, done = [], 0
    for c in cuts:
        own = over[done : done + len(c) - 1]
        done += len(own)
        now = model.start * model.emit[classes[c[0]]]
        last, follow = np.empty((len(own), len(now))), np.ones((len(own), len(now)))
        for j, matrix in enumerate(own):
            now = now @ matrix
            now /= now.sum()
            last[j] = now
        for j in range(len(own) - 1, 0, -1):
            then = own[j] @ follow[j]
            follow[j - 1] = then / (last[j - 1] @ then)
        out.append((last, follow))
    return out


def likelihoods(model: Model, classes: np.ndarray, lengths: np.ndarray, sums: Sums | None = None) -> np.ndarray:
    """log10 likelihoods of sequences in a row, exact at any length; with `sums`, their expected counts are added to it."""
    k = len(model.start)
    edges = np.r_[0, np.cumsum(lengths)]
    owner, at, size, begin, end, before = [], [], [], [], [], []
    short = np.flatnonzero(lengths <= LIMIT)
    owner.append(short)
    at.append(edges[:-1][short])
    size.append(lengths[short])
    begin.append(np.tile(model.start, (len(short), 1)))
    end.append(np.ones((len(short), k)))
    before.append(np.full((len(short), k), np.nan))
    long = np.flatnonzero(lengths > LIMIT)
    cuts = [np.unique(np.r_[edges[i] : edges[i + 1] : SEGMENT, edges[i + 1]]) for i in long]
    for i, c, (last, follow) in zip(long, cuts, around(model.cast(np.float64), classes, cuts) if len(long) else [], strict=True):
        owner.append(np.full(len(last), i))
        at.append(c[:-1])
        size.append(np.diff(c))
        begin.append(np.vstack([model.start, last[:-1] @ model.move]))
        end.append(follow)
        before.append(np.vstack([np.full(k, np.nan), last[:-1]]))
    owner, at, size, begin, end, before = (np.concatenate(x) for x in (owner, at, size, begin, end, before))
    out = np.zeros(len(lengths))
    order = np.argsort(-size, kind="stable")
    group = np.r_[0, np.cumsum(size[order])][:-1] // GROUP
    for some in np.split(order, np.flatnonzero(np.diff(group)) + 1):
        if len(some):
            entries = np.repeat(at[some] - np.r_[0, np.cumsum(size[some])][:-1], size[some]) + np.arange(size[some].sum())
            found = chains(model, classes[entries], size[some], begin[some], end[some], sums, before[some])
            np.add.at(out, owner[some], found)
    return out


def word_class(word: Column, count: Column, s: Settings) -> Column:
    """Class of a word with this count in the training texts."""
    own = F.pmod(F.xxhash64(word), F.lit(s.own_classes)) + 1
    return F.when(count >= s.own, own).otherwise(F.pmod(F.xxhash64(F.right(word, F.lit(3))), F.lit(s.ending_classes)) + 1 + s.own_classes).cast("int")


PIECE = "piece long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words array<string>, counts array<int>"


def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held, text) as pieces: word numbers of many texts, their distinct words, and these words' training counts."""
    part, made = TaskContext.get().partitionId(), 0
    waiting: list[pa.RecordBatch] = []

    def piece() -> pa.RecordBatch:
        nonlocal made
        table = pa.Table.from_batches(waiting).combine_chunks()
        waiting.clear()
        data, edges = joined(table.column("text").combine_chunks())
        data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
        starts, ends, sizes = spans(data, edges)
        words, tokens = numbered(data, starts, ends)
        learnt = ~table.column("held").to_numpy(zero_copy_only=False).astype(bool)
        counts = np.bincount(tokens[np.repeat(learnt, sizes)], minlength=len(words))
        made += 1
        row = [[(part << 32) + made], [table.column("doc_id").to_pylist()], [(~learnt).tolist()], [sizes.astype(np.int32)], [tokens.astype("<i4").tobytes()], [words.cast(pa.large_string()).to_pylist()], [counts.astype(np.int32)]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=[p.split()[0] for p in PIECE.split(", ")])

    size = 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.column("text").nbytes
        if size > PIECE_BYTES:
            yield piece()
            size = 0
    if waiting:
        yield piece()


CODED = "piece long, doc_ids array<long>, held array<boolean>, sizes array<int>, classes binary, known array<int>, base array<double>, inner array<double>"


def coded(pieces: DataFrame, slots: DataFrame, totals: np.ndarray, s: Settings) -> DataFrame:
    """Pieces as sequences of classes, each text with its end: number of known tokens, base score, and score inside classes.

    `slots` holds class and count of every distinct word of a piece; `totals` the tokens and the words of every class.
    """
    shared = pieces.sparkSession.sparkContext.broadcast(totals)  # of fixed size
    n_all, n_words = int(totals[:, 0].sum()), int(totals[:, 1].sum())

    def run(rows: pa.Table, words: pa.Table) -> pa.Table:
        names = [p.split()[0] for p in CODED.split(", ")]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        out: list[list] = [[] for _ in names]
        place = np.argsort(words.column("slot").to_numpy())
        kind, count = words.column("class").to_numpy()[place], words.column("c").to_numpy()[place].astype(np.float64)
        tokens_of, words_of = shared.value.T.astype(np.float64)
        whole = np.maximum(tokens_of[kind], 1.0)
        seen = np.where(kind > s.own_classes, count - s.discount, count) / whole
        unseen = np.where(tokens_of[kind] > 0, s.discount * words_of[kind] / whole, 1.0)
        inner = np.log10(np.where(count > 0, seen, unseen))
        base = np.log10((count + 0.1) / (n_all + 0.1 * (n_words + 1)))
        end_count = tokens_of[END]
        end_base = np.log10((end_count + 0.1) / (n_all + 0.1 * (n_words + 1)))
        for row in rows.to_pylist():
            sizes = np.array(row["sizes"], np.int64)
            tokens = np.frombuffer(row["tokens"], "<i4")
            edges = np.r_[0, np.cumsum(sizes)]
            per_text = lambda x: np.diff(np.r_[0.0, np.cumsum(x[tokens])][edges])  # noqa: B023,E731
            classes = np.zeros(len(tokens) + len(sizes), np.int32)
            classes[np.arange(len(tokens)) + np.repeat(np.arange(len(sizes)), sizes)] = kind[tokens]
            known = per_text((count > 0).astype(np.float64)) + (end_count > 0)
            values = (row["piece"], row["doc_ids"], row["held"], sizes + 1, classes.astype("<i4").tobytes(), known.astype(np.int32), per_text(base) + end_base, per_text(inner))
            for column, value in zip(out, values, strict=True):
                column.append(value)
        return pa.table([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)

    return pieces.select("piece", "doc_ids", "held", "sizes", "tokens").groupBy("piece").cogroup(slots.groupBy("of")).applyInArrow(run, CODED)


def training_part(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Classes and lengths of the training texts of a piece."""
    sizes, learnt = np.array(row["sizes"], np.int64), ~np.array(row["held"], bool)
    return np.frombuffer(row["classes"], "<i4")[np.repeat(learnt, sizes)], sizes[learnt]


def starting_point(prior: np.ndarray, s: Settings) -> Model:
    """States that tend to last, each with the classes of the corpus weighed by a seeded draw: no text is read for it."""
    rng = np.random.default_rng(1)
    stay = np.full((s.states, s.states), 0.1 / s.states) + 0.9 * np.eye(s.states)
    emit = prior[:, None] * rng.gamma(2.0, size=(len(prior), s.states))
    return Model(np.full(s.states, 1 / s.states), stay, emit / emit.sum(0))


def learn(sequences: DataFrame, model: Model, prior: np.ndarray, s: Settings) -> Model:
    """One Baum-Welch round over all training texts: each task's expected counts are rows, which Spark sums by class.

    Recursions run in single precision (each step is scaled), their counts are summed in double.
    """
    shared = sequences.sparkSession.sparkContext.broadcast(model.cast(np.float32))  # of fixed size
    names = [f"e{i}" for i in range(s.states)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(s.states, s.classes)
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            classes, sizes = training_part(row)
            if len(sizes):
                likelihoods(shared.value, classes, sizes, sums)
        used = np.flatnonzero(sums.emit.any(1))
        number = np.r_[used, -1 - np.arange(1 + s.states)]
        values = np.vstack([sums.emit[used], sums.start[None], sums.move])
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), *(pa.array(values[:, i], pa.float32(), safe=False) for i in range(s.states))], names=["class", *names])

    rows = sequences.select("sizes", "held", "classes").mapInArrow(tidy(run), "class int, " + ", ".join(f"{n} float" for n in names))
    found = rows.groupBy("class").agg(*(F.sum(n).alias(n) for n in names)).toPandas()  # at most classes + states + 1 rows
    sums = Sums(s.states, s.classes)
    number, values = found["class"].to_numpy(), found[names].to_numpy()
    sums.emit[number[number >= 0]] = values[number >= 0]
    for n, v in zip(number, values, strict=True):
        if n == -1:
            sums.start = v
        elif n < -1:
            sums.move[-2 - n] = v
    return sums.model(prior, s.weight)


def score_texts(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """log10 probability of every whole text by a hidden Markov model of the texts whose crc32(doc_id) mod 10 is not 0.

    Tokens are words (runs without space, tab, line feed and the like; A-Z lower-cased) and one end. Returns doc_id, held_out,
    n_tokens, n_known (tokens of the training texts), train_tokens, base_score (their smoothed frequencies alone), score.

    Texts become rows of word numbers in pieces of about 8 MB; the counts of all words are a table, joined once to the distinct
    words of each piece. Every Baum-Welch round reads all training texts. Sequences above 2,048 tokens are cut into segments
    whose transfer matrices give the states between them, so the recursion stays exact; a text is held whole in one task
    (about 40 bytes for each byte).

    A null text is empty: its one token is the end. A null doc_id is not held out. Rows repeated are rows of their own and
    count each time. Without training texts all words are unknown and base scores are those of the formula with no counts. An
    empty table gives no rows; other columns are ignored.
    """
    s = settings or Settings()
    small_batches(docs.sparkSession)
    held = F.coalesce(F.pmod(crc32_text(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = stored(texts.mapInArrow(tidy(cut_pieces), PIECE), "hmm-pieces")

    seen = pieces.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").alias("n")).filter("n > 0")
    counts = stored(seen.groupBy("word").agg(F.sum("n").alias("c")), "hmm-counts")
    by_class = counts.groupBy(word_class(F.col("word"), F.col("c"), s).alias("class")).agg(F.sum("c").alias("tokens"), F.count("*").alias("words")).collect()  # at most `classes` rows
    totals = np.zeros((s.classes, 2), np.int64)
    for row in by_class:
        totals[row["class"]] = row["tokens"], row["words"]
    ends = pieces.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    totals[END] = ends, ends > 0
    prior = totals[:, 0] + 0.1 * ((np.arange(s.classes) == END) | (np.arange(s.classes) > s.own_classes))
    prior /= prior.sum()

    slots = pieces.select("piece", F.posexplode("words").alias("slot", "word")).join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    slots = slots.select(F.col("piece").alias("of"), "slot", word_class(F.col("word"), F.col("c"), s).alias("class"), "c")
    sequences = stored(coded(pieces, slots, totals, s), "hmm-sequences")
    discard(pieces, counts)

    model = starting_point(prior, s)
    for _ in range(s.start_rounds + s.rounds):
        model = learn(sequences, model, prior, s)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                inner = one.column("inner").flatten().to_numpy()
                sizes = one.column("sizes").flatten().to_numpy().astype(np.int64)
                found = likelihoods(shared.value, np.frombuffer(one.column("classes")[0].as_buffer(), "<i4"), sizes)
                columns = [one.column(n).flatten() for n in ("doc_ids", "held")] + [pa.array(sizes)]
                columns += [one.column("known").flatten().cast(pa.int64()), one.column("base").flatten(), pa.array(found + inner)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = sequences.mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(totals[:, 0].sum())).cast("long").alias("train_tokens"), "base_score", "score")
