"""Encoding by the pieces of a SentencePiece model: batched numpy Viterbi over words of equal length, and decoding."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.llm.common import tidy
from codicil.llm.words import Remembered, by_length, mix64

SPACE = "▁"  # stands for a space in pieces
UNKNOWN_PENALTY = 10.0
CHUNK = 8_000_000  # characters encoded at a time, or one text
STRETCH = 4096  # ends of a word whose candidate pieces are looked up at a time
REMEMBERED = 500_000  # pairs of pieces whose answer is kept
NEVER = np.iinfo(np.int32).max


class Merges:
    """How the pieces of a model of merge ranks are put together, to tell which two pieces can stand side by side.

    Merging takes, again and again, the pair of neighbours whose joint string is the piece of lowest rank, the leftmost of
    equals. A row of pieces is what merging makes of a text if that holds for every two neighbours of the row; and two
    pieces stay apart if no pair across their border would have been merged while both of its sides were there.
    """

    def __init__(self, rank: np.ndarray):
        self.rank = rank  # of each piece, -1 for characters
        self.left, self.right = np.full(len(rank), -1, np.int32), np.full(len(rank), -1, np.int32)
        self.pairs, self.joint = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.known: dict[int, bool] = {}

    def joint_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rank of the piece that x and y make together, NEVER if none."""
        key = x.astype(np.int64) * len(self.rank) + y
        if not len(self.pairs):
            return np.full(len(key), NEVER, np.int32)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.joint[at], NEVER)

    def apart(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether pieces x[i], y[i] in a text of the two are left as they are by merges of ranks below limit[i].

        Walks back in time: of the two pieces at the border the one that was made later is taken apart, until both are
        characters. `until_x` and `until_y` are the ranks at which a side goes on into the next piece of its own.
        """
        good = np.ones(len(x), bool)
        until_x = np.full(len(x), NEVER, np.int32) if limit is None else limit.copy()
        until_y, live = until_x.copy(), np.arange(len(x))
        while len(live):
            joint = self.joint_rank(x, y)
            bad = (joint < until_x) & (joint <= until_y)
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            some = np.flatnonzero(~bad & ((rx >= 0) | (ry >= 0)))
            live, x, y, until_x, until_y, rx, ry = (v[some] for v in (live, x, y, until_x, until_y, rx, ry))
            first = rx > ry
            x, until_x, y, until_y = np.where(first, self.right[x], x), np.where(first, rx, until_x), np.where(first, y, self.left[y]), np.where(first, until_y, ry)
        return good

    def neighbours(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """`apart` without a limit; answers are remembered."""
        pair, which = x.astype(np.int64) * len(self.rank) + y, slice(None)
        if len(pair) > 64:
            pair, which = np.unique(pair, return_inverse=True)
        keys = pair.tolist()
        new = [k for k in keys if k not in self.known]
        if new:
            if len(self.known) > REMEMBERED:
                self.known.clear()
                new = keys
            asked = np.array(new, np.int64)
            self.known.update(zip(new, self.apart(asked // len(self.rank), asked % len(self.rank)).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, keys), bool, len(keys))[which]

    def add(self, whole: np.ndarray, splits: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Pieces of one length, after all shorter ones: where each can be cut into two pieces (-1: not pieces), the cut whose
        sides stay apart until the piece's own rank made it. Pieces without one can't come about, and get no sides."""
        pairs, joint = [], []
        for x, y in splits:
            some = np.flatnonzero((x >= 0) & (y >= 0))
            some = some[(self.left[x[some]] >= 0) | (self.rank[x[some]] < 0)]
            some = some[(self.left[y[some]] >= 0) | (self.rank[y[some]] < 0)]
            who = whole[some]
            pairs.append(x[some].astype(np.int64) * len(self.rank) + y[some])
            joint.append(self.rank[who])
            good = self.apart(x[some], y[some], self.rank[who])
            self.left[who[good]], self.right[who[good]] = x[some][good], y[some][good]
        pairs, joint = np.concatenate([self.pairs, *pairs]), np.concatenate([self.joint, *joint])
        order = np.argsort(pairs)
        self.pairs, self.joint = pairs[order], joint[order]


@dataclass
class Pieces:
    """Vocabulary laid out for probing: piece keys in ascending order, their ids and scores, and each id's bytes."""

    keys: np.ndarray
    maybe: np.ndarray  # by the top bits of a key: whether any piece has them
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    raw: pa.Array  # bytes of each id, spaces being spaces
    first_byte: int  # id of byte 0
    unknown: float  # score of a character that has no piece
    merges: Merges | None  # where the scores are merge ranks
    seen: Remembered | None = None


def substring_keys(points: np.ndarray, longest: int) -> np.ndarray:
    """64-bit keys of all substrings of up to `longest` characters: [row, start, length - 1]; 0 where they would pass the end."""
    n, length = points.shape
    longest = min(longest, length)
    keys = np.zeros((n, length, longest), np.uint64)
    h = np.zeros((n, length), np.uint64)
    x = points.astype(np.uint64) + np.uint64(1)
    for k in range(longest):
        h = h[:, : length - k] * np.uint64(0x9E3779B97F4A7C15) + x[:, k:]
        keys[:, : length - k, k] = mix64(h + np.uint64(k))
    return keys


def probe(keys: np.ndarray, sorted_keys: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """Where each key is among the sorted ones, -1 if it is not."""
    flat = keys.ravel()
    some = np.flatnonzero(maybe[flat >> np.uint64(44)])
    found = np.minimum(np.searchsorted(sorted_keys, flat[some]), len(sorted_keys) - 1)
    good = sorted_keys[found] == flat[some]
    spot = np.full(keys.shape, -1, np.int32)
    spot.ravel()[some[good]] = found[good]
    return spot


def merge_tree(names: list[str], keys: np.ndarray, maybe: np.ndarray, rank: np.ndarray) -> Merges:
    """`Merges` of pieces in the order of their keys."""
    merges = Merges(rank)
    for who, points in by_length(names):
        length = points.shape[1]
        if length > 1:
            spot = probe(substring_keys(points, length), keys, maybe)
            merges.add(who, [(spot[:, 0, i - 1], spot[:, i, length - i - 1]) for i in range(1, length)])
    return merges


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    """Read the model file. Where its scores are merge ranks, only rows of pieces that merging makes are paths, all worth the
    same, so the one path of a text has the library's ids; scores of unigram models are summed."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    names, scores, raw = [], [], []
    first_byte = next((i for i in range(size) if model.is_byte(i)), -1)
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            raw.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            piece = piece.replace(SPACE, " ")
            raw.append(piece.encode())
            names.append((piece, i))
            scores.append(model.get_score(i))
    ranks = bool(scores) and np.array_equal(scores, np.round(scores))
    if ranks:  # characters that only longer pieces hold take part in merges, but have no id
        scores += [0.0] * len(lone := sorted({c for n, _ in names for c in n} - {n for n, _ in names}))
        names += [(c, -1) for c in lone]
    keys = np.zeros(len(names), np.uint64)
    for who, points in by_length([n for n, _ in names]):
        keys[who] = substring_keys(points, points.shape[1])[:, 0, -1]
    order = np.argsort(keys)
    keys, scores, ids = keys[order], np.array(scores)[order], np.array([i for _, i in names], np.int32)[order]
    names = [names[i][0] for i in order]
    maybe = np.zeros(1 << 20, bool)
    maybe[keys >> np.uint64(44)] = True
    merges = None
    if ranks:
        merges = merge_tree(names, keys, maybe, np.where([len(n) > 1 for n in names], -scores, -1).astype(np.int32))
    p = Pieces(keys, maybe, ids, scores, max(map(len, names)), pa.array(raw, pa.binary()), first_byte, float(scores.min()) - UNKNOWN_PENALTY, merges)
    p.seen = Remembered(lambda words: encode_words(words, p))
    return p


def best_paths(points: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Viterbi over words of one length, all at once: ids of the best pieces in order, word after word, and their counts.

    At each end the candidates are the pieces ending there; the first maximum (the shortest last piece) wins ties. A
    character without a piece has id -1 - code point, to be spelled in bytes. Pieces are looked up for `STRETCH` ends at a
    time, so that a word of any length takes a few bytes for each of its characters.
    """
    n, length = points.shape
    longest = min(p.longest, length)
    row = np.arange(n)
    best = np.full((n, longest + 1), -np.inf)  # of the last ends, end e in column e % (longest + 1)
    best[:, 0] = 0
    last = np.full((n, length + 1), -1, np.int32)  # the piece before each end; -1: a character without one
    back = np.zeros((n, length + 1), np.int16)
    for block in range(0, length, STRETCH):
        low, high = max(0, block + 1 - longest), min(length, block + STRETCH)
        spot = probe(substring_keys(points[:, low:high], longest), p.keys, p.maybe)
        for end in range(block + 1, high + 1):
            sizes = np.arange(1, min(end, longest) + 1)
            piece = spot[:, end - sizes - low, sizes - 1]
            value = best[:, (end - sizes) % (longest + 1)]
            if p.merges is None:
                value = np.where(piece >= 0, value + p.scores[piece], -np.inf)
                value[:, 0] = np.where(piece[:, 0] >= 0, value[:, 0], best[:, (end - 1) % (longest + 1)] + p.unknown)
            else:
                value[:, 1:][(piece[:, 1:] < 0) | (p.merges.left[piece[:, 1:]] < 0)] = -np.inf
                before = last[:, end - sizes]
                r, c = np.nonzero((value > -np.inf) & (piece >= 0) & (before >= 0))
                bad = ~p.merges.neighbours(before[r, c], piece[r, c])
                value[r[bad], c[bad]] = -np.inf
            pick = np.argmax(value, axis=1)
            back[:, end] = sizes[pick]
            best[:, end % (longest + 1)] = value[row, pick]
            last[:, end] = piece[row, pick]
    ids = np.zeros((n, length), np.int64)
    at, counts = np.full(n, length), np.zeros(n, np.int64)
    while len(row):
        step, piece = back[row, at], last[row, at]
        start = at - step
        one = np.where(piece < 0, -1, p.ids[piece]).astype(np.int64)
        counts[row] += 1
        ids[row, length - counts[row]] = np.where(one < 0, -1 - points[row, start].astype(np.int64), one)
        row, at = row[start > 0], start[start > 0]
    return ids[np.arange(length)[None, :] >= length - counts[:, None]], counts


def in_bytes(ids: np.ndarray, counts: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Spell characters without a piece by the ids of their UTF-8 bytes."""
    bad = np.flatnonzero(ids < 0)
    if not len(bad):
        return ids, counts
    spelled = [[p.first_byte + b for b in chr(-1 - int(ids[i])).encode("utf-8", "surrogatepass")] for i in bad]
    width = np.ones(len(ids), np.int64)
    width[bad] = [len(s) for s in spelled]
    out = np.repeat(ids, width)
    at = np.r_[0, np.cumsum(width)]
    for i, s in zip(bad, spelled, strict=True):
        out[at[i] : at[i + 1]] = s
    edges = np.r_[0, np.cumsum(counts)]
    return out, np.diff(at[edges])


def encode_words(words: list[str], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each word, word after word, and how many each has."""
    counts = np.zeros(len(words), np.int64)
    groups = []
    for who, points in by_length(words):
        block = max(1, 4_000_000 // (points.shape[1] * min(p.longest, points.shape[1])))
        for a in range(0, len(who), block):
            ids, n = in_bytes(*best_paths(points[a : a + block], p), p)
            counts[who[a : a + block]] = n
            groups.append((who[a : a + block], ids, n))
    edges = np.r_[0, np.cumsum(counts)]
    flat = np.zeros(edges[-1], np.int32)
    for who, ids, n in groups:
        flat[np.repeat(edges[who] - np.r_[0, np.cumsum(n)][:-1], n) + np.arange(len(ids))] = ids
    return flat, counts


def cut_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as numbers, and the words of each text.

    A text gets a space in front, unless empty; a word is a run of spaces and the run of other characters after it. No
    piece holds a space after another character, so paths of words join to the path of the text.
    """
    marked = pa.array([" " + t.replace(SPACE, " ") if t else "" for t in texts], pa.large_string())
    edges = np.frombuffer(marked.buffers()[1], np.int64)[: len(texts) + 1]
    data = np.frombuffer(marked.buffers()[2] or b"", np.uint8)[: edges[-1]]
    space = data == 32
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[edges[:-1][np.diff(edges) > 0]] = True
    starts = np.flatnonzero(begin)
    offsets = np.ascontiguousarray(np.r_[starts, len(data)], np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), marked.buffers()[2] or pa.py_buffer(b"")]).dictionary_encode()
    return words.dictionary.to_pylist(), words.indices.to_numpy(), np.diff(np.searchsorted(starts, edges))


def encode(texts: list[str], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text begins (one entry more than texts)."""
    words, tokens, per = cut_words(texts)
    ids, at = p.seen.ids(words, tokens)
    return ids, at[np.r_[0, np.cumsum(per)]]


def decode(ids: np.ndarray, edges: np.ndarray, p: Pieces) -> list[str]:
    """Texts of runs of ids; malformed bytes become U+FFFD; the space put in front is taken off."""
    got = p.raw.take(pa.array(ids))
    offsets = np.frombuffer(got.buffers()[1], np.int32)[: len(ids) + 1]
    data = bytes(got.buffers()[2] or b"")
    at = offsets[edges]
    return [data[a + (data[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


def round_trip(docs: DataFrame, path: str, more: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids, and report: doc_id, n_tokens, n_words, ids_crc32 (ids as little-endian unsigned
    32-bit integers), n_chars and text_crc32 of the decoded text, round_trip (it equals the text), and with `with_ids` the ids.

    Ids are those of the SentencePiece library where the model has merge ranks. Null and empty texts have no tokens; texts
    and words of any length are encoded whole, in memory that grows with the longest text. A row with characters no piece covers is spelled in bytes there. Repeated rows
    are reported each; an empty table gives no rows; columns other than doc_id, text and `more` are ignored.
    """
    more = [c for c in (more or []) if c in docs.columns]
    schema = docs.select("doc_id", *more).schema
    names = [f.name for f in schema.fields]
    kinds = ["n_tokens", "ids_crc32", "n_chars", "text_crc32", "round_trip"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load(path)
        for whole in batches:
            texts = [t or "" for t in whole.column(whole.num_columns - 1).to_pylist()]
            sizes = np.cumsum([len(t) for t in texts])
            cuts = np.unique(np.r_[0, np.searchsorted(sizes, np.arange(CHUNK, (sizes[-1] if len(sizes) else 0), CHUNK)) + 1, len(texts)])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = texts[a:b]
                ids, edges = encode(part, p)
                little = ids.astype("<u4")
                back = decode(ids, edges, p)
                columns = [
                    pa.array(np.diff(edges)),
                    pa.array([zlib.crc32(little[x:y].tobytes()) for x, y in zip(edges[:-1], edges[1:], strict=True)], pa.int64()),
                    pa.array([len(t) for t in back], pa.int64()),
                    pa.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in back], pa.int64()),
                    pa.array([x == y for x, y in zip(back, part, strict=True)], pa.bool_()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in whole.columns[:-1]] + columns, names=names + kinds)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    schema += ", n_tokens long, ids_crc32 long, n_chars long, text_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(*names, F.col("text")).mapInArrow(tidy(run), schema)
