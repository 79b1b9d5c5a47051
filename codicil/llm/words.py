"""Batches of texts as arrays of words, and words of equal length as matrices of code points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def distinct_words(texts: pa.Array, pattern: str, lower: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, each word's number among them, and the words of each text (runs between matches of `pattern`)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.split_pattern_regex(pc.utf8_lower(texts) if lower else texts, pattern)
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    flat = parts.flatten()
    filled = pc.not_equal(pc.binary_length(flat), 0)
    rows = np.repeat(np.arange(len(parts)), np.diff(parts.offsets.to_numpy()))[filled.to_numpy(zero_copy_only=False)]
    coded = flat.filter(filled).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.bincount(rows, minlength=len(parts))


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `size` bytes, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(size, ends[-1] if len(ends) else 0, size)) + 1, len(ends)])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of words of equal length: their numbers, and their code points as a matrix."""
    if not words:
        return
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(lengths[order]) > 0])
    for a, b in zip(starts, np.r_[starts[1:], len(words)], strict=True):
        n = int(lengths[order[a]])
        if n:
            block = "".join([words[i] for i in order[a:b]]).encode("utf-32-le", "surrogatepass")
            yield order[a:b], np.frombuffer(block, np.uint32).reshape(b - a, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit hashes (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Remembered:
    """Ids of words, those of words seen lately being kept: `learn` gives the ids of new words in a row, and how many each has.

    Of more than `most` words, or `most_ids` ids, only those asked for more than once are kept; if these are still many, none.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 800_000, most_ids: int = 16_000_000):
        self.learn, self.most, self.most_ids = learn, most, most_ids
        self.number: dict[str, int] = {}
        self.flat, self.edges, self.asked = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def forget(self) -> None:
        keep = self.asked > 1
        if keep.sum() > self.most // 2 or np.diff(self.edges)[keep].sum() > self.most_ids // 2:
            keep[:] = False
        place = np.cumsum(keep) - 1
        self.number = {w: p for (w, n), p in zip(self.number.items(), place[list(self.number.values())].tolist(), strict=True) if keep[n]}
        self.flat = self.flat[np.repeat(keep, np.diff(self.edges))]
        self.edges = np.r_[0, np.cumsum(np.diff(self.edges)[keep])]
        self.asked = np.zeros(keep.sum(), np.int32)

    def ids(self, words: list[str], tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with the numbers `tokens` in a row, and where each of these begins (one entry more than tokens)."""
        if len(self.number) > self.most or len(self.flat) > self.most_ids:
            self.forget()
        new = [w for w in words if w not in self.number]
        if new:
            ids, counts = self.learn(new)
            self.number.update(zip(new, range(len(self.edges) - 1, len(self.edges) - 1 + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, ids.astype(np.int32)])
            self.edges = np.r_[self.edges, self.edges[-1] + np.cumsum(counts)]
            self.asked = np.concatenate([self.asked, np.zeros(len(new), np.int32)])
        of_word = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        self.asked[of_word] += 1
        at = of_word[tokens]
        sizes = np.diff(self.edges)[at]
        edges = np.r_[0, np.cumsum(sizes)]
        return self.flat[np.repeat(self.edges[:-1][at] - edges[:-1], sizes) + np.arange(edges[-1])], edges


def spans(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words (runs of bytes without space, tab, line feed and the like) of joined texts start and end, and words of each text."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[edges] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    end[:-1] &= ~solid[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.diff(np.searchsorted(starts, edges))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row (null: none), and where each begins (one entry more than texts)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    edges = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words as an Arrow array of bytes, and the number of each word among them."""
    sizes = ends - starts
    offsets = np.r_[0, np.cumsum(sizes)]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # a word may begin where another text's last word ends
    packed = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed.tobytes())]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy()
