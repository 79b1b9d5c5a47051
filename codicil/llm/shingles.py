"""Five-word shingles of texts as 64-bit identifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from codicil.llm.words import mix64

SIZE = 5


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of all words (runs without space, tab, line feed and the like; A-Z lower-cased), and words of each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.r_[0, np.cumsum(sizes)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, bool)
    first[edges] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(starts, edges))
    # distinct words, hashed eight bytes at a time
    keep = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(solid, out=keep[1:])
    offsets = np.r_[keep[starts], keep[-1]].astype(np.int64)
    packed = data[solid]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed.tobytes())]).dictionary_encode()
    found = words.dictionary
    at = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1]
    blob = np.frombuffer(found.buffers()[2] or b"", np.uint8)
    blob = np.concatenate([blob, np.zeros(16, np.uint8)])
    length = np.diff(at)
    h = length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live, step = np.arange(len(found)), 0
    while len(live):
        left = length[live] - step
        value = np.zeros(len(live), np.uint64)
        for i in range(8):
            value |= np.where(left > i, blob[at[:-1][live] + step + i * (left > i)].astype(np.uint64), np.uint64(0)) << np.uint64(8 * i)
        h[live] = mix64(h[live] ^ mix64(value + np.uint64(step)))
        live, step = live[left > 8], step + 8
    return h[words.indices.to_numpy()], counts


def in_order(numbers: np.ndarray, top: int) -> np.ndarray:
    """Stable order of numbers below `top`; small ones are sorted by radix."""
    return np.argsort(numbers.astype(np.uint16 if top <= 1 << 16 else np.int64), kind="stable")


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, text after text, and how many each has.

    A text of fewer than five words has its whole sequence as one shingle; one without words has none.
    """
    ids, counts = word_ids(texts)
    edges = np.r_[0, np.cumsum(counts)]
    n = np.where(counts >= SIZE, counts - SIZE + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(texts)), n)
    starts = np.arange(len(text)) - np.repeat(np.r_[0, np.cumsum(n)][:-1], n) + edges[text]
    h = np.full(len(text), SIZE, np.uint64)
    size = np.minimum(counts, SIZE)[text]
    for i in range(SIZE):
        some = i < size if len(texts) and (counts < SIZE).any() else slice(None)
        h[some] = mix64(h[some] * np.uint64(0xD6E8FEB86659FD93) + ids[starts[some] + i])
    order = np.argsort(h)
    h = h[order[in_order(text[order], len(texts))]]  # each text's shingles ascend in its own places
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][: len(h)]
    return h[new], np.bincount(text[new], minlength=len(texts))
