"""Token ids of texts by a byte-level BPE of the tokenizers library, each distinct piece of text being encoded once."""

from __future__ import annotations

import os
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from codicil.llm.words import Remembered


SOLID, LETTER, MARK = 1, 2, 4


def byte_kinds() -> np.ndarray:
    """What each byte is if it is a whole character: surely not white space, a letter, a mark."""
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = SOLID  # controls count as white space somewhere
    for signs, kind in ((string.ascii_letters, LETTER), (".,;:!?()", MARK)):
        kinds[list(signs.encode())] |= kind
    return kinds


KINDS = byte_kinds()


def safe_pieces(texts: pa.LargeStringArray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Texts cut where the tokenizer's own pattern always cuts; the pieces, and how many each text has.

    Such places are: before a lone space, before and after a lone line feed, and between a letter and punctuation, white
    space counting as lone if both neighbours are surely not white space: visible ASCII, or a letter of U+00C0 to U+023F,
    whose first byte is C3 to C8.
    """
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    filled = edges[:-1][np.diff(edges) > 0]  # where texts begin
    begin = np.zeros(len(data) + 1, bool)
    if len(data):
        kind = KINDS[data]
        lead = (data >= 0xC3) & (data <= 0xC8)
        opens, closes = (kind & SOLID) > 0, (kind & SOLID) > 0
        opens |= lead  # solid characters by their first byte, and by their last
        closes[1:] |= lead[:-1]
        closes[filled[1:] - 1] = False  # a neighbour in another text is none
        opens[filled] = False
        between = np.zeros(len(data), bool)
        between[1:-1] = closes[:-2] & opens[2:]
        between[filled] = False
        between[filled[1:] - 1] = False
        begin[:-1] |= between & (data == 32)
        feed = between & (data == 10)
        begin[:-1] |= feed
        begin[1:] |= feed
        letter = (kind & LETTER) > 0
        letter[1:] |= lead[:-1] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))  # but for the signs of times and division
        begin[1:-1] |= letter[:-1] & ((kind[1:] & MARK) > 0)
    begin[filled] = True
    begin[-1] = False
    starts = np.flatnonzero(begin)
    offsets = np.ascontiguousarray(np.r_[starts, len(data)], np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces.dictionary_encode(), np.diff(np.searchsorted(starts, edges))


class Encoder:
    """Encodes batches of texts; ids of pieces seen lately are kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("an added token depends on what stands beside it")
        self.added = added  # their strings in a text are one id each, the longest at the first place
        self.any_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.seen = Remembered(self.learn)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces in a row, and how many each has."""
        ids, counts = [], []
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            found = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.int32))
            counts.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins (one entry more than texts)."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if not any(pc.any(pc.match_substring(texts, a)).as_py() for a in self.added):
            return self.encode_plain(texts)
        cut = [self.any_added.split(t) for t in texts.to_pylist()]  # every second part is an added token
        flat = [p for parts in cut for p in parts]
        odd = np.array([k % 2 for parts in cut for k in range(len(parts))], bool)
        ids, edges = self.encode_plain(pa.array(["" if o else p for p, o in zip(flat, odd.tolist(), strict=True)], pa.large_string()))
        ids = np.insert(ids, edges[:-1][odd], [self.added[flat[i]] for i in np.flatnonzero(odd)])
        edges = edges + np.r_[0, np.cumsum(odd)]
        return ids, edges[np.r_[0, np.cumsum([len(parts) for parts in cut])]]

    def encode_plain(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """As `encode`, for texts without added tokens."""
        pieces, per = safe_pieces(texts)
        ids, at = self.seen.ids(pieces.dictionary.to_pylist(), pieces.indices.to_numpy())
        return ids, at[np.r_[0, np.cumsum(per)]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
