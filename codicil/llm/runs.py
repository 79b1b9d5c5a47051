"""Runs of repeated words: Re-Pair grammars, runs across each nonterminal's boundary found once, moved to all its places, merged."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.llm.common import small_batches, tidy
from codicil.llm.words import joined, mix64, numbered, slices, spans

LEAST, TIMES = 24, 3  # a run has at least LEAST words and TIMES periods
GRAM = 8  # words that must recur at a period's distance near every boundary inside a run
SLICE_BYTES = 4 << 20


@dataclass
class Grammar:
    """Nonterminals: place of one occurrence in the words, words of the left part and in all; and every occurrence (node, place)."""

    first: np.ndarray
    left: np.ndarray
    size: np.ndarray
    nodes: np.ndarray
    places: np.ndarray


def in_pairs(priority: np.ndarray) -> np.ndarray:
    """Of neighbouring pairs (0: none), those that stand above their neighbours; of equal ones in a row every second."""
    n = len(priority)
    new = np.r_[True, priority[1:] != priority[:-1]]
    starts = np.flatnonzero(new)
    ends = np.r_[starts[1:], n]
    high = np.r_[0, priority, 0]
    top = (priority[starts] > 0) & (high[starts] < priority[starts]) & (high[ends + 1] < priority[starts])
    stretch = np.cumsum(new) - 1
    return top[stretch] & ((np.arange(n) - starts[stretch]) % 2 == 0)


def re_pair(words: np.ndarray, owner: np.ndarray) -> Grammar:
    """Grammar of all texts (`owner`: ascending text numbers of the words), one tree for each.

    In each round every pair of neighbours that recurs, and recurs more often than the pairs it overlaps, becomes a
    nonterminal; the most frequent pair always does. A pair that occurs once never recurs later. What no longer repeats is
    joined two by two.
    """
    symbol, place, text = words.astype(np.int64), np.arange(len(words)), owner
    long = np.ones(int(words.max(initial=0)) + 1, np.int64)  # words of each symbol
    base = len(long)
    live = np.r_[text[1:] == text[:-1], False][: len(words)]
    first, left, nodes, places = [], [], [], []
    made, repeats = base, True
    while True:
        if repeats:
            at = np.flatnonzero(live)
            pair, number, count = np.unique(symbol[at] * made + symbol[np.minimum(at + 1, len(symbol) - 1)], return_inverse=True, return_counts=True)
            rank = np.zeros(len(pair), np.int64)
            rank[np.argsort(count, kind="stable")] = np.arange(1, len(pair) + 1)
            often = count[number] > 1
            live[at[~often]] = False
            priority = np.zeros(len(symbol), np.int64)
            priority[at] = rank[number] * often
            chosen = np.flatnonzero(in_pairs(priority))
            repeats = len(chosen) > 0
            if not repeats:
                continue
            name, where, of = np.unique(priority[chosen], return_index=True, return_inverse=True)
        else:
            starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]][: len(text)])
            at = np.arange(len(text)) - np.repeat(starts, np.diff(np.r_[starts, len(text)]))
            chosen = np.flatnonzero((at % 2 == 0) & np.r_[text[1:] == text[:-1], False][: len(text)])
            if not len(chosen):
                break
            name = where = of = np.arange(len(chosen))
        head = chosen[where]
        first.append(place[head])
        left.append(long[symbol[head]])
        long = np.r_[long, long[symbol[head]] + long[symbol[head + 1]]]
        nodes.append(of + made - base)
        places.append(place[chosen])
        symbol[chosen] = of + made
        made += len(name)
        live[chosen] = live[chosen + 1]
        keep = np.ones(len(symbol), bool)
        keep[chosen + 1] = False
        symbol, place, text, live = symbol[keep], place[keep], text[keep], live[keep]
    whole = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Grammar(whole(first), whole(left), long[base:], whole(nodes), whole(places))


class Extents:
    """How far words agree from two places on: numbers of stretches of 1, 2, 4, ... words, equal where the stretches are."""

    def __init__(self, words: np.ndarray, most: int):
        self.levels, n = [words.astype(np.int64)], len(words)
        while (1 << len(self.levels)) <= min(most, n):
            half, last = 1 << len(self.levels) - 1, self.levels[-1]
            key = last[: n - 2 * half + 1] * (last.max() + 1) + last[half : n - half + 1]
            self.levels.append(np.unique(key, return_inverse=True)[1])

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words equal from a and from b on, `most` at most."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            at = np.flatnonzero(done + (1 << k) <= most)
            same = self.levels[k][a[at] + done[at]] == self.levels[k][b[at] + done[at]]
            done[at[same]] += 1 << k
        return done

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words equal up to a and up to b (both left out), `most` at most."""
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            step = 1 << k
            at = np.flatnonzero(done + step <= most)
            same = self.levels[k][a[at] - done[at] - step] == self.levels[k][b[at] - done[at] - step]
            done[at[same]] += step
        return done


def near_places(grams: np.ndarray, order: np.ndarray, sought: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places p with low <= p <= high of the row and grams[p] = grams[sought]; `order` sorts places by gram."""
    n = len(grams)
    keyed = grams[order] * n + order
    a = np.searchsorted(keyed, grams[sought] * n + np.clip(low, 0, n - 1))
    b = np.searchsorted(keyed, grams[sought] * n + np.clip(high, 0, n - 1), side="right")
    count = np.maximum(b - a, 0)
    rows = np.repeat(np.arange(len(sought)), count)
    return rows, order[np.arange(count.sum()) + np.repeat(a - np.r_[0, np.cumsum(count)][:-1], count)]


def boundary_runs(words: np.ndarray, grammar: Grammar, most: int = 1 << 21) -> np.ndarray:
    """Rows (node, start after the node's place, length, period) of periodic stretches that cross nonterminals' boundaries.

    Inside a run of period q around boundary m some GRAM words recur q later (or earlier) next to m: those from m on, or those
    up to m. So only places of these two grams inside the nonterminal give periods to try.
    """
    big = np.flatnonzero(grammar.size >= LEAST)
    none = np.zeros((0, 4), np.int64)
    if not len(big):
        return none
    reach = Extents(words, int(grammar.size[big].max()))
    grams = np.full(len(words), -1, np.int64)
    level = reach.levels[GRAM.bit_length() - 1]
    grams[: len(level)] = level
    order = np.argsort(grams, kind="stable")
    found = []
    weight = np.r_[0, np.cumsum(grammar.size[big])][:-1] // most
    for some in np.split(big, np.flatnonzero(np.diff(weight)) + 1):
        begin, size = grammar.first[some], grammar.size[some]
        mid, end, third = begin + grammar.left[some], begin + size, size // TIMES
        candidates = []
        for shift, back, ahead in ((0, np.minimum(third, 2 * GRAM), third), (-GRAM, third, np.minimum(third, 2 * GRAM))):
            at = mid + shift
            fits = np.flatnonzero((at >= begin) & (at + GRAM <= end))
            at = at[fits]
            rows, places = near_places(grams, order, at, np.maximum(begin[fits], at - back[fits]), np.minimum(end[fits] - GRAM, at + ahead[fits]))
            away = places != at[rows]
            candidates.append((fits[rows[away]], np.minimum(places, at[rows])[away], np.abs(places - at[rows])[away]))
        node, low, period = (np.concatenate(c) for c in zip(*candidates, strict=True))
        # a node's period is tried once
        _, once = np.unique(node * (len(words) + 1) + period, return_index=True)
        node, low, period = node[once], low[once], period[once]
        up = reach.forward(low, low + period, end[node] - low - period)
        down = reach.backward(low, low + period, low - begin[node])
        start, length = low - down, down + period + up
        good = (length >= np.maximum(LEAST, TIMES * period)) & (start < mid[node]) & (start + length > mid[node])
        rows = np.stack([node, start - begin[node], length, period], 1)[good]
        # of equal stretches the smallest period counts; the others are its multiples
        rows = rows[np.lexsort(rows.T[::-1])]
        rows = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)][: len(rows)]]
        rows[:, 0] = some[rows[:, 0]]
        found.append(rows)
    return np.concatenate(found) if found else none


def text_runs(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, starts counted over all texts, by start and period."""
    grammar = re_pair(words, owner)
    rows = boundary_runs(words, grammar)
    order = np.argsort(grammar.nodes, kind="stable")
    edges = np.searchsorted(grammar.nodes[order], np.arange(len(grammar.first) + 1))
    count = (edges[1:] - edges[:-1])[rows[:, 0]]
    each = np.repeat(np.arange(len(rows)), count)
    at = grammar.places[order[np.arange(count.sum()) + np.repeat(edges[rows[:, 0]] - np.r_[0, np.cumsum(count)][:-1], count)]]
    start, length, period = at + rows[each, 1], rows[each, 2], rows[each, 3]
    # stretches of one period that share a period's words are one run; texts never share words
    order = np.lexsort((-length, start, period))
    start, end, period = start[order], (start + length)[order], period[order]
    wide = np.int64(len(words) + 1)
    furthest = np.maximum.accumulate(end + period * wide) - period * wide if len(end) else end
    new = np.r_[True, (period[1:] != period[:-1]) | (start[1:] > furthest[:-1] - period[1:])][: len(start)]
    at = np.flatnonzero(new)
    out = np.stack([start[at], np.maximum.reduceat(end, at) - start[at] if len(at) else start[at], period[at]], 1)
    out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
    out = out[np.r_[True, (out[1:, :2] != out[:-1, :2]).any(1)][: len(out)]]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def may_have_runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Texts in which enough grams come again: a run of LEAST words and TIMES periods holds GRAM + 1 of them at least."""
    if len(words) < LEAST:
        return np.zeros(len(sizes), bool)
    w = mix64(words.astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        h = np.zeros(len(w), np.uint64)
        for i in range(GRAM):
            h = h * np.uint64(0x9E3779B97F4A7C15)
            h[: len(w) - i] += w[i:]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        edges = np.r_[0, np.cumsum(sizes)]
        inside = np.flatnonzero(np.arange(len(w)) + GRAM <= edges[1:][owner])
        h = h[inside] ^ mix64(owner[inside].astype(np.uint64) + np.uint64(7))
    order = np.argsort(h, kind="stable")
    again = h[order][1:] == h[order][:-1]
    return np.bincount(owner[inside[order[1:][again]]], minlength=len(sizes)) > GRAM


def runs_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (start over all texts, length, period) by start and period, and the words that they repeat (as marks)."""
    drop = np.zeros(len(words) + 1, np.int64)
    some = may_have_runs(words, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    spots = np.flatnonzero(some[owner])
    found = np.zeros((0, 3), np.int64)
    if len(spots):
        found = text_runs(np.unique(words[spots], return_inverse=True)[1], owner[spots])
        found[:, 0] = spots[found[:, 0]]
        np.add.at(drop, found[:, 0] + found[:, 2], 1)
        np.add.at(drop, found[:, 0] + found[:, 1], -1)
    return found, np.cumsum(drop[:-1]) > 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def runs_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for b in batches if b.num_rows for part in slices(b, 1, SLICE_BYTES)):
        data, edges = joined(batch.column(1))
        starts, ends, sizes = spans(data, edges)
        found, drop = runs_of(numbered(data, starts, ends)[1], sizes)
        texts = np.r_[0, np.cumsum(sizes)]
        per_text = np.r_[0, np.cumsum(np.bincount(np.searchsorted(texts, found[:, 0], side="right") - 1, minlength=len(sizes)))]
        found[:, 0] -= np.repeat(texts[:-1], np.diff(per_text))
        runs = pa.StructArray.from_arrays([pa.array(found[:, i].copy()) for i in range(3)], fields=list(RUN))
        # kept words, each with a space behind it but a text's last
        keep = np.flatnonzero(~drop)
        wide = ends[keep] - starts[keep] + 1
        behind = np.r_[0, np.cumsum(wide)]
        body = np.r_[data, np.uint8(32)][np.repeat(starts[keep] - behind[:-1], wide) + np.arange(behind[-1])]
        body[behind[1:] - 1] = 32
        cuts = behind[np.searchsorted(keep, texts)]
        last = cuts[1:][cuts[1:] > cuts[:-1]] - 1
        kept = np.ones(len(body), bool)
        kept[last] = False
        offsets = np.r_[0, np.cumsum(np.diff(cuts) - (cuts[1:] > cuts[:-1]))]
        text = pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body[kept].tobytes())])
        columns = [batch.column(0), pa.array(sizes.astype(np.int64)), pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), runs), text.cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """Periodic runs of every whole text, and the text with each run cut to its first period.

    Words are runs of characters other than space, tab, line feed and the like, numbered from 0. A run is a stretch with
    smallest period q (words q apart are equal) of at least 24 words and 3 q, which no neighbouring word extends. Returns
    doc_id, n_words, runs (start, length, period; by start, then period), collapsed (words not repeated by a run, joined by one
    space).

    Texts are independent: a map without a shuffle. Those in which some eight words recur often enough go through the grammar,
    many at a time; a text is held whole in one task (about 200 bytes for each of its words). A null or empty text has no
    words, no runs and an empty text. Rows repeated, and null doc_ids, are rows of their own. An empty table gives no rows;
    other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(tidy(runs_in_batch), "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
