"""Repeated passages: buckets of q-grams refined by sorting on the bucket numbers of later offsets, until whole passages agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.llm.common import discard, documents, lookup, stored, tidy
from codicil.llm.words import mix64

LENGTH = 100  # bytes of a passage that is removed when it came before
GRAM = 25  # bytes of the first buckets; LENGTH is GRAM * 4
CHUNK = 2_000_000  # bytes of text handled at a time; longer texts are handled in stretches
TASK = 100_000  # open groups that one task of the last shuffle gets, about


def later_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as a number; beyond the end there are zeros."""
    padded = np.concatenate([data, np.zeros(15, np.uint8)])
    eight = np.empty(len(data), np.uint64)
    for shift in range(min(8, len(data))):
        some = padded[shift:]
        eight[shift::8] = some[: len(some) // 8 * 8].view("<u8")[: len(eight[shift::8])]
    return eight


def first_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket identifiers of the `GRAM` bytes at every position (the last positions get those of a padded text)."""
    eight = later_words(np.concatenate([data, np.zeros(GRAM, np.uint8)]))
    n = len(data)
    h = mix64(eight[:n] ^ np.uint64(0x9E3779B97F4A7C15))
    h = mix64(h + eight[8 : n + 8])
    h = mix64(h ^ eight[16 : n + 16])
    return mix64(h + eight[17 : n + 17])


def refined(buckets: np.ndarray, offset: int) -> np.ndarray:
    """Buckets told apart by the bucket at a later offset, mixed in by a hash: identifiers of twice as many bytes.

    The refined identifiers are themselves what the next refinement reads at its later offset.
    """
    later = np.concatenate([buckets[offset:], np.zeros(min(offset, len(buckets)), np.uint64)])
    return mix64(buckets * np.uint64(0xD6E8FEB86659FD93) + mix64(later + np.uint64(1)))


def digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A second identifier of the bytes [begin, end) of each row: their eight-byte words times odd numbers, summed."""
    words = later_words(data)
    counts = (end - begin) // 8
    row = np.repeat(np.arange(len(begin)), counts)
    step = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(counts)][:-1], counts)
    factor = mix64(np.arange(int(counts.max(initial=0)) + 1, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    parts = words[begin[row] + step * 8] * factor[step]
    total = words[np.maximum(end - 8, 0)] * np.uint64(0x9FB21C651E98DF25)  # the last eight bytes, whole words or not
    first = np.r_[0, np.cumsum(counts)][:-1]
    some = counts > 0
    if some.any():
        total[some] += np.add.reduceat(parts, first[some])
    return mix64(total)


def smallest_in_window(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of keys[i : i + width] for every i with a whole window."""
    low, have = keys, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: len(keys) - width + 1], low[width - have : width - have + len(keys) - width + 1])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Where to look: for every passage of `LENGTH` bytes, the q-gram in it with the smallest bucket hash (the first of equals).

    Equal passages pick the q-gram at the same place in them, so only these q-grams need buckets. Consecutive passages
    with one anchor form a group. Returns, by group: text, first and last start in the text, the anchor's place,
    identifiers of the q-gram, and of all the bytes that the group's passages cover, and the digest of these.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.r_[0, np.cumsum(sizes)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    width = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(3))
    grams = first_buckets(data)
    full = refined(refined(grams, GRAM), 2 * GRAM)
    place = np.uint64((1 << 28) - 1)
    keys = (mix64(grams + np.uint64(5)) & ~place) | np.arange(len(data), dtype=np.uint64)
    chosen = (smallest_in_window(keys, width) & place).astype(np.int64)
    del keys
    counts = np.maximum(sizes - LENGTH + 1, 0)
    starts = np.repeat(edges[:-1] - np.r_[0, np.cumsum(counts)][:-1], counts) + np.arange(counts.sum())
    at = chosen[starts]
    text = np.repeat(np.arange(len(texts)), counts)
    new = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])][: len(at)]
    begin = np.flatnonzero(new)
    end = np.r_[begin[1:], len(at)] - 1 if len(begin) else begin
    lo, hi, spot, own = starts[begin], starts[end], at[begin], text[begin]
    del chosen, starts, at, text, new
    cover = mix64(full[lo] + mix64(full[hi] ^ ((spot - lo).astype(np.uint64) << np.uint64(32)) ^ (hi - spot).astype(np.uint64)))
    return own, lo - edges[own], hi - edges[own], spot - edges[own], grams[spot], cover, digests(data, lo, hi + LENGTH)


def stretches(texts: list[bytes]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of texts, and stretches of long ones: number of the first text, place in it, texts. Every passage is whole in one."""
    begin = 0
    for i in [i for i, t in enumerate(texts) if len(t) > 2 * CHUNK]:
        if begin < i:
            yield begin, 0, texts[begin:i]
        for at in range(0, len(texts[i]) - LENGTH + 1, CHUNK):
            yield i, at, [texts[i][at : at + CHUNK + LENGTH - 1]]
        begin = i + 1
    if begin < len(texts):
        yield begin, 0, texts[begin:]


def chunks(batch: pa.RecordBatch, column: int, size: int = CHUNK) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows [a, b) of a batch with their texts as bytes, about `size` bytes at a time; only these are copied."""
    texts = batch.column(column)
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(np.r_[0, np.searchsorted(sizes, np.arange(size, sizes[-1] if len(sizes) else 0, size)) + 1, len(texts)])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(a), int(b), texts.slice(a, b - a).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def merged(doc: np.ndarray, part: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of passage starts: intervals [lo, hi] that touch or overlap become one."""
    if not len(doc):
        return doc, part, lo, hi
    order = np.lexsort((lo, part, doc))
    doc, part, lo, hi = doc[order], part[order], lo[order], hi[order]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])]
    # starts are below 2**40, so a running maximum per document is one over shifted values
    base = np.cumsum(fresh) << 40
    reach = np.maximum.accumulate(hi + base)
    new = fresh.copy()
    new[1:] |= (lo + base)[1:] > reach[:-1] + 1
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(doc)] - 1
    return doc[begin], part[begin], lo[begin], reach[last] - base[last]


#: kind of a row that is known to repeat an earlier one, that a q-gram's bucket judges, that surely shares its q-gram
KNOWN, OPEN, SHARED = 0, 1, 2
GROUP = "kind int, doc_id long, k int, lo long, hi long, gram long, cover long, digest long"
SHARE = 8  # groups with different bytes that a chunk sends to one q-gram's bucket at most


def group_batch(kind: np.ndarray | int, doc: np.ndarray, k: np.ndarray, lo: np.ndarray, hi: np.ndarray, gram: np.ndarray | None = None, cover: np.ndarray | None = None, digest: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(doc)
    columns = [
        np.broadcast_to(np.int32(kind), n) if np.isscalar(kind) else kind.astype(np.int32), doc, k.astype(np.int32), lo, hi,
        *[np.zeros(n, np.int64) if c is None else c.view(np.int64) for c in (gram, cover, digest)],
    ]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["kind", "doc_id", "k", "lo", "hi", "gram", "cover", "digest"])


def find_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of passages of batches (doc_id, k, text), reduced within each chunk of text.

    Of groups with the same bytes only the first stays open; the others repeat it whatever other chunks hold. A bucket
    gets at most `SHARE` of a chunk's groups with different bytes; the rest are spread by their bytes, and are known to
    share their q-gram.
    """
    for batch in batches:
        ids, ks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, base, part in ((a + i, base, part) for a, _, texts in chunks(batch, 2) for i, base, part in stretches(texts)):
            own, lo, hi, _, gram, cover, digest = anchors(part)
            if not len(own):
                continue
            doc, k, lo, hi = ids[a + own], ks[a + own], lo + base, hi + base
            order = np.lexsort((lo, k, doc, digest, cover, gram))
            doc, k, lo, hi, gram, cover, digest = (x[order] for x in (doc, k, lo, hi, gram, cover, digest))
            new_gram = np.r_[True, gram[1:] != gram[:-1]]
            first = new_gram | np.r_[True, (cover[1:] != cover[:-1]) | (digest[1:] != digest[:-1])]
            yield group_batch(KNOWN, *merged(doc[~first], k[~first], lo[~first], hi[~first]))
            doc, k, lo, hi, gram, cover, digest, new_gram = (x[first] for x in (doc, k, lo, hi, gram, cover, digest, new_gram))
            begin = np.flatnonzero(new_gram)
            place = np.arange(len(gram)) - np.repeat(begin, np.diff(np.r_[begin, len(gram)]))
            yield group_batch(np.where(place < SHARE, OPEN, SHARED), doc, k, lo, hi, gram, cover, digest)


def judge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judge a partition of groups: those whose bytes came before are known; those alone in their bucket are done.

    What remains are first groups of buckets with several; their passages differ as wholes but may agree in part.
    """
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    kind, doc, k, lo, hi, gram, cover, digest = (table.column(i).to_numpy() for i in range(8))
    order = np.flatnonzero(kind != KNOWN)
    order = order[np.lexsort((lo[order], k[order], doc[order], digest[order], cover[order], gram[order]))]
    g, c, d = gram[order], cover[order], digest[order]
    new_gram = np.r_[True, g[1:] != g[:-1]][: len(g)]
    first = new_gram | np.r_[True, (c[1:] != c[:-1]) | (d[1:] != d[:-1])][: len(g)]
    number = np.cumsum(new_gram) - 1
    several = np.bincount(number[first], minlength=new_gram.sum()) > 1
    left = order[first & (several[number] | (kind[order] == SHARED))]
    again = np.concatenate([np.flatnonzero(kind == KNOWN), order[~first]])
    yield group_batch(KNOWN, *merged(doc[again], k[again], lo[again], hi[again]))
    yield group_batch(OPEN, doc[left], k[left], lo[left], hi[left], gram[left], cover[left], digest[left])


HOT = 256  # groups of one q-gram from which on each passage goes its own way instead of the whole bucket to one task
PASSAGE = "known boolean, route long, digest long, doc_id long, k int, lo long, hi long, cut binary"


def window_starts(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every start of the groups [lo, hi], and its group."""
    counts = hi - lo + 1
    group = np.repeat(np.arange(len(lo)), counts)
    return np.arange(len(group)) - np.repeat(np.r_[0, np.cumsum(counts)][:-1], counts) + lo[group], group


def passage_batch(known: bool, route: np.ndarray, digest: np.ndarray, doc: np.ndarray, k: np.ndarray, lo: np.ndarray, hi: np.ndarray, cuts: list[bytes] | None = None) -> pa.RecordBatch:
    cut = pa.nulls(len(doc), pa.binary()) if cuts is None else pa.array(cuts, pa.binary())
    whole = [np.broadcast_to(known, len(doc)), route.view(np.int64), digest.view(np.int64), doc, k, lo, hi]
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in whole), cut], names=["known", "route", "digest", "doc_id", "k", "lo", "hi", "cut"])


def hot_passages(cuts: list[bytes], doc: np.ndarray, k: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each passage of groups of hot q-grams, by two identifiers; of equal ones of these groups only the first goes on, the others are known."""
    edges = np.r_[0, np.cumsum([len(c) for c in cuts])]
    data = np.frombuffer(b"".join(cuts), np.uint8)
    full = refined(refined(first_buckets(data), GRAM), 2 * GRAM)
    starts, group = window_starts(lo, hi)
    at = edges[group] + starts - lo[group]
    route, digest, doc, k = full[at], digests(data, at, at + LENGTH), doc[group], k[group]
    order = np.lexsort((starts, k, doc, digest, route))
    route, digest, doc, k, starts = (x[order] for x in (route, digest, doc, k, starts))
    first = np.r_[True, (route[1:] != route[:-1]) | (digest[1:] != digest[:-1])]
    yield passage_batch(False, route[first], digest[first], doc[first], k[first], starts[first], starts[first])
    doc, k, a, b = merged(doc[~first], k[~first], starts[~first], starts[~first])
    yield passage_batch(True, mix64(doc.view(np.uint64) + a.view(np.uint64)), np.zeros(len(doc), np.uint64), doc, k, a, b)


def cut_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of open groups of batches (doc_id, k, text, groups) the bytes, or for hot q-grams each passage."""
    for batch in batches:
        ids, ks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        groups = batch.column(3)
        edges = groups.offsets.to_numpy()
        flat = groups.values
        lo, hi, gram, n = (flat.field(f).to_numpy() for f in ("lo", "hi", "gram", "n"))
        for a, b, texts in chunks(batch, 2):
            own = np.repeat(np.arange(b - a), np.diff(edges[a : b + 1]))
            for start in range(0, len(own), TASK):  # a long text has many
                at = np.arange(edges[a] + start, min(edges[b], edges[a] + start + TASK))
                who = own[start : start + len(at)]
                cuts = [texts[o][x : y + LENGTH] for o, x, y in zip(who.tolist(), lo[at].tolist(), hi[at].tolist(), strict=True)]
                hot = n[at] >= HOT
                cool, warm = np.flatnonzero(~hot), np.flatnonzero(hot)
                yield passage_batch(False, gram[at][cool], np.zeros(len(cool), np.uint64), ids[a + who[cool]], ks[a + who[cool]], lo[at][cool], hi[at][cool], [cuts[i] for i in cool])
                if len(warm):
                    yield from hot_passages([cuts[i] for i in warm], ids[a + who[warm]], ks[a + who[warm]], lo[at][warm], hi[at][warm])


def bucket_numbers(keys: np.ndarray) -> np.ndarray:
    """Each key's bucket, numbered in sorted order; -1 for a key that is alone in its own."""
    order = np.argsort(keys)
    new = np.r_[True, keys[order][1:] != keys[order][:-1]][: len(keys)]
    number = np.cumsum(new) - 1
    out = np.empty(len(keys), np.int64)
    out[order] = np.where(np.bincount(number)[number] > 1, number, -1) if len(keys) else number
    return out


def passage_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the `LENGTH` bytes from every position on, -1 where no other position has the same.

    Buckets of `GRAM` bytes are refined by sorting on the pair of a position's bucket and the bucket `GRAM` bytes later; the
    new buckets are the pointers of the next refinement, at twice the offset. A position alone in its bucket is done.
    """
    number, offset = bucket_numbers(first_buckets(data)), GRAM
    while offset < LENGTH:
        later = np.concatenate([number[offset:], np.full(min(offset, len(number)), -1)])
        some = np.flatnonzero((number >= 0) & (later >= 0))
        fresh = np.full(len(number), -1)
        fresh[some] = bucket_numbers(number[some] * (len(number) + 1) + later[some])
        number, offset = fresh, 2 * offset
    return number


def same_bytes(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the `LENGTH` bytes at positions a[i] and b[i] are equal; `words` as of `later_words`."""
    same = np.ones(len(a), bool)
    for step in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        same &= words[a + step] == words[b + step]
    return same


def repeated(data: np.ndarray, at: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Which passages at positions `at` have the same bytes as one before them in the order of the keys `order` (first key first)."""
    number = passage_buckets(data)[at]
    some = np.flatnonzero(number >= 0)
    some = some[np.lexsort((*[c[some] for c in reversed(order)], number[some]))]
    new = np.r_[True, number[some][1:] != number[some][:-1]][: len(some)]
    first = some[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(some) else some
    words = later_words(data)
    same = same_bytes(words, at[some], at[first])
    out = np.zeros(len(at), bool)
    out[some[~new & same]] = True
    for i in some[~same]:  # first buckets are hashes: where two q-grams share one, compare with each passage before
        before = some[(number[some] == number[i]) & (np.arange(len(some)) < np.flatnonzero(some == i)[0])]
        out[i] = same_bytes(words, np.full(len(before), at[i]), at[before]).any()
    return out


def judge_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of a partition that came before, as runs of starts."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows).combine_chunks()
    known, route, digest, doc, k, lo, hi = (table.column(i).to_numpy(zero_copy_only=False) for i in range(7))
    cut = table.column(7).combine_chunks()
    whole = np.flatnonzero(cut.is_valid().to_numpy(zero_copy_only=False))
    yield group_batch(KNOWN, doc[known], k[known], lo[known], hi[known])
    lone = np.flatnonzero(~known & cut.is_null().to_numpy(zero_copy_only=False))
    lone = lone[np.lexsort((lo[lone], k[lone], doc[lone], digest[lone], route[lone]))]
    again = lone[~np.r_[True, (route[lone][1:] != route[lone][:-1]) | (digest[lone][1:] != digest[lone][:-1])][: len(lone)]]
    yield group_batch(KNOWN, *merged(doc[again], k[again], lo[again], lo[again]))
    # whole routes, few enough at a time
    whole = whole[np.argsort(route[whole], kind="stable")]
    ends = np.cumsum(hi[whole] - lo[whole] + LENGTH)
    last = np.flatnonzero(np.r_[route[whole][1:] != route[whole][:-1], True][: len(whole)])
    cuts = np.unique(np.r_[0, last[np.searchsorted(ends[last], np.arange(CHUNK, ends[-1] if len(ends) else 0, CHUNK))] + 1, len(whole)])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = whole[a:b]
        held = cut.take(pa.array(part)).to_pylist()
        starts, group = window_starts(lo[part], hi[part])
        at = np.r_[0, np.cumsum([len(c) for c in held])][group] + starts - lo[part][group]
        who = part[group]
        again = repeated(np.frombuffer(b"".join(held), np.uint8), at, doc[who], k[who], starts)
        yield group_batch(KNOWN, *merged(doc[who][again], k[who][again], starts[again], starts[again]))


def whole_characters(text: bytes, lo: int, hi: int) -> tuple[int, int]:
    """[lo, hi) widened to all bytes of characters that it covers in part."""
    while 0 < lo < len(text) and text[lo] & 0xC0 == 0x80:
        lo -= 1
    while hi < len(text) and text[hi] & 0xC0 == 0x80:
        hi += 1
    return lo, hi


def remove(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Take the covered bytes out of batches (doc_id, k, text, runs, and columns to hand on).

    With `whole`, `kept` also lacks the other bytes of characters that a cut goes through.
    """
    for batch in batches:
        runs = batch.column(3)
        edges = runs.offsets.to_numpy()
        lo, hi = (runs.values.field(f).to_numpy() for f in ("lo", "hi"))
        for a, b, texts in chunks(batch, 2):
            part = slice(edges[a], edges[b])
            own = np.repeat(np.arange(b - a), np.diff(edges[a : b + 1]))
            own, _, begin, last = merged(own, own * 0, lo[part], hi[part] + LENGTH - 1)
            spans = np.bincount(own, minlength=b - a)
            gone = np.bincount(own, last + 1 - begin, b - a).astype(np.int64)
            kept = list(texts)
            at = np.r_[0, np.cumsum(spans)].tolist()
            for i in np.flatnonzero(spans).tolist():
                text, left, pieces = texts[i], 0, []
                for x, y in zip(begin[at[i] : at[i + 1]].tolist(), (last[at[i] : at[i + 1]] + 1).tolist(), strict=True):
                    x, y = whole_characters(text, x, y) if whole else (x, y)
                    pieces.append(text[left : max(left, x)])
                    left = max(left, y)
                kept[i] = b"".join([*pieces, text[left:]])
            columns = [
                *[c.slice(a, b - a) for c in (batch.column(0), *batch.columns[4:])], pa.array([len(t) for t in texts], pa.int64()), pa.array(gone), pa.array(spans.astype(np.int64)), pa.array(kept, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *batch.schema.names[4:], "n_bytes", "n_removed", "n_spans", "kept"])


def numbered(base: DataFrame) -> tuple[DataFrame, bool]:
    """Rows (doc_id, k, text) where k tells apart different texts of one doc_id, by their SHA-256; equal rows share a k; and whether
    any doc_id has several rows."""
    several = base.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    several = stored(several, "several")
    if several.isEmpty():
        return base.withColumn("k", F.lit(0)), False
    own = base.join(several, "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("digest")).distinct()
    ranked = own.groupBy("doc_id").agg(F.sort_array(F.collect_list("digest")).alias("all"))
    met = base.withColumn("digest", F.sha2("text", 256)).join(ranked, "doc_id", "left")
    return met.withColumn("k", F.coalesce(F.array_position("all", F.col("digest")).cast("int"), F.lit(0))).drop("digest", "all"), True


def remove_repeats(docs: DataFrame, carry: list[str] | None = None, whole: bool = False) -> DataFrame:
    """Remove each byte of every text that a passage of `LENGTH` bytes covers which also starts earlier.

    Earlier: in a smaller doc_id, or at an earlier start of the same text; passages may overlap, never cross texts, and
    are judged on the input. Returns doc_id, n_bytes, n_removed, n_spans (runs removed) and kept (the other bytes), a row
    for each row of `docs`. Null texts are empty, null doc_ids come first; texts under `LENGTH` bytes keep all; different
    texts of one doc_id are ordered by SHA-256, and equal rows count as one text, so they keep the same bytes; an empty
    table gives no rows. Columns named in `carry` are handed on but
    for those named like an output, others ignored.

    Tasks agree on q-grams by 64-bit hashes. Groups of passages with equal bytes are told by three such, of the q-gram and
    two of all bytes; passages of different groups by refining buckets of their bytes, which are then compared; those of
    q-grams with `HOT` groups or more by two. A partition of the shuffles is held in memory: it has about `TASK` groups in
    the last, and in the first what spark.sql.shuffle.partitions and the advisory partition size give it.
    """
    none = -(1 << 63)
    carry = [c for c in carry or [] if c not in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")]
    base, several = numbered(documents(docs, *carry).withColumn("doc_id", F.coalesce("doc_id", F.lit(none))))
    once = base.select("doc_id", "k", "text")
    once = once.dropDuplicates(["doc_id", "k"]) if several else once
    groups = once.mapInArrow(tidy(find_groups), GROUP)
    route = F.when(F.col("kind") == KNOWN, F.xxhash64("doc_id", "lo")).when(F.col("kind") == OPEN, F.col("gram")).otherwise(F.col("cover"))
    judged = stored(groups.repartition(route).mapInArrow(tidy(judge_groups), GROUP), "groups")
    left = judged.filter(F.col("kind") == OPEN).select("doc_id", "k", "lo", "hi", "gram")
    total = left.count()
    n = stored(left.groupBy("gram").agg(F.count("*").alias("n")), "buckets")
    left = lookup(left, n, "gram", "n", total)
    by_doc = left.groupBy("doc_id", "k").agg(F.collect_list(F.struct("lo", "hi", "gram", "n")).alias("groups"))
    passages = once.join(by_doc, ["doc_id", "k"]).select("doc_id", "k", "text", "groups").mapInArrow(tidy(cut_passages), PASSAGE)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK)
    found = stored(passages.repartition(parts, "route").mapInArrow(tidy(judge_passages), GROUP), "passages")
    runs = judged.filter(F.col("kind") == KNOWN).unionByName(found).groupBy("doc_id", "k").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    runs = stored(runs, "runs")
    discard(judged, n, found)
    no_runs = F.expr("filter(array(named_struct('lo', 0L, 'hi', 0L)), x -> false)")
    met = base.join(runs, ["doc_id", "k"], "left").select("doc_id", "k", "text", F.coalesce("runs", no_runs).alias("runs"), *carry)
    more = "".join(f"`{c}` {met.schema[c].dataType.simpleString()}, " for c in carry)
    out = met.mapInArrow(tidy(lambda b: remove(b, whole)), f"doc_id long, {more}n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("doc_id") != none, F.col("doc_id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept", *carry)
