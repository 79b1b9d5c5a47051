"""N-gram Jaccard join: prefix tokens deal sets out, an R-tree over count vectors prunes pairs, survivors are verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.llm.common import discard, documents, small_batches, stored, tidy
from codicil.llm.components import components
from codicil.llm.repeats import chunks
from codicil.llm.shingles import in_order, shingle_sets
from codicil.llm.words import mix64

PERCENT = 80  # linked if 100 * intersection >= PERCENT * union
GROUPS = 256  # coordinates of a count vector
COARSE = 64  # coordinates of an R-tree's points, sums of neighbours of these
LEAF = 16  # points of an R-tree's leaf
CENTERS = 4  # nodes of a block that are tried with all its others first
SLICE = 1500  # rows of a block that one task joins at most
CHUNK = 2_000_000  # bytes of text handled at a time, or one text
ROWS = 2000  # texts, or sets of fine groups, that one task tests, about
BLOCK_ROWS = 100_000  # rows of blocks that one task joins, about
VALUES = 2_000_000  # fine groups compared at a time, or those of one route
FREQUENT = 1000  # a shingle in more than 1/FREQUENT of all texts comes last in the order of prefixes


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest intersection of linked sets with a and b elements: PERCENT / (100 + PERCENT) of their sum, rounded up."""
    return -(-(PERCENT * (a.astype(np.int64) + b)) // (100 + PERCENT))


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound of the intersections of sets with count vectors a and b: the sum of coordinate minima."""
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64)


def coarse(counts: np.ndarray) -> np.ndarray:
    """Count vectors of COARSE coordinates: the bound over them is weaker, so it excludes no more."""
    return narrow(counts.reshape(len(counts), COARSE, -1).sum(axis=2, dtype=np.uint32))


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 16 bits if all fit, else in 32."""
    return counts.astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.uint32)


def kept_pairs(a: np.ndarray, b: np.ndarray, counts_a: np.ndarray, sizes_a: np.ndarray, counts_b: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """Which pairs of rows a and b the bound leaves, a few at a time."""
    step = 1 << 14
    parts = [overlap_bound(counts_a[a[i : i + step]], counts_b[b[i : i + step]]) >= least_overlap(sizes_a[a[i : i + step]], sizes_b[b[i : i + step]]) for i in range(0, len(a), step)]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


class RTree:
    """Packed R-tree over count vectors: each node keeps the largest coordinates and the smallest size below it."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        order = np.arange(len(sizes))
        # halve along the coordinate that varies most, until parts fit a leaf
        todo, parts = [order], []
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                parts.append(part)
                continue
            points = np.column_stack([counts[part], sizes[part]])
            axis = int(np.argmax(points.max(0) - points.min(0)))
            part = part[np.argsort(points[:, axis], kind="stable")]
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
        self.points = np.concatenate(parts)
        starts = np.r_[0, np.cumsum([len(p) for p in parts])][:-1]
        top, low = np.maximum.reduceat(counts[self.points], starts, axis=0), np.minimum.reduceat(sizes[self.points], starts)
        self.levels = [(top, low)]
        while len(low) > 1:
            at = np.arange(0, len(low), 4)
            top, low = np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at)
            self.levels.append((top, low))
        self.leaf = (starts, np.r_[starts[1:], len(self.points)])
        self.counts, self.sizes = counts, sizes

    def pairs(self, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) pairs whose bound reaches the overlap that links them; subtrees that can't are left out."""
        query, node = np.arange(len(sizes)), np.zeros(len(sizes), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            top, low = self.levels[level]
            keep = kept_pairs(query, node, counts, sizes, top, low)
            query, node = query[keep], node[keep]
            if level:
                below = len(self.levels[level - 1][1])
                query, node = np.repeat(query, 4), (node[:, None] * 4 + np.arange(4)).ravel()
                query, node = query[node < below], node[node < below]
        starts, ends = self.leaf
        width = ends[node] - starts[node]
        query = np.repeat(query, width)
        point = self.points[np.repeat(starts[node] - np.r_[0, np.cumsum(width)][:-1], width) + np.arange(width.sum())]
        keep = kept_pairs(query, point, counts, sizes, self.counts, self.sizes)
        return query[keep], point[keep]


def frequent_shingles(base: DataFrame) -> np.ndarray:
    """Shingles of more than 1/FREQUENT of all texts: at most FREQUENT times the mean number of shingles of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in chunks(batch, 1, CHUNK):
                h, _ = shingle_sets(texts)
                h.sort()
                begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
                found, n = h[begin], np.diff(np.r_[begin, len(h)])
                some = n > max(1, len(texts) // (2 * FREQUENT))
                yield pa.RecordBatch.from_arrays([pa.array(found[some].view(np.int64)), pa.array(n[some])], names=["h", "n"])

    rows = base.mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    least = base.count() // FREQUENT + 8
    return np.sort(rows.filter(F.col("n") > least).select("h").toPandas()["h"].to_numpy(np.int64))


def describe(batches: Iterator[pa.RecordBatch], last: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Size, identifier, prefix and fine groups of the shingle set of batches (doc_id, text).

    The prefix: linked sets share one of the first size - least overlap + 1 elements, in an order common to all sets. A fine
    group is the first 16 bits of a shingle's identifier; of a set's groups, which ascend, all low bytes come first, then all
    high ones, which are few runs.
    """
    for batch in batches:
        for a, b, texts in chunks(batch, 1, CHUNK):
            h, sizes = shingle_sets(texts)
            edges = np.r_[0, np.cumsum(sizes)]
            text = np.repeat(np.arange(len(sizes)), sizes)
            total = np.zeros(len(sizes), np.uint64)
            np.add.at(total, text, mix64(h ^ np.uint64(0xA5A5A5A5)))
            node = mix64(total + sizes.astype(np.uint64)).view(np.int64)
            signed = h.view(np.int64)
            spot = np.minimum(np.searchsorted(last, signed), max(0, len(last) - 1))
            rank = (last[spot] == signed) if len(last) else np.zeros(len(h), bool)
            # identifiers are hashes and ascend, so their order is random; frequent ones come last
            order = in_order(text * 2 + rank, 2 * len(texts))
            # a set of n elements shares at least ceil(n * PERCENT / 100) with any linked one
            length = np.where(sizes > 0, sizes - (-(-sizes * PERCENT // 100)) + 1, 0)
            inside = np.arange(len(h)) - edges[text]
            chosen = order[inside < length[text]]
            low, high = ((h >> np.uint64(shift)).astype(np.uint8) for shift in (48, 56))
            prefix = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(signed[chosen]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(node), prefix,
                    pa.array([low[x:y].tobytes() + high[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)], pa.binary()),
                ],
                names=["doc_id", "n", "node", "prefix", "fine"],
            )


def fine_groups(rows: list[bytes]) -> np.ndarray:
    """Low and high bytes of the fine groups of sets, set after set, as two rows."""
    return np.concatenate([np.zeros((2, 0), np.uint8), *[np.frombuffer(r, np.uint8).reshape(2, -1) for r in rows]], axis=1)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count vectors of batches (node, n, fine): how many shingles have each high byte."""
    for batch in batches:
        n = batch.column(1).to_numpy()
        high = fine_groups(batch.column(2).to_pylist())[1].astype(np.int64)
        counts = np.bincount(np.repeat(np.arange(len(n)), n) * GROUPS + high, minlength=len(n) * GROUPS).reshape(-1, GROUPS)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([narrow(c).tobytes() for c in counts], pa.binary())], names=["node", "n", "counts"])


def vectors(counts: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Count vectors from their bytes: 16 bits a count, or 32 in rows that `narrow` left wide."""
    rows = counts.to_pylist()
    if all(len(r) == 2 * GROUPS for r in rows):
        return np.frombuffer(b"".join(rows), np.uint16).reshape(-1, GROUPS)
    return np.stack([np.frombuffer(r, np.uint16 if len(r) == 2 * GROUPS else np.uint32).astype(np.uint32) for r in rows])


def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in each block of rows (route, side, node, n, root, counts), by an R-tree of the block.

    Side 2 rows are queries and points; where a large block was sliced, side 0 rows are points and side 1 rows queries.
    """
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    route, side, node, n, root = (table.column(i).to_numpy() for i in range(5))
    counts = vectors(table.column(5))
    points_of = coarse(counts)
    order = np.lexsort((node, route))
    edges = np.flatnonzero(np.r_[True, route[order][1:] != route[order][:-1], True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = order[a:b]
        if b - a == 2:
            x, y = part[:1], part[1:]
            good = (root[x] != root[y]) & (side[x] + side[y] != 0) & (overlap_bound(counts[x], counts[y]) >= least_overlap(n[x], n[y]))
            x, y = x[good], y[good]
        else:
            points, queries = part[side[part] != 1], part[side[part] != 0]
            if not len(points) or not len(queries):
                continue
            q, p = RTree(points_of[points], n[points]).pairs(points_of[queries], n[queries])
            x, y = queries[q], points[p]
            good = (root[x] != root[y]) & (node[x] != node[y])
            x, y = x[good], y[good]
            good = kept_pairs(x, y, counts, n, counts, n)  # the same bound over all coordinates
            x, y = x[good], y[good]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], names=["a", "b"])


def whole_routes(route: np.ndarray, weight: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Row numbers of some routes after the other, whole ones, whose rows weigh about `most` together."""
    order = np.argsort(route, kind="stable")
    total = np.cumsum(weight[order])
    last = np.flatnonzero(np.r_[route[order][1:] != route[order][:-1], True][: len(order)])
    cuts = np.unique(np.r_[0, last[np.searchsorted(total[last], np.arange(most, total[-1] if len(total) else 0, most))] + 1, len(order)])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield order[a:b]


def held_by_centers(route: np.ndarray, center: np.ndarray, node: np.ndarray, sizes: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with `sizes` keys each, which are no centers, how many keys each has in common with its route's center, and the center's size (0: none)."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    is_center = center == node
    held = np.unique(key[is_center[owner]])
    _, number = np.unique(route, return_inverse=True)
    size_of = np.zeros(number.max(initial=-1) + 1, np.int64)
    size_of[number[is_center]] = sizes[is_center]
    if not len(held):
        return ~is_center, np.zeros(len(sizes), np.int64), size_of[number]
    spot = np.minimum(np.searchsorted(held, key), len(held) - 1)
    return ~is_center, np.bincount(owner, held[spot] == key, len(sizes)).astype(np.int64), size_of[number]


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows (route, center, node, text): in each route, the center's set against the others', exactly.

    A task's texts are held as bytes; only the shingles of some routes at a time are.
    """
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    del rows
    for some in whole_routes(table.column(0).to_numpy(), pc.binary_length(table.column(3)).to_numpy().astype(np.int64), CHUNK):
        kept = []
        for batch in table.take(pa.array(some)).to_batches():
            for a, b, texts in chunks(batch, 3, CHUNK):
                h, sizes = shingle_sets(texts)
                total = np.zeros(len(sizes), np.uint64)
                np.add.at(total, np.repeat(np.arange(len(sizes)), sizes), mix64(h ^ np.uint64(0xA5A5A5A5)))
                route, center, node = (batch.column(i).slice(a, b - a).to_numpy() for i in range(3))
                # rows that only share a doc_id with the wanted text are left out
                real = mix64(total + sizes.astype(np.uint64)).view(np.int64) == node
                kept.append((route[real], center[real], node[real], sizes[real], mix64(h ^ mix64(np.repeat(route.view(np.uint64), sizes)))[np.repeat(real, sizes)]))
        route, center, node, sizes, key = (np.concatenate(x) for x in zip(*kept, strict=True))
        del kept
        other, common, size_of = held_by_centers(route, center, node, sizes, key)
        good = other & (size_of > 0) & (100 * common >= PERCENT * (sizes + size_of - common))
        yield pa.RecordBatch.from_arrays([pa.array(center[good]), pa.array(node[good])], names=["a", "b"])


def closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (route, center, node, n, fine), the pairs of center and node that the bound over fine groups leaves.

    The sum of smaller counts is the size of a common multiset. Some routes are handled at a time.
    """
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    del rows
    every = [table.column(i).to_numpy() for i in range(4)]
    for some in whole_routes(every[0], every[3], VALUES):
        route, center, node, n = (x[some] for x in every)
        _, number = np.unique(route, return_inverse=True)
        low, high = fine_groups(table.column(4).take(pa.array(some)).to_pylist()).astype(np.uint64)
        owner = np.repeat(np.arange(len(n)), n)
        # the values of each row ascend: number equal ones
        key = (owner.astype(np.uint64) << np.uint64(16)) | (high << np.uint64(8)) | low
        begin = np.r_[True, key[1:] != key[:-1]]
        again = np.arange(len(key)) - np.maximum.accumulate(np.where(begin, np.arange(len(key)), 0))
        key = (number[owner].astype(np.uint64) << np.uint64(32)) | ((key & np.uint64(0xFFFF)) << np.uint64(16)) | np.minimum(again, 0xFFFF).astype(np.uint64)
        other, common, size_of = held_by_centers(route, center, node, n, key)
        good = other & (size_of > 0) & (common >= least_overlap(n, size_of))
        yield pa.RecordBatch.from_arrays([pa.array(center[good]), pa.array(node[good])], names=["a", "b"])


def routed(pairs: DataFrame) -> DataFrame:
    """Roles (route, center, node) of pairs (a, b): a center's partners are split into routes of about 256."""
    width = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).cast("int").alias("s"))
    member = pairs.join(width, "a").select(F.col("b").alias("node"), F.col("a").alias("center"), F.pmod(F.xxhash64("b"), F.col("s")).cast("int").alias("slice"))
    own = width.select(F.col("a").alias("node"), F.col("a").alias("center"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("slice"))
    return member.unionByName(own).select(F.xxhash64("center", "slice").alias("route"), "center", "node")


def by_route(rows: DataFrame, n: int, most: int) -> DataFrame:
    """Rows dealt out by route, about `most` of the `n` rows to a task: a task holds its rows, whatever the table's size."""
    return rows.repartition(max(n // most + 1, rows.sparkSession.sparkContext.defaultParallelism), "route")


def shared_elements(shared: DataFrame) -> DataFrame:
    """Rows (node, n, marks): elements of a prefix that other prefixes have, in 32 bits; null where two of a prefix are equal in these."""
    found = shared.groupBy("node", "n").agg(F.collect_set(F.hash("token")).alias("marks"), F.count("*").alias("m"))
    return found.select("node", "n", F.when(F.size("marks") == F.col("m"), F.col("marks")).alias("marks"))


def sharing(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Of the pairs (a, b), each once, those whose prefixes share as many elements as linked sets must, by `shared_elements`: these may
    agree where elements do not, so no pair is lost.

    The smallest l elements that sets with an overlap of at least o have in common lie in the first size - o + l elements of both.
    A prefix is as long for l = o - ceil(larger size * PERCENT / 100) + 1, so sets that meet by chance in an element or two go.
    """
    ends = [marks.select(F.col("node").alias(e), F.col("n").alias(f"n_{e}"), F.col("marks").alias(f"marks_{e}")) for e in ("a", "b")]
    met = pairs.distinct().join(ends[0], "a").join(ends[1], "b")
    least = f"(({PERCENT} * (n_a + n_b) + {99 + PERCENT}) div {100 + PERCENT}) - ((greatest(n_a, n_b) * {PERCENT} + 99) div 100) + 1"
    unknown = F.col("marks_a").isNull() | F.col("marks_b").isNull()
    return met.filter(unknown | (F.size(F.array_intersect("marks_a", "marks_b")) >= F.expr(least))).select("a", "b")


def near_pairs(pairs: DataFrame, nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """Of the pairs (a, b), each once, those that the shared elements and then the bound over fine groups leave."""
    pairs = stored(sharing(pairs, marks), "pairs")
    fine = routed(pairs).join(nodes.select("node", "n", "fine"), "node").select("route", "center", "node", "n", "fine")
    near = stored(by_route(fine, 2 * pairs.count(), ROWS).mapInArrow(tidy(closer), "a long, b long"), "near")
    discard(pairs)
    return near


def texts_of(pairs: DataFrame, nodes: DataFrame, base: DataFrame) -> DataFrame:
    """Rows of `base` that hold a text of the nodes in the pairs (a, b): all that their tests read."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(ends.join(nodes.select("node", "first_doc"), "node").select(F.col("first_doc").alias("doc_id")).distinct(), "wanted")
    texts = stored(base.join(wanted, "doc_id", "left_semi"), "texts")
    discard(wanted)
    return texts


def tested(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among the pairs (a, b), from their texts."""
    # a node's roles: its partners as a member, its partners / 256 as a center
    roles = routed(pairs).join(nodes.select("node", "first_doc"), "node").groupBy("first_doc").agg(F.collect_list(F.struct("route", "center", "node")).alias("roles"))
    rows = texts.join(roles, texts["doc_id"] == roles["first_doc"]).select("text", F.explode("roles").alias("r")).select("r.route", "r.center", "r.node", "text")
    return stored(by_route(rows, 2 * pairs.count(), ROWS).mapInArrow(tidy(verify), "a long, b long"), "links")


def joined(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Components (node, root) of the links, and of `roots` where given; the tables given are used up."""
    every = links if roots is None else links.unionByName(roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    graph = components(every)
    found = stored(graph, "roots")
    discard(graph, links, *([] if roots is None else [roots]))
    return found


def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) that lie in different components, with these; nodes that `roots` lacks are components of their own."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    return pairs.filter("root_a <> root_b")


def linked_further(pairs: DataFrame, roots: DataFrame, nodes: DataFrame, base: DataFrame) -> DataFrame:
    """`roots` after all pairs (a, b) have been tested, but for those whose components other links have joined.

    Of each two components that are still apart the smallest pair is tested first; where it links them, the others need no
    test. `base` has the texts of all nodes.
    """
    two = [F.least("root_a", "root_b").alias("low"), F.greatest("root_a", "root_b").alias("high")]
    left = stored(across(pairs, roots).select("a", "b", *two).distinct(), "left")
    if left.isEmpty():
        discard(left)
        return roots
    texts = texts_of(left.select("a", "b"), nodes, base)
    least = left.groupBy("low", "high").agg(F.min(F.struct("a", "b")).alias("p")).select("low", "high", "p.a", "p.b")
    found = tested(least.select("a", "b"), nodes, texts)
    linked = least.join(found, ["a", "b"], "left_semi").select("low", "high")
    rest = stored(left.join(linked, ["low", "high"], "left_anti").select("a", "b").join(least, ["a", "b"], "left_anti"), "rest")
    roots = joined(found, roots)
    if not rest.isEmpty():
        roots = joined(tested(rest, nodes, texts), roots)
    discard(left, rest, texts)
    return roots


def similarity_components(docs: DataFrame) -> DataFrame:
    """Link texts whose sets of distinct five-word shingles have a Jaccard likeness of at least PERCENT hundredths.

    Returns doc_id, n_shingles and component_id, the smallest doc_id reachable by links; a row for each row of `docs`.
    Words are runs without space, tab or line breaks, A-Z lower-cased; a text with fewer than five words has its sequence
    as one shingle; null, empty and blank texts have none and link with nothing. Texts with equal sets link. Null doc_ids
    are the smallest. Rows sharing a doc_id count as texts of their own. An empty table gives no rows; other columns are
    ignored.

    Equal sets first become one node. Nodes meet in blocks by the elements of their prefix, so no linked pair is missed.
    First `CENTERS` nodes of each block, the smallest by several hashes, are tried with all others, so that of a large group
    of near copies few are left apart; components of these links are found; then only blocks
    that hold several components are joined, those of more than `LEAF` nodes by an R-tree over count vectors, large ones in
    slices of `SLICE`. Before any set is read, a pair's prefixes must share enough elements.
    """
    spark = docs.sparkSession
    small_batches(spark)
    none = -(1 << 63)
    base = documents(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(none)))
    last = spark.sparkContext.broadcast(frequent_shingles(base))
    described = base.mapInArrow(tidy(lambda b: describe(b, last.value)), "doc_id long, n long, node long, prefix array<long>, fine binary")
    wide = stored(described.withColumn("row", F.monotonically_increasing_id()), "sets")
    # only the numbers of the rows are shuffled to find equal sets, not what they hold
    real = wide.filter("n > 0").select("row", "doc_id", "node")
    lowest = real.groupBy("node").agg(F.min(F.struct("doc_id", "row"))["row"].alias("kept"))
    copies = stored(real.join(lowest, "node").filter("row <> kept").select("row"), "copies")
    single = wide.filter("n > 0").join(copies, "row", "left_anti")
    # elements of several prefixes with a few nodes of each: most are of one set only, and go after their one shuffle
    by = Window.partitionBy("token")
    first = lambda k: F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(k))).over(by)
    token = single.select(F.explode("prefix").alias("token"), "node", "n").withColumn("size", F.count("*").over(by)).filter("size > 1")
    shared = stored(token.withColumn("centers", F.array_distinct(F.array(*map(first, range(CENTERS))))), "shared")
    nodes = stored(single.select("node", F.col("doc_id").alias("first_doc"), "n", "fine"), "nodes")
    sets = stored(wide.select("doc_id", "n", "node"), "rows")
    discard(wide, copies)
    marks = stored(shared_elements(shared), "marks")
    # first round: a few nodes of a block with all others
    star = shared.select("node", "n", F.explode("centers").alias("c")).filter(f"node <> c.node and 100 * least(n, c.n) >= {PERCENT} * greatest(n, c.n)")
    star = near_pairs(star.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")), nodes, marks)
    one = star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")  # each node with one partner, then the others
    texts = texts_of(star, nodes, base)
    roots = joined(tested(one, nodes, texts), None)
    roots = linked_further(star.join(one, ["a", "b"], "left_anti"), roots, nodes, texts)
    discard(star, texts)
    # second round: blocks with several components
    open_rows = shared.filter("size > 2").select("token", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = open_rows.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("members")).filter("r0 <> r1")
    rows = stored(open_rows.join(mixed.select("token", "members"), "token"), "open")
    discard(shared)
    # blocks no larger than a leaf of the tree: all pairs
    ends = [rows.filter(F.col("members") <= LEAF).select("token", F.col("node").alias(e), F.col("n").alias(f"n_{e}"), F.col("root").alias(f"root_{e}")) for e in ("a", "b")]
    few = ends[0].join(ends[1], "token").filter(f"a < b and root_a <> root_b and 100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)").select("a", "b")
    large = rows.filter(F.col("members") > LEAF).withColumn("slices", F.ceil(F.col("members") / SLICE).cast("int"))
    total = large.agg(F.sum("slices")).first()[0] or 0
    mine = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    # a slice meets itself (side 2) and, as points, each later slice (side 1)
    others = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"), F.when(j == mine, 2).when(mine < j, 0).otherwise(1).alias("side")),
    )
    dealt = large.select("token", "node", "root", F.explode(others).alias("o")).select(F.xxhash64("token", "o.i", "o.j").alias("route"), F.col("o.side").alias("side"), "node", "root")
    held = nodes.join(large.select("node").distinct(), "node", "left_semi").select("node", "n", "fine").mapInArrow(tidy(counted), "node long, n long, counts binary")
    dealt = dealt.join(held, "node").select("route", "side", "node", "n", "root", "counts")
    more = by_route(dealt, total, BLOCK_ROWS).mapInArrow(tidy(join_blocks), "a long, b long")
    more = near_pairs(few.unionByName(more), nodes, marks)
    roots = linked_further(more, roots, nodes, base)
    found = nodes.select("node", "first_doc").join(roots, "node", "left").select("node", "first_doc", F.coalesce("root", "node").alias("root"))
    lowest = found.groupBy("root").agg(F.min("first_doc").alias("component"))
    found = found.join(lowest, "root").select("node", "component")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    back = lambda c: F.when(c != none, c)
    out = sets.join(found, "node", "left").select(back(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(component).alias("component_id"))
    out = stored(out, "components")
    discard(sets, nodes, marks, rows, more, roots)
    return out
