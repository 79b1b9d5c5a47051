"""Facts in texts, and section-by-section differences between consecutive versions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.text import title_key
from codicil.operators.structure import merge_continuations

# Figures in texts, most specific kind first.
NUMBER = r"\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?"
PATTERNS = {
    "date": r"(\d{4}-\d{2}-\d{2})",
    "amount": rf"(?i)\b(?:rs\.?|inr|rupees)\s*({NUMBER})",
    "percent": rf"({NUMBER})\s*%",
    "duration": rf"(?i)({NUMBER}\s+(?:years?|months?|days?|weeks?))\b",
}


def as_facts(values: Column, kind: str) -> Column:
    """Matches of one kind as structs (kind, value, place)."""

    def one(v: Column, i: Column) -> Column:
        plain = F.replace(F.lower(v), F.lit(","), F.lit(""))
        return F.struct(F.lit(kind).alias("kind"), (F.regexp_replace(plain, r"^(\S+)\s+(\w+?)s?$", "$1 $2") if kind == "duration" else plain).alias("value"), (i + 1).alias("place"))

    return F.transform(values, one)


def numeric_facts(rows: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """Figures of each row's text by kind: dates, amounts, per cents, durations, with their place among their kind.

    What a more specific kind has matched is blanked before the next kind looks, so no figure counts twice. Values:
    grouping commas go; durations are ``number unit`` with the unit's singular.
    """
    rows = rows.select(*keys, F.coalesce(text, F.lit("")).alias("left_"))
    seen = []
    for kind, pattern in PATTERNS.items():
        # exploded, so each pattern is matched once in what the kinds before have left
        found = F.struct(F.regexp_extract_all("left_", F.lit(pattern)).alias("found"), F.regexp_replace("left_", pattern, " ").alias("left"))
        rows = rows.select(*keys, *seen, F.explode(F.array(found)).alias("x_")).select(*keys, *seen, F.col("x_.found").alias(f"{kind}_"), F.col("x_.left").alias("left_"))
        seen.append(f"{kind}_")
    every = F.concat(*[as_facts(F.col(f"{kind}_"), kind) for kind in PATTERNS])
    return rows.select(*keys, F.explode(every).alias("f")).select(*keys, "f.kind", "f.value", "f.place")


def consecutive(versions: DataFrame) -> DataFrame:
    """Each active version with the one before it: (old_id, new_id)."""
    w = Window.partitionBy("policy_id").orderBy("effective_from", "version_id")
    return versions.filter("status = 'active'").select(F.lag("version_id").over(w).alias("old_id"), F.col("version_id").alias("new_id")).filter("old_id is not null")


def compare_versions(sections: DataFrame, pairs: DataFrame) -> DataFrame:
    """Sections added, removed, modified or unchanged between the versions of each pair.

    Sections are (version_id, number, title, content), where given with order_index (else in the order of their numbers) and
    level. Parts ``... (continued)`` are joined first, then sections are aligned (`align_sections`). Unchanged are those with the
    same title and content. `number` is that of the new section, or of the old one; `by` says what aligned them.

    A version's sections meet the pairs it is in, and are shuffled once to each of these with their contents.
    """
    rows = sections if "order_index" in sections.columns else sections.withColumn("order_index", F.col("number"))
    rows = rows if "level" in rows.columns else rows.withColumn("level", F.lit(1))
    rows = merge_continuations(rows).select("version_id", F.col("order_index").alias("place"), "number", "level", "title", title_key(F.col("title")).alias("key"), "content")
    role = lambda c, side: F.struct(F.col(c).alias("version_id"), F.lit(side).alias("side"))
    roles = pairs.select("old_id", "new_id", F.explode(F.array(role("old_id", 0), role("new_id", 1))).alias("r")).select("old_id", "new_id", "r.*")
    met = aligned(rows.join(roles, "version_id"))
    same = F.col("old_content").eqNullSafe(F.col("new_content")) & F.col("old_title").eqNullSafe(F.col("new_title"))
    change = F.when(F.col("by").isin("added", "removed"), F.col("by")).when(same, "unchanged").otherwise("modified")
    return met.select("old_id", "new_id", "old_place", "new_place", "number", "old_title", "old_content", "new_title", "new_content", "by", change.alias("change"))


TITLE_RATIO, CONTENT_RATIO = 0.75, 0.6


def shared_share(a: Counter, b: Counter) -> float:
    """Twice the characters that two texts share, by how many of all they have: at least as much as their matching blocks."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 1.0


@lru_cache(maxsize=1 << 16)
def alike_titles(a: str, b: str) -> bool:
    """Whether the matching blocks of two titles make up `TITLE_RATIO` of both."""
    if 2 * min(len(a), len(b)) < TITLE_RATIO * (len(a) + len(b)) or shared_share(Counter(a), Counter(b)) < TITLE_RATIO:
        return False
    return SequenceMatcher(None, a, b).ratio() >= TITLE_RATIO


def pair_alike(old: list[dict], new: list[dict]) -> list[tuple]:
    """Sections of one pair of versions that nothing exact has aligned: each old one, in order, takes the first new one left that
    matches. First titles of which one holds the other, over contents that share most characters; then alike titles."""
    letters: dict[int, Counter] = {}

    def body(row: dict) -> Counter:
        if id(row) not in letters:
            letters[id(row)] = Counter(row["content"] or "")
        return letters[id(row)]

    def nested(o: dict, n: dict) -> bool:
        a, b = o["title"], n["title"]
        return bool(a and b) and (a in b or b in a) and shared_share(body(o), body(n)) >= CONTENT_RATIO

    out = []
    for by, match in (("nested title", nested), ("alike title", lambda o, n: alike_titles(o["title"], n["title"]))):
        kept = []
        for o in old:
            at = next((i for i, n in enumerate(new) if match(o, n)), None)
            if at is None:
                kept.append(o)
            else:
                out.append((o["place"], new.pop(at)["place"], by))
        old = kept
    return out + [(o["place"], None, "removed") for o in old] + [(None, n["place"], "added") for n in new]


def met_by_key(pair: np.ndarray, side: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of side 0 and of side 1 that meet: in each pair the k-th of a key meets the k-th. Negative keys match nothing."""
    rows = np.flatnonzero(key >= 0)
    group = pair[rows] * (key.max(initial=0) + 1) + key[rows]
    rows = rows[np.argsort(group * 2 + side[rows], kind="stable")]
    group = pair[rows] * (key.max(initial=0) + 1) + key[rows]
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(rows)])
    olds = np.add.reduceat(side[rows] == 0, begin) if len(rows) else begin
    both = np.minimum(olds, np.diff(np.r_[begin, len(rows)]) - olds)
    at = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both) + np.repeat(begin, both)
    return rows[at], rows[at + np.repeat(olds, both)]


def codes(column: pa.ChunkedArray, null: int | None = None) -> np.ndarray:
    """Numbers that are equal where values are; nulls get a number of their own, or the one given."""
    found = column.combine_chunks().dictionary_encode(null_encoding="encode" if null is None else "mask").indices
    return (found if null is None else found.fill_null(null)).to_numpy(zero_copy_only=False).astype(np.int64)


def whole_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by pair, as tables in which no pair is cut."""
    waiting: list[pa.RecordBatch] = []
    ends = lambda b, i: (b.column(0)[i].as_py(), b.column(1)[i].as_py())
    for batch in batches:
        if not batch.num_rows:
            continue
        if waiting and ends(batch, 0) != ends(waiting[-1], -1):
            yield pa.Table.from_batches(waiting)
            waiting = []
        ids = [codes(pa.chunked_array([batch.column(i)])) for i in range(2)]
        cut = 1 + np.flatnonzero((ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1]))
        if len(cut):
            yield pa.Table.from_batches([*waiting, batch.slice(0, cut[-1])])
            waiting = []
        waiting.append(batch.slice(cut[-1] if len(cut) else 0))
    if waiting:
        yield pa.Table.from_batches(waiting)


def align_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All passes over rows (old_id, new_id, side, place, number, level, key, title, content), sorted by pair, side and place."""
    for table in whole_pairs(batches):
        ids = [codes(table.column(i)) for i in range(2)]
        pair = np.cumsum(np.r_[False, (ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1])])
        side = table.column("side").to_numpy().astype(np.int64)
        front = np.where(table.column("level").to_pandas().eq(0).to_numpy(), 0, -1)
        free, found = np.ones(len(pair), bool), []
        for by, key in (("number", codes(table.column("number"), -1)), ("front", front), ("title", codes(table.column("key")))):
            old, new = met_by_key(pair, side, np.where(free, key, -1))
            free[old] = free[new] = False
            found.append((old, new, by))
        # what depends on each other: pairs with sections left on both sides
        left = np.zeros((2, pair[-1] + 1), bool)
        left[side[free], pair[free]] = True
        rest = np.flatnonzero(free & left.all(0)[pair])
        some = table.take(pa.array(rest)).select(["key", "content"]).to_pydict() if len(rest) else {"key": [], "content": []}
        members = [{"place": i, "title": k, "content": c} for i, k, c in zip(rest.tolist(), some["key"], some["content"], strict=True)]
        for cut in np.split(np.arange(len(rest)), 1 + np.flatnonzero(np.diff(pair[rest]))) if len(rest) else []:
            n = int((side[rest[cut]] == 0).sum())
            group = members[cut[0] : cut[-1] + 1]
            for old, new, by in pair_alike(group[:n], group[n:]):
                if old is not None and new is not None:
                    free[[old, new]] = False
                    found.append(([old], [new], by))
        gone, come = np.flatnonzero(free & (side == 0)), np.flatnonzero(free & (side == 1))
        found += [(gone, np.full(len(gone), -1), "removed"), (np.full(len(come), -1), come, "added")]
        old, new = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in range(2))
        by = pa.array(np.repeat([f[2] for f in found], [len(f[0]) for f in found]), pa.string())
        either = pa.array(np.where(new >= 0, new, old))
        old, new = pa.array(old, mask=old < 0), pa.array(new, mask=new < 0)
        one = lambda name, at: table.column(name).combine_chunks().take(at)  # noqa: B023, E731
        columns = {"old_id": one("old_id", either), "new_id": one("new_id", either), "old_place": one("place", old), "new_place": one("place", new), "by": by}
        columns["number"] = pc.coalesce(one("number", new), one("number", old))
        for name in ("title", "content"):
            columns |= {f"old_{name}": one(name, old), f"new_{name}": one(name, new)}
        yield from pa.table(columns).to_batches(max_chunksize=10_000)


def aligned(rows: DataFrame) -> DataFrame:
    """`align_sections` of rows (old_id, new_id, side, place, number, level, key, title, content), with what both sections hold."""
    rows = rows.select("old_id", "new_id", "side", F.col("place").cast("int").alias("place"), "number", "level", "key", "title", "content")
    kind = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    texts = ", ".join(f"{side}_{c} {kind[c]}" for c in ("title", "content") for side in ("old", "new"))
    rows = rows.repartition("old_id", "new_id").sortWithinPartitions("old_id", "new_id", "side", "place")
    return rows.mapInArrow(align_pairs, f"old_id {kind['old_id']}, new_id {kind['new_id']}, old_place int, new_place int, by string, number {kind['number']}, {texts}")


def align_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sections of both sides of a pair (old_id, new_id, place, number, title; level and content where given) that belong together.

    In passes over what is left: equal numbers, front matter (level 0), equal title keys, then titles of which one holds the
    other if the contents share 60 % of their characters, then titles whose matching blocks make up 75 %. Of several alike the
    k-th meets the k-th; each section is used once. Null numbers and levels match nothing; null titles count as empty, and
    empty titles are equal. A place is unique on its side.

    One shuffle and one sort by pair; the exact passes run over many pairs at a time. Only pairs with sections left on both
    sides go on to the last two, one pair at a time, whose matches depend on each other; a pair's sections are held in one task.

    Returns old_id, new_id, old_place, new_place, by; a place is null where a section has no partner (by: removed, added).
    """

    def side(df: DataFrame, number: int) -> DataFrame:
        level = F.col("level") if "level" in df.columns else F.lit(1)
        content = F.col("content") if "content" in df.columns else F.lit("")
        return df.select("old_id", "new_id", F.lit(number).alias("side"), "place", "number", level.alias("level"), title_key(F.col("title")).alias("key"), F.lit("").alias("title"), content.alias("content"))

    return aligned(side(old, 0).unionByName(side(new, 1))).select("old_id", "new_id", "old_place", "new_place", "by")


def both_facts(rows: DataFrame, keys: Sequence[str], old: str, new: str) -> DataFrame:
    """Figures of two texts of each row, as arrays `old` and `new` of structs (kind, value), each kind's in reading order."""
    texts = {"old": F.coalesce(old, F.lit("")), "new": F.coalesce(new, F.lit(""))}
    rows = rows.select(*keys, *[t.alias(f"{side}_left") for side, t in texts.items()])
    seen: list[str] = []
    for kind, pattern in PATTERNS.items():
        # exploded, so each pattern is matched once in what the kinds before have left
        one = [c for side in texts for c in (F.regexp_extract_all(f"{side}_left", F.lit(pattern)).alias(f"{side}_{kind}"), F.regexp_replace(f"{side}_left", pattern, " ").alias(f"{side}_left"))]
        rows = rows.select(*keys, *seen, F.explode(F.array(F.struct(*one))).alias("x_")).select(*keys, *seen, "x_.*")
        seen += [f"{side}_{kind}" for side in texts]
    told = lambda f: F.struct(f["kind"].alias("kind"), f["value"].alias("value"))
    return rows.select(*keys, *[F.transform(F.concat(*[as_facts(F.col(f"{side}_{kind}"), kind) for kind in PATTERNS]), told).alias(side) for side in texts])


def changed_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (..., old, new), the figures that one side has more often, paired by kind; all rows of a batch at a time."""
    for batch in batches:
        keys = batch.schema.names[:-2]
        lists = [batch.column(c) for c in ("old", "new")]
        row = np.concatenate([np.repeat(np.arange(batch.num_rows), x.value_lengths().to_numpy()) for x in lists])
        facts = pa.concat_arrays([x.flatten() for x in lists])
        side = np.repeat([0, 1], [len(x.flatten()) for x in lists])
        kinds, values = facts.field("kind"), facts.field("value")
        kind, value = (codes(pa.chunked_array([x])) for x in (kinds, values))
        # the k-th of a value meets the k-th; of what is left, the j-th of a kind the j-th
        free = np.ones(len(row), bool)
        for met in met_by_key(row, side, value * (kind.max(initial=0) + 1) + kind):
            free[met] = False
        old, new = met_by_key(row, side, np.where(free, kind, -1))
        free[old] = free[new] = False
        gone, come = np.flatnonzero(free & (side == 0)), np.flatnonzero(free & (side == 1))
        old, new = np.r_[old, gone, np.full(len(come), -1)], np.r_[new, np.full(len(gone), -1), come]
        either = np.where(old >= 0, old, new)
        columns = {c: batch.column(c).take(pa.array(row[either])) for c in keys}
        columns |= {"kind": kinds.take(pa.array(either)), "old_value": values.take(pa.array(old, mask=old < 0)), "new_value": values.take(pa.array(new, mask=new < 0))}
        yield pa.RecordBatch.from_pydict(columns)


def numeric_changes(diff: DataFrame, keys: Sequence[str] = ("old_id", "new_id", "number")) -> DataFrame:
    """Figures of modified sections (rows unique by `keys`) that only one side has, paired by kind in reading order.

    A figure that both sides have as often is no change: the k-th occurrence of a value meets the k-th. A section's figures
    meet inside its row, so nothing is shuffled.
    """
    rows = both_facts(diff.filter("change = 'modified'"), keys, "old_content", "new_content")
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(changed_facts, f"{kinds}, kind string, old_value string, new_value string")


def summary_lines(changes: DataFrame) -> DataFrame:
    """One line for each changed section: ``Changed: 2 percent (4 → 6)``."""
    one = F.concat(F.col("kind"), F.lit(" ("), F.coalesce("old_value", F.lit("none")), F.lit(" → "), F.coalesce("new_value", F.lit("none")), F.lit(")"))
    keys = ["old_id", "new_id", "number"]
    texts = changes.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(one)), ", ").alias("parts"))
    return texts.select(*keys, F.concat(F.lit("Changed: "), F.col("number").cast("string"), F.lit(" "), F.col("parts")).alias("line"))


def sentences(text: Column) -> Column:
    """Sentences of a text: cut after a mark that white space follows, and at line feeds."""
    return F.filter(F.transform(F.split(text, r"(?<=[.;!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def changed_sentences(diff: DataFrame, most: int = 4) -> DataFrame:
    """Sentences of modified sections that only one side has, in order, at most `most` for each side."""
    both = diff.filter("change = 'modified'").select("old_id", "new_id", "number", sentences(F.col("old_content")).alias("o"), sentences(F.col("new_content")).alias("n"))
    only = lambda a, b: F.slice(F.array_except(a, b), 1, most)
    return both.select("old_id", "new_id", "number", F.array_join(only("o", "n"), " | ").alias("removed"), F.array_join(only("n", "o"), " | ").alias("added"))


def shared_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (..., o, n): the keys, and the sum of the smaller counts of each character of two texts."""
    for batch in batches:
        shared = np.zeros(batch.num_rows, np.int64)
        texts = [batch.column(c).to_pylist() for c in ("o", "n")]
        sizes = [np.fromiter(map(len, t), np.int64, len(t)) for t in texts]
        edges = [np.r_[0, np.cumsum(z)] for z in sizes]
        # at most about a million characters at a time, or one row
        cuts = np.unique(np.r_[0, 1 + np.flatnonzero(np.diff((edges[0][1:] + edges[1][1:]) >> 20)), batch.num_rows])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            marks = [np.frombuffer("".join(t[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
            used = np.flatnonzero(np.bincount(np.concatenate(marks)))
            place = np.zeros(int(used.max(initial=0)) + 1, np.int64)
            place[used] = np.arange(len(used))
            step = max(1, (1 << 22) // max(1, len(used)))
            for x in range(a, b, step):
                y = min(b, x + step)
                counts = []
                for mark, size, edge in zip(marks, sizes, edges, strict=True):
                    row = np.repeat(np.arange(y - x), size[x:y])
                    counts.append(np.bincount(row * len(used) + place[mark[edge[x] - edge[a] : edge[y] - edge[a]]], minlength=(y - x) * len(used)))
                shared[x:y] = np.minimum(*counts).reshape(y - x, len(used)).sum(1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(shared), pa.array(sizes[0] + sizes[1])], names=[*batch.schema.names[:-2], "shared", "total"])


def section_similarity(diff: DataFrame, keys: Sequence[str] = ("old_id", "new_id", "number")) -> DataFrame:
    """2 * sum of smaller character counts / all characters of both sides of modified sections, to six places.

    Counted inside the row, many rows at a time.
    """
    changed = diff.filter("change = 'modified'").select(*keys, F.coalesce("old_content", F.lit("")).alias("o"), F.coalesce("new_content", F.lit("")).alias("n"))
    kinds = ", ".join(f"{c} {changed.schema[c].dataType.simpleString()}" for c in keys)
    counted = changed.mapInArrow(shared_characters, f"{kinds}, shared long, total long")
    return counted.select(*keys, F.round(F.when(F.col("total") > 0, 2 * F.col("shared") / F.col("total")).otherwise(1.0), 6).alias("ratio"))


def version_extremes(facts: DataFrame, by: list[str]) -> DataFrame:
    """Smallest and largest per cent figure of each rule, and the first version that has it."""
    number = facts.filter("kind = 'percent'").withColumn("v", F.col("value").cast("double"))
    return number.groupBy(*by).agg(
        F.min("v").alias("lowest"), F.min(F.struct("v", "version_id"))["version_id"].alias("lowest_in"),
        F.max("v").alias("highest"), (-F.max(F.struct("v", (-F.col("version_id")).alias("i")))["i"]).alias("highest_in"),
    )


def figure_delta(facts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Difference of each per cent figure to the one before it."""
    w = Window.partitionBy(*by).orderBy(order)
    number = facts.filter("kind = 'percent' and place = 1").withColumn("v", F.col("value").cast("double"))
    met = number.withColumn("delta", F.col("v") - F.lag("v").over(w)).filter("delta is not null")
    return met.withColumn("direction", F.when(F.col("delta") > 0, "up").when(F.col("delta") < 0, "down").otherwise("same"))
