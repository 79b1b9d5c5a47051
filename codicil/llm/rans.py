"""Token ids in binary blocks by a static range asymmetric numeral system: interleaved lanes, checkpoints, checksums."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codicil.llm.common import discard, new_path, stored, tidy
from codicil.llm.tokens import encoder

# File format (fixed values). A block: header, checkpoints, words; all little-endian.
MAGIC = b"CRB1"
HEADER = struct.Struct("<4sBBHIIIII")  # magic, scale, 0, lanes, ids, steps between checkpoints, checkpoints, words, crc32 of the rest
SCALE = 18  # frequencies sum to 2**SCALE
LOW = np.uint64(1 << 31)  # states are in [LOW, LOW * 2**32)
LANES = 1024
SPACING = 128  # steps between checkpoints
BLOCK = 262_144  # ids of a block, whole documents; a longer document has a block of its own
CHUNK = 6_000_000  # bytes of text encoded at a time, or one text


class Table:
    """Frequencies of ids, scaled to 2**SCALE with at least 1 for every id that occurs, and what coding needs of them."""

    def __init__(self, counts: np.ndarray):
        present = np.flatnonzero(counts)
        if len(present) > 1 << (SCALE - 1):
            raise ValueError(f"at most {1 << (SCALE - 1)} different ids can be coded")
        freq = np.zeros(len(counts), np.int64)
        if len(present):
            room = (1 << SCALE) - len(present)
            exact = counts[present] * (room / counts[present].sum())
            freq[present] = 1 + np.floor(exact).astype(np.int64)
            left = (1 << SCALE) - freq.sum()
            freq[present[np.argsort(-counts[present], kind="stable")[:left]]] += 1
        self.freq = freq.astype(np.uint64)
        self.start = np.r_[0, np.cumsum(freq)][:-1].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, spacing: int = SPACING) -> bytes:
    """A block of ids. Id i belongs to lane i % lanes and step i // lanes; all lanes of a step advance together.

    A checkpoint holds the words used so far and all lane states before its step, so that steps can be decoded from there.
    """
    lanes = max(1, min(lanes, -(-len(ids) // 64)))
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: dict[int, np.ndarray] = {}
    shift = np.uint64(63 - SCALE)
    for step in range(steps - 1, -1, -1):
        part = ids[step * lanes : (step + 1) * lanes]
        f, s, x = table.freq[part], table.start[part], state[: len(part)]
        full = x >= (f << shift)
        words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(full, x >> np.uint64(32), x)
        q = x // f
        state[: len(part)] = (q << np.uint64(SCALE)) + (x - q * f) + s
        if step % spacing == 0:
            marks[step] = state.copy()
    words.reverse()
    used = np.r_[0, np.cumsum([len(w) for w in words])].astype(np.int64)
    body = b"".join(struct.pack("<I", int(used[step])) + marks[step].astype("<u8").tobytes() for step in sorted(marks))
    body += b"".join(w.tobytes() for w in words)
    return HEADER.pack(MAGIC, SCALE, 0, lanes, len(ids), spacing, len(marks), int(used[-1]), zlib.crc32(body)) + body


def decode_block(block: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids [first, last) of a block, from the nearest checkpoint before; raises ValueError if it is damaged."""
    if len(block) < HEADER.size:
        raise ValueError("not a block of ids")
    magic, scale, _, lanes, n, spacing, n_marks, n_words, crc = HEADER.unpack_from(block)
    if magic != MAGIC or scale != SCALE:
        raise ValueError("not a block of ids")
    if zlib.crc32(memoryview(block)[HEADER.size :]) != crc:
        raise ValueError("damaged block: its checksum differs")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.int32)
    mark = first // lanes // spacing
    at = HEADER.size + mark * (4 + 8 * lanes)
    spot = struct.unpack_from("<I", block, at)[0]
    state = np.frombuffer(block, "<u8", lanes, at + 4).astype(np.uint64)
    words = np.frombuffer(block, "<u4", n_words, HEADER.size + n_marks * (4 + 8 * lanes))
    mask, scale = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    begin = mark * spacing * lanes
    out = np.zeros(last - begin, np.int32)
    for a in range(begin, last, lanes):
        b = min(a + lanes, n)
        x = state[: b - a]
        slot = x & mask
        ids = table.symbol[slot]
        out[a - begin : min(b, last) - begin] = ids[: min(b, last) - a]
        x = table.freq[ids] * (x >> scale) + slot - table.start[ids]
        low = np.flatnonzero(x < LOW)
        x[low] = (x[low] << np.uint64(32)) | words[spot : spot + len(low)]
        spot += len(low)
        state[: b - a] = x
    return out[first - begin :]


def tokenised(docs: DataFrame, path: str, end_id: int, parts: int) -> DataFrame:
    """Blocks of raw ids in ascending doc_id order: part and block number, documents' ids and sizes, ids as bytes."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        coder = encoder(path)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = before = 0

        def emit() -> pa.RecordBatch:
            nonlocal block, size, before
            who = [d for h in held for d in h[0]]
            sizes = np.concatenate([h[1] for h in held])
            ids = np.concatenate([h[2] for h in held])
            wide = bool(ids.max(initial=0) >= 1 << 16)
            row = [[part], [block], [before], [len(ids)], [who], [sizes], [wide], [ids.astype("<u4" if wide else "<u2").tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.binary()]
            block, before, size = block + 1, before + len(ids), 0
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=["part", "block", "before", "n", "docs", "sizes", "wide", "ids"])

        for batch in batches:
            who, texts = batch.column(0).to_pylist(), batch.column(1)
            bytes_to = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            cuts = np.unique(np.r_[0, np.searchsorted(bytes_to, np.arange(CHUNK, bytes_to[-1] if len(texts) else 0, CHUNK)) + 1, len(texts)])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                ids, edges = coder.encode(texts.slice(a, b - a))
                full = np.insert(ids, edges[1:], end_id)
                sizes = np.diff(edges) + 1
                ends = np.cumsum(sizes)
                i = 0
                while i < b - a:
                    # as many documents as still fit, at least one
                    base = ends[i - 1] if i else 0
                    j = max(int(np.searchsorted(ends, base + BLOCK - size, "right")), i if held else i + 1)
                    if j > i:
                        held.append((who[a + i : a + j], sizes[i:j], full[base : ends[j - 1]]))
                        size += int(ends[j - 1] - base)
                    if j < b - a or size >= BLOCK:
                        yield emit()
                    i = j
        if held:
            yield emit()

    schema = "part int, block int, before long, n long, docs array<long>, sizes array<long>, wide boolean, ids binary"
    return stored(ordered.mapInArrow(tidy(run), schema), "ids")


def raw_ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for wide, ids in zip(batch.column("wide").to_pylist(), batch.column("ids").to_pylist(), strict=True):
        yield np.frombuffer(ids, "<u4" if wide else "<u2").astype(np.int64)


def id_counts(raw: DataFrame) -> np.ndarray:
    """How often each id occurs in all blocks: one row for each id of the vocabulary comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in raw_ids(batch):
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    rows = raw.select("wide", "ids").mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return counts


def write_ids(docs: DataFrame, target: str, tokenizer: str, end_id: int) -> None:
    """Write the token ids of all texts to `target`: blocks in ascending doc_id order, and the shared frequency table.

    `target`/blocks: Parquet rows (part, block, before, n, docs, sizes, payload), one file for each part; a part is a range
    of doc_id, `before` counts the part's ids ahead of the block. `target`/table: id and count of each id. Null texts are
    empty (one id, the end); ties of doc_id are ordered by text; an empty table makes empty files.
    """
    spark = docs.sparkSession
    raw = tokenised(docs, tokenizer, end_id, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = id_counts(raw)
    used = np.flatnonzero(counts)
    schema = "id long, n long"
    spark.createDataFrame([(int(i), int(counts[i])) for i in used], schema).coalesce(1).write.parquet(f"{target}/table")
    shared = spark.sparkContext.broadcast(counts)  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            payload = pa.array([encode_block(ids, table) for ids in raw_ids(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], payload], names=["part", "block", "before", "n", "docs", "sizes", "payload"])

    out = raw.mapInArrow(tidy(run), "part int, block int, before long, n long, docs array<long>, sizes array<long>, payload binary")
    out.write.option("compression", "none").parquet(f"{target}/blocks")
    discard(raw)


def read_ids(spark: SparkSession, target: str) -> DataFrame:
    """Documents of files that `write_ids` wrote: doc_id, start (ids of all documents before), n_tokens, ids (as bytes).

    Each block is decoded on its own; its checksum is verified.
    """
    rows = spark.read.schema("id long, n long").parquet(f"{target}/table").toPandas()  # as long as the vocabulary
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    blocks = spark.read.schema("part int, block int, before long, n long, docs array<long>, sizes array<long>, payload binary").parquet(f"{target}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    # one row for each part
    offsets = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for offset, who, sizes, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = decode_block(payload, table).astype("<u4")
                ends = np.cumsum(sizes)
                starts = ends - sizes
                data = pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(starts + offset, pa.int64()), pa.array(sizes, pa.int64()), data], names=["doc_id", "start", "n_tokens", "ids"])

    placed = blocks.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("before")).alias("offset"), "docs", "sizes", "payload")
    return placed.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all texts' ids, read them back, and report doc_id, start, n_tokens and ids_crc32 from the files."""
    spark = docs.sparkSession
    target = new_path(spark, "rans")
    write_ids(docs, target, tokenizer, end_id)
    return read_ids(spark, target).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
