"""Packed binary training files: best-fit-decreasing packing with a segment tree over capacities.

Each input partition is read as a stream of shards of bounded size, and a shard is packed by
itself, so no token id is shuffled and a lost executor repeats only its own partition.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import tokens
from lexloom.llm.common import bounded_batches, spread, stored, table, tidy

CAPACITY = 2048
#: Tokens gathered before a shard is packed: about 2000 sequences.
SHARD_TOKENS = 2 << 20
PAD_ID = 0
#: Sequences in one Arrow batch that leaves a task.
OUT_ROWS = 256

SEQUENCES = "sequence_id long, input_ids binary, cu_seqlens array<int>, position_ids binary, segments array<struct<doc_id: long, start: long, doc_tokens: long>>"
SEGMENT = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64())])


class Rooms:
    """Bins by the room they have left, under a segment tree that finds the least room of at least n."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, bin) of the fullest bin that still takes ``least``, removed; None if there is none."""
        i = least + self.size
        while not self.count[i]:
            while i & 1:
                i >>= 1
                if i <= 1:
                    return None
            i += 1
        while i < self.size:
            i = 2 * i + (not self.count[2 * i])
        room = i - self.size
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, self.bins[room].pop()


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: longest first, each into the fullest bin that takes it."""
    rooms, where, offset, opened = Rooms(capacity), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if (found := rooms.take(n)) is None:
            room, which, opened = capacity, opened, opened + 1
        else:
            room, which = found
        where[i], offset[i] = which, capacity - room
        if room > n:
            rooms.add(room - n, which)
    return where, offset


def _shard(docs: list, ids: np.ndarray, offsets: np.ndarray, capacity: int, first: int) -> Iterator[pa.RecordBatch]:
    sizes = np.diff(offsets)
    n = -(-sizes // capacity)
    doc, k = np.repeat(np.arange(len(sizes)), n), spread(n)
    start = k * capacity
    length = np.minimum(sizes[doc] - start, capacity)
    where, at = best_fit(length, capacity)
    rows = int(where.max()) + 1
    matrix, position = np.full(rows * capacity, PAD_ID, np.int32), np.zeros(rows * capacity, np.int32)
    inner = spread(length)
    to = np.repeat(where * capacity + at, length) + inner
    matrix[to] = ids[np.repeat(offsets[doc] + start, length) + inner]
    position[to] = inner
    order = np.lexsort((at, where))
    bounds = np.searchsorted(where[order], np.arange(rows + 1))
    for a in range(0, rows, OUT_ROWS):
        b = min(rows, a + OUT_ROWS)
        cu, segments = [], []
        for r in range(a, b):
            own = order[bounds[r] : bounds[r + 1]]
            cu.append(np.concatenate((at[own], [at[own[-1]] + length[own[-1]]])).astype(np.int32))
            segments.append([{"doc_id": docs[doc[j]], "start": int(start[j]), "doc_tokens": int(sizes[doc[j]])} for j in own.tolist()])
        blob = lambda m, a=a, b=b: pa.array([m[r * capacity : (r + 1) * capacity].astype("<i4", copy=False).tobytes() for r in range(a, b)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(range(first + a, first + b), pa.int64()), blob(matrix), pa.array(cu, pa.list_(pa.int32())), blob(position), pa.array(segments, pa.list_(SEGMENT))], ["sequence_id", "input_ids", "cu_seqlens", "position_ids", "segments"])


def pack_binary(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per sequence: its little-endian int32 ids, cumulative segment lengths, positions and segments.

    Texts longer than a sequence are split without loss. Null and empty texts are the single end
    token, and an empty table gives no rows. ``position_ids`` starts at 0 with each segment.
    Sequence ids are unique, and the same for the same input partitions.
    """
    path = tokenizer_path or tokens.default_path()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.WordTokenizer.shared(path)
        names, held, sizes, total = [], [], [], 0
        first = TaskContext.get().partitionId() << 36

        def flush():
            return _shard(names, np.concatenate(held), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), capacity, first)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, offsets = tokenizer.encode(batch.column("text"))
            names += batch.column("doc_id").to_pylist()
            held.append(ids)
            sizes.append(np.diff(offsets))
            total += len(ids)
            if total >= shard_tokens:
                for out in flush():
                    first += out.num_rows
                    yield out
                names, held, sizes, total = [], [], [], 0
        if names:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), SEQUENCES)


def write_packed(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet with binary columns; ``read_segments`` reads them from there."""
    packed.write.mode("errorifexists").parquet(path)


def read_segments(packed: DataFrame) -> DataFrame:
    """The pieces as the stored matrices hold them, with the CRC-32 of the ids found there.

    Each piece is a row, also of repeated documents; null doc_ids stay null, and no sequences give
    no rows. Positions that don't begin at 0 with each piece raise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, blob, cu, positions, segments in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids, position = np.frombuffer(blob, "<i4"), np.frombuffer(positions, "<i4")
                for a, b, s in zip(cu[:-1], cu[1:], segments, strict=True):
                    if position[a] != 0 or position[b - 1] != b - a - 1:
                        raise ValueError(f"sequence {number}: positions are not reset at {a}")
                    rows.append((s["doc_id"], s["start"], b - a, zlib.crc32(ids[a:b].astype("<u4")), s["doc_tokens"], number, a))
            if rows:
                names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return packed.select("sequence_id", "input_ids", "cu_seqlens", "position_ids", "segments").mapInArrow(run, fields)


def op8_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_segments(stored(pack_binary(table(spark, sf_dir, "documents")), "packed"))
