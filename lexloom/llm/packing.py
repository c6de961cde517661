"""Packing documents into fixed-length sequences by shortest-pack-first over the length histogram.

Token counts decide everything: the histogram of piece lengths has at most ``CAPACITY`` bins,
so the driver plans packing patterns for any corpus from a bounded table, and documents join
the patterns by their rank among the pieces of the same length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm import tokens
from lexloom.llm.common import bounded_batches, checkpointed, table, tidy

CAPACITY = 2048
#: What is left of a document beside full sequences is cut once, at a multiple of this.
GRAIN = 512
#: Ranks within a length are counted in parts of at least so many pieces, so that no length is one task's; and the most parts beside one a length.
PART_ROWS, MOST_PARTS = 250, 100_000
#: Equal pieces that become rows at once.
AT_ONCE = 10_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(n: int, capacity: int = CAPACITY, grain: int = GRAIN) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full sequences, a multiple of ``grain``, the rest."""
    out = [(i, capacity) for i in range(0, n - capacity + 1, capacity)]
    at = n - n % capacity
    for length in ((n - at) // grain * grain, (n - at) % grain):
        if length:
            out.append((at, length))
            at += length
    return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """The token pieces of every document, each with the CRC-32 of its ids."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.WordTokenizer.shared(tokenizer_path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, offsets = tokenizer.encode(batch.column("text"))
            rows = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for start, length in cut(b - a, capacity, grain):
                    rows.append((doc, start, length, zlib.crc32(ids[a + start : a + start + length].astype("<u4", copy=False)), b - a))
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), PIECES)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Shortest-pack-first: rows (length, first rank, last rank + 1, first sequence, offset).

    Lengths come longest first. Each goes to the packs with most room that can take it, as many
    at once as the pattern counts; a pattern splits where only some of its packs are filled. When
    no pack has room, new ones open, as few as can take all that is left of the length. Patterns
    number at most three a length.
    """
    rooms: dict[int, list] = {}
    order: list[int] = []

    def put(count: int, room: int, chain: tuple | None) -> None:
        if room not in rooms:
            rooms[room] = []
            heapq.heappush(order, -room)
        rooms[room].append((count, chain))

    closed = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while order and not rooms.get(-order[0]):
                rooms.pop(-heapq.heappop(order), None)
            if order and -order[0] >= length:
                room = -order[0]
                count, chain = rooms[room].pop()
                used = min(count, left)
                if used < count:
                    rooms[room].append((count - used, chain))
            else:
                room, chain = capacity, None
                each = min(capacity // length, left)
                used = left // each
                for _ in range(each - 1):
                    chain = (length, capacity - room, chain)
                    room, left = room - length, left - used
            left -= used
            link = (length, capacity - room, chain)
            if room == length:
                closed.append((used, link))
            else:
                put(used, room - length, link)
    slots, base, rank = [], 0, dict.fromkeys(histogram, 0)
    for count, chain in closed + [x for room in sorted(rooms) for x in rooms[room]]:
        while chain:
            length, offset, chain = chain
            slots.append((length, rank[length], rank[length] + count, base, offset))
            rank[length] += count
        base += count
    return slots


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """One row per piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the single end token. Rows that repeat a document are packed each
    for itself. An empty table gives no rows. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    cuts = checkpointed(pieces(docs, tokenizer_path or tokens.default_path(), capacity, grain))
    histogram = {r.length: r.n for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    part_rows = max(PART_ROWS, sum(histogram.values()) // MOST_PARTS)
    parts = spark.createDataFrame([(length, -(-n // part_rows)) for length, n in histogram.items()], "length long, parts long")
    # Equal pieces are one row with their number, so that ranks go by what a piece is alone: parts are ranges of its hash, and their number changes no rank.
    same = ("length", "doc_id", "start", "ids_crc32", "doc_tokens")
    each = cuts.groupBy(*same).agg(F.count("*").alias("n")).withColumn("hash", F.xxhash64(*same)).join(F.broadcast(parts), "length")
    each = each.withColumn("part", F.floor(F.shiftrightunsigned("hash", 11) / F.lit(float(1 << 53)) * F.col("parts")).cast("long"))
    counts = each.groupBy("length", "part").agg(F.sum("n").alias("n"))
    # MOST_PARTS rows, and one a length.
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    slots = spark.createDataFrame(plan(histogram, capacity), "length long, lo long, hi long, base long, offset long")
    within = Window.partitionBy("length", "part").orderBy(F.shiftrightunsigned("hash", 11), *same[1:])
    first = each.withColumn("nth", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).join(F.broadcast(before), ["length", "part"])
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / AT_ONCE)))).withColumn("run", F.col("run") * AT_ONCE)
    own = F.explode(F.sequence(F.col("run"), F.least(F.col("run") + AT_ONCE, F.col("n")) - 1))
    ranked = runs.select(*same, "before", "nth", own.alias("own")).withColumn("rank", F.col("before") + F.col("nth") + F.col("own"))
    placed = ranked.join(F.broadcast(slots.withColumnRenamed("length", "slot_length")), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank") - F.col("lo")).alias("sequence_id"), "offset")


def op1_spf_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
