"""Lines and records of text files that are split by bytes, with their exact numbers.

Spark's text reader deals a large file to tasks in blocks of bytes. A first pass counts each
block's lines and quotes; their sums over the blocks before, a row for each block, say at which
line a block starts and whether it starts within quotes, and a second pass numbers lines where
they are. Lines are never gathered: only those of a record that spans several meet by its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.operators.ranking import checkpointed

#: Blocks up to which their table, of some hundred bytes each, goes to all tasks; lines of more are sorted by block.
MOST_BLOCKS = 1_000_000


def _raw(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("m"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(path, block, values) of neighbouring rows of one block; a task may read several, one after another."""
    path, block = batch.column(0).dictionary_encode(), np.asarray(batch.column(1))
    code = np.asarray(path.indices)
    edges = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(code)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield path.dictionary[int(code[a])].as_py(), int(block[a]), batch.column(2).slice(a, b - a)


def _odd(values: pa.Array, quote: str) -> np.ndarray:
    """How many quotes lie before the end of each value, modulo two."""
    return np.cumsum(np.asarray(pc.count_substring(values, quote).fill_null(0), np.int64)) & 1


def _sizes(quote: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block its lines, whether its quotes are odd, and the last line that begins a record, for both ways to begin."""
        found: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for path, block, values in _runs(batch):
                n, odd, *last = found.setdefault((path, block), [0, 0, -1, -1])
                ends = _odd(values, quote) ^ odd
                before = np.concatenate(([odd], ends[:-1]))
                for start in (0, 1):
                    begins = np.flatnonzero(before ^ start == 0)
                    if len(begins):
                        last[start] = n + int(begins[-1])
                found[path, block] = [n + len(values), int(ends[-1]), *last]
        rows = [(p, b, *x) for (p, b), x in found.items()]
        kinds = [pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["path", "block", "lines", "odd", "last_even", "last_odd"])

    return run


def _numbered(quote: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(path, line_no, record_no, whole, line), from what is known of each block's start."""
        key, at, odd, begun = None, 0, 0, 0
        for batch in batches:
            done = 0
            for path, block, values in _runs(batch):
                if key != (path, block):
                    key = path, block
                    at, odd, begun = (batch.column(i)[done].as_py() for i in (3, 4, 5))
                ends = _odd(values, quote) ^ odd
                before = np.concatenate(([odd], ends[:-1]))
                lines = at + 1 + np.arange(len(values))
                record = np.maximum.accumulate(np.where(before == 0, lines, begun))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(values)), pa.array(lines), pa.array(record), pa.array((before == 0) & (ends == 0)), values], ["path", "line_no", "record_no", "whole", "line"])
                at, odd, begun, done = at + len(values), int(ends[-1]), int(record[-1]), done + len(values)

    return run


def numbered(spark: SparkSession, path: str, quote: str = "") -> DataFrame:
    """(path, line_no from 1, record_no, whole, line) of all lines of text files.

    A record is a line or, where ``quote`` is given, the lines up to the one that closes its
    quotes; its number is that of its first line, and ``whole`` says that it is a single one.
    Lines end at a line feed. Empty files have none. Files must not change meanwhile.
    """
    lines = _raw(spark, path)
    mark = quote or "\x00\x00"  # what no line has
    blocks = lines.select("path", "block", "value").mapInArrow(_sizes(mark), "path string, block long, lines long, odd long, last_even long, last_odd long")
    # A row for each block: lines and quotes before it, then the last record that begins before it.
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.withColumns({"first": F.coalesce(F.sum("lines").over(before), F.lit(0)), "inside": F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2})
    last = F.when(F.col("inside") == 0, F.col("last_even")).otherwise(F.col("last_odd"))
    begun = F.max(F.when(last >= 0, F.col("first") + last + 1)).over(before)
    known = checkpointed(sums.select("path", "block", "first", "inside", F.coalesce(begun, F.lit(1)).alias("begun")))
    columns = ["path", "block", "value", "first", "inside", "begun"]
    if known.count() <= MOST_BLOCKS:
        placed = lines.join(F.broadcast(known), ["path", "block"]).select(*columns)
    else:
        placed = lines.join(known, ["path", "block"]).repartition("path", "block").sortWithinPartitions("path", "block", "m").select(*columns)
    return placed.mapInArrow(_numbered(mark), "path string, line_no long, record_no long, whole boolean, line string")


def records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(path, line_no, record) of text files whose records may have line ends within quotes.

    Records of a single line stay where they are; the lines of the others meet by their number.
    Where quotes are never closed, the record goes to the end of its file.
    """
    lines = numbered(spark, path, quote)
    single = lines.where("whole").select("path", "line_no", F.col("line").alias("record"))
    parts = lines.where("not whole").groupBy("path", "record_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("parts"))
    return single.unionByName(parts.select("path", F.col("record_no").alias("line_no"), F.array_join(F.col("parts.line"), "\n").alias("record")))
