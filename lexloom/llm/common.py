"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch. Long texts make row counts alone unsafe.
BATCH_ROWS, BATCH_BYTES = 20_000, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that reach Python small, whatever a row holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def use_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local session may name none and gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexloom-"))
    return context.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new folder beside the checkpoints, and read from there."""
    path = f"{use_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, without its lineage."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_hot(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """``rows`` with what ``lookup`` has for their ``key``; its column ``n`` counts the rows of each key, and goes.

    Keys with more than a 100,000th of all rows, so at most 100,000 of them, go to all tasks, and
    their rows stay where they are; the others join by key. Both sides are read twice.
    """
    total = lookup.agg(F.sum("n")).first()[0] or 0
    limit = max(1000, total // 100_000)
    hot, rest = lookup.where(F.col("n") > limit).drop("n"), lookup.where(F.col("n") <= limit).drop("n")
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return others.unionByName(rows.join(F.broadcast(hot), key))


def release() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """A function over batches that gives memory back when its task ends."""

    @functools.wraps(run)
    def over(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return over


def tidy_group(run):
    """A function over a group that gives memory back after it."""

    def one(table):
        try:
            return run(table)
        finally:
            release()

    def two(left, right):
        try:
            return run(left, right)
        finally:
            release()

    return one if run.__code__.co_argcount == 1 else two  # Spark counts the parameters


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all UTF-8 bytes, int64 offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, ends - ends[0]


def binary_column(body: np.ndarray, offsets: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """A binary or string column over one buffer; offsets must fit 32 bits."""
    return pa.Array.from_buffers(kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(body))])


def spread(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
