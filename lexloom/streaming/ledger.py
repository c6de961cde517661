"""Micro-batches that count once, whatever breaks: what a batch writes and its number become visible together.

A stream that is started anew after a failure hands its last batch over again. Here the rows of a
batch and a line of the ledger are one commit of a store: either both are there, and the batch is
passed over, or neither is, and it is done from the beginning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.registry import upsert
from lexloom.sources.providers import Embedder, embed
from lexloom.sources.store import Commit, Store

Write = Callable[[Commit, DataFrame], None]


def is_done(store: Store, stream: str, batch: int) -> bool:
    """Whether this batch of the stream is in the ledger."""
    return store.has("ledger") and bool(store.read("ledger").where((F.col("stream") == stream) & (F.col("batch") == batch)).limit(1).count())


def once(store: Store, stream: str, write: Write) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that lets ``write`` stage a batch's tables unless its number is in the ledger."""

    def run(rows: DataFrame, batch: int) -> None:
        if is_done(store, stream, batch):
            return
        with store.commit(f"{stream} {batch}") as c:
            write(c, rows)
            line = rows.sparkSession.createDataFrame([(stream, batch)], "stream string, batch long")
            c.append("ledger", line.coalesce(1))

    return run


def appended(name: str, by: list[str] | None = None) -> Write:
    """Rows at the end of a table."""
    return lambda c, rows: c.append(name, rows, by)


def logged(name: str, ts: str = "ts") -> Write:
    """Rows of a log, in the folder of their month."""
    return lambda c, rows: c.append(name, rows.withColumn("month", F.date_format(ts, "yyyy-MM")), ["month"])


def embedded(store: Store, name: str, make: Callable[[], Embedder], key: str = "chunk_id", text: str = "text") -> Write:
    """Vectors of chunks that the table has none of, by their key and the hash of their text; of equal chunks in a batch one counts."""

    def write(c: Commit, rows: DataFrame) -> None:
        hashed = rows.withColumn("sha256", F.sha2(F.coalesce(text, F.lit("")), 256)).dropDuplicates([key, "sha256"])
        if store.has(name):
            hashed = hashed.join(store.read(name).select(key, "sha256"), [key, "sha256"], "left_anti")
        c.append(name, embed(hashed.select(key, "sha256", text), make, text).drop(text))

    return write


def registered(store: Store, name: str, today: str, seq: str = "seq") -> Write:
    """The registry after an upsert of the batch's rows; batches come in the order of ``seq``."""
    return lambda c, rows: c.replace(name, upsert(store.read(name), rows, today, seq))


def run_once(stream: DataFrame, store: Store, name: str, write: Write, checkpoint: str) -> StreamingQuery:
    """Takes in what there is of a stream, each batch as one commit, and stops."""
    query = stream.writeStream.foreachBatch(once(store, name, write)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
