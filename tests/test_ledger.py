from __future__ import annotations

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lexloom.plans.catalog_stores import Counter
from lexloom.sources.store import Store
from lexloom.streaming import ledger


@pytest.fixture
def stream(spark, tmp_path):
    """A folder of files as they come, one a batch."""
    folder = str(tmp_path / "in")

    def add(rows):
        spark.createDataFrame(rows, "chunk_id long, text string").coalesce(1).write.mode("append").json(folder)

    add([(1, "eel"), (2, "x")])
    add([(3, "e" * 3001), (1, "eel"), (3, "e" * 3001)])
    add([(1, "eel, changed"), (4, None)])
    read = lambda: spark.readStream.schema("chunk_id long, text string").option("maxFilesPerTrigger", 1).json(folder)
    return read, add, str(tmp_path / "checkpoint")


def vectors(store):
    return sorted((r.chunk_id, *map(int, r.embedding), r.embed_truncated) for r in store.read("vectors").collect())


WANT = [(1, 3, 2, False), (1, 12, 3, False), (2, 1, 0, False), (3, 2000, 2000, True), (4, 0, 0, False)]


def test_a_stream_that_breaks_embeds_nothing_twice(spark, tmp_path, stream):
    read, add, checkpoint = stream
    store = Store(spark, str(tmp_path / "store"))
    asked = []
    write = ledger.embedded(store, "vectors", Counter)

    def breaks_once(c, rows):
        write(c, rows)
        asked.append(rows.count())
        if len(asked) == 2:
            raise InterruptedError("lost after the vectors were written")

    with pytest.raises(StreamingQueryException):
        ledger.run_once(read(), store, "chunks", breaks_once, checkpoint)
    assert [r.batch for r in store.read("ledger").collect()] == [0] and store.read("vectors").count() == 2
    ledger.run_once(read(), store, "chunks", breaks_once, checkpoint)
    assert vectors(store) == WANT and sorted(r.batch for r in store.read("ledger").collect()) == [0, 1, 2]
    # Spark forgets, the ledger doesn't: the same batches under another checkpoint are passed over.
    ledger.run_once(read(), store, "chunks", breaks_once, f"{checkpoint}-2")
    assert vectors(store) == WANT and len(asked) == 4
    # Another stream over the same chunks finds them embedded.
    ledger.run_once(read(), store, "again", write, f"{checkpoint}-3")
    assert vectors(store) == WANT


def test_logs_lie_by_month(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = spark.createDataFrame([(1, "2024-01-31 23:00:00"), (2, "2024-02-01 00:00:00"), (3, None)], "id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for batch in (0, 1, 1, 0):
        ledger.once(store, "usage", ledger.logged("usage"))(rows, batch)
    assert store.read("usage").groupBy("month").count().where("count = 2").count() == 3
    assert "PartitionFilters: [isnotnull(month" in store.read("usage").where("month = '2024-02'")._jdf.queryExecution().toString()
    assert ledger.is_done(store, "usage", 1) and not ledger.is_done(store, "usage", 2) and not ledger.is_done(store, "other", 1)
