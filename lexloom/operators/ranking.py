"""Numbering rows in a total order without bringing them to one task."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import let  # noqa: F401

#: Bytes of an Arrow batch of texts or tokens, about.
BATCH_BYTES = 4 << 20
_ROWS = 33  # bits of a row's number within its partition


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a local session may name none, a cluster must."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexloom-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, as compressed files in the shared folder, which ``emptied`` frees; a checkpoint of the same rows takes several times the room."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def emptied(df: DataFrame) -> None:
    """Frees the files of what ``stored`` returned; it can't be read any more."""
    files = df.inputFiles()
    if files:
        df.sparkSession.createDataFrame([], "freed boolean").coalesce(1).write.mode("overwrite").parquet(unquote(files[0]).rpartition("/")[0])


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action within go when it ends, not when the JVM happens to drop what points to them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches by their bytes, so that what a task holds in Python doesn't grow with its rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def numbered(df: DataFrame, order: list[Column], name: str = "rank", group: list[str] | None = None) -> DataFrame:
    """``df`` with 0, 1, ... in the total order ``order``, within each ``group`` if one is given.

    Rows are sorted over range partitions and kept so; each partition's rows are then counted, and
    its first number is the sum of the counts before. A group may be any share of the rows.
    """
    keys = [*(F.col(g) for g in group or []), *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = checkpointed(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()))
    part, nth = F.shiftrightunsigned("_m", _ROWS), F.col("_m").bitwiseAND((1 << _ROWS) - 1)
    counts = kept.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    before = counts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))  # a row for each partition
    out = kept.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + nth).drop("_m", "_p", "_b")
    if group:
        first = out.groupBy(*group).agg(F.min(name).alias("_f"))
        out = out.join(first, group).withColumn(name, F.col(name) - F.col("_f")).drop("_f")
    return out


def running_max(df: DataFrame, group: list[str], order: list[Column], value: str) -> DataFrame:
    """``df`` with ``value`` as the greatest so far in its group's order. A group may be any share of the rows.

    As in ``numbered``: within range partitions first, then with what the partitions before have.
    """
    keys = [*map(F.col, group), *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = checkpointed(df.repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id()))
    each = kept.groupBy("_p", *group).agg(F.max(value).alias("_m"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    carried = each.select("_p", *group, F.max("_m").over(before).alias("_c"))
    own = F.max(value).over(Window.partitionBy("_p", *group).orderBy(*order))
    return kept.withColumn(value, own).join(carried, ["_p", *group]).withColumn(value, F.greatest(value, "_c")).drop("_p", "_c")
