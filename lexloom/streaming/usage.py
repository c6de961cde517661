"""Structured Streaming over logs and new papers: an extension, beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def usage_windows(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Calls and values by window and type; a window closes when the watermark has passed it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def first_papers(papers: DataFrame, late: str = "30 days") -> DataFrame:
    """Papers as they come, each DOI once within the watermark."""
    return papers.withWatermark("ts", late).dropDuplicatesWithinWatermark(["doi"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Events of a user without a gap, as sessions."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "user_id", "n")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take in what there is, write it once, and stop."""
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
