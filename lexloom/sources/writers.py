"""Sinks: tables as files, versioned snapshots with a pointer, and append-only logs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.store import Commit, Store


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", mark: bool = False) -> None:
    """``mark``: every file begins with the byte order mark that spreadsheet programs look for."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode(mode).options(header="true", encoding="UTF-8").csv(path)


def write_report(frames: dict[str, DataFrame], path: str) -> None:
    """One CSV folder for each sheet of a report."""
    for name, df in frames.items():
        write_csv(df, f"{path}/{name}", "overwrite")


def write_version(df: DataFrame, table: str) -> str:
    """A new version of a table, then the pointer to it; readers see the old one until the pointer is there."""
    spark, name = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{name}")
    spark.createDataFrame([(name,)], "version string").coalesce(1).withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(f"{table}/_pointer")
    return name


def read_version(spark: SparkSession, table: str, back: int = 0) -> DataFrame:
    """The newest version, or one ``back`` versions older."""
    versions = spark.read.parquet(f"{table}/_pointer").orderBy(F.desc("written_at")).limit(back + 1).collect()
    return spark.read.parquet(f"{table}/{versions[back].version}")


def write_snapshot(files: DataFrame, folder: str, taken_at: str, keep: int = 12) -> str | None:
    """``files`` (path, content) as the snapshot ``taken_at``, or None where paths and contents are those of the last one.

    Contents are stored by their hash, each once whatever paths and snapshots have it, so a
    snapshot writes what no kept one has. Contents and manifest become visible together. Of the
    snapshots only the newest ``keep`` stay, and what none of them names is swept. No files, no
    snapshot. A path that is there twice is two rows; a null content is an empty one.
    """
    spark, store = files.sparkSession, Store(files.sparkSession, folder)
    hashed = files.select("path", F.coalesce("content", F.lit(b"")).alias("content")).withColumn("sha256", F.sha2("content", 256))
    now = hashed.select("path", "sha256", F.octet_length("content").cast("long").alias("bytes"))
    if not now.limit(1).count():
        return None
    unseen = hashed.select("sha256", "content")
    if store.has("manifest"):
        last = store.read("manifest")
        if not now.exceptAll(last).limit(1).count() and not last.exceptAll(now).limit(1).count():
            return None
        unseen = unseen.join(store.read("contents").select("sha256"), "sha256", "left_anti")
    with store.commit(taken_at) as c:
        c.append("contents", unseen.dropDuplicates(["sha256"]))
        c.replace("manifest", now)
        named = now.select("sha256")
        for m in store.history()[: max(0, keep - 1)]:
            named = named.unionByName(store.read("manifest", m["seq"]).select("sha256"))
        _keep_named(spark, store, c, named.distinct())
    if keep > 0:
        store.sweep(keep)
    return taken_at


def _keep_named(spark: SparkSession, store: Store, commit: Commit, named: DataFrame) -> None:
    """Contents without folders that have none of ``named``; folders that have less than half of theirs are written anew."""
    paths, schema = commit.tables["contents"]["paths"], commit.tables["contents"]["schema"]
    each = [spark.read.parquet(p).select(F.lit(i).alias("folder"), "sha256") for i, p in enumerate(paths)]
    every = reduce(DataFrame.unionByName, each).join(named.withColumn("named", F.lit(1)), "sha256", "left")
    count = {r.folder: (r.n, r.live) for r in every.groupBy("folder").agg(F.count("*").alias("n"), F.count("named").alias("live")).collect()}  # a row for each folder
    live = [i for i in range(len(paths)) if count.get(i, (0, 0))[1]]
    thin = [i for i in live if 2 * count[i][1] < count[i][0]]
    commit.tables["contents"] = {"paths": [paths[i] for i in live if i not in thin], "schema": schema}
    if thin:
        commit.append("contents", spark.read.parquet(*(paths[i] for i in thin)).join(named, "sha256", "left_semi").select("sha256", "content"))


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """Names of the whole snapshots under ``folder``, the oldest first."""
    return [m["note"] for m in reversed(Store(spark, folder).history())]


def read_snapshot(spark: SparkSession, folder: str, taken_at: str | None = None) -> DataFrame:
    """(path, content) of a snapshot, by default of the newest. Raises KeyError where it isn't there."""
    store = Store(spark, folder)
    found = next((m for m in store.history() if taken_at is None or m["note"] == taken_at), None)
    if found is None:
        raise KeyError(taken_at)
    return store.read("manifest", found["seq"]).join(store.read("contents", found["seq"]), "sha256").select("path", "content")


def append_log(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Rows to the folder of their month."""
    rows.withColumn("month", F.date_format(ts, "yyyy-MM")).write.mode("append").partitionBy("month").json(path)
