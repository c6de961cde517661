"""Several tables with one history: staged folders that a manifest of one file makes visible together.

A commit writes what is new of each table to folders of its own, then a manifest that names all
folders of all tables. Readers go by the newest manifest, so they see all of a commit or none of
it; what a broken commit has staged is in no manifest. An older manifest, published again, is a
rollback. All goes through Spark's readers and writers, so the folder may be in any store.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "token string, tables string, note string, written_at timestamp"


class ConflictError(RuntimeError):
    """Another commit came first; nothing of this one is visible."""


class Commit:
    """Tables that are staged on top of the manifest that was the newest when the commit began."""

    def __init__(self, store: Store, base: int, tables: dict[str, dict]):
        self.store, self.base, self.tables = store, base, dict(tables)

    def _stage(self, name: str, df: DataFrame, by: list[str] | None) -> str:
        path = f"{self.store.folder}/data/{name}/staged={uuid.uuid4().hex}"
        writer = df.write.partitionBy(*by) if by else df.write
        if self.store.compression:
            writer = writer.option("compression", self.store.compression)
        writer.parquet(path)
        return path

    def replace(self, name: str, df: DataFrame, by: list[str] | None = None) -> None:
        self.tables[name] = {"paths": [self._stage(name, df, by)], "schema": df.schema.jsonValue()}

    def append(self, name: str, df: DataFrame, by: list[str] | None = None) -> None:
        """More rows of a table; its columns stay those of its first rows."""
        before = self.tables.get(name, {"paths": [], "schema": df.schema.jsonValue()})
        self.tables[name] = before | {"paths": [*before["paths"], self._stage(name, df, by)]}

    def newest(self, name: str) -> DataFrame:
        """What this commit has staged last of a table."""
        return self.store._of(name, self.tables[name] | {"paths": self.tables[name]["paths"][-1:]})

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)


class Store:
    """Tables under a folder. ``at`` names a commit by its number; without it, the newest counts."""

    def __init__(self, spark: SparkSession, folder: str, compression: str | None = None):
        self.spark, self.folder, self.compression = spark, folder.rstrip("/"), compression

    def _manifests(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{_MANIFEST}, seq long").json(f"{self.folder}/manifests").where("tables IS NOT NULL")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def history(self) -> list[dict]:
        """(seq, note, written_at, tables) of whole commits, the newest first. Of two that took one number the least token counts."""
        found = self._manifests()
        rows = [] if found is None else sorted(found.collect(), key=lambda r: (-r.seq, r.token))  # a row for each commit
        first = {r.seq: r for r in reversed(rows)}
        return [{"seq": s, "token": r.token, "note": r.note, "written_at": r.written_at, "tables": json.loads(r.tables)} for s, r in sorted(first.items(), reverse=True)]

    def manifest(self, at: int | None = None) -> dict | None:
        history = self.history()
        return next((m for m in history if at is None or m["seq"] == at), None)

    def has(self, name: str, at: int | None = None) -> bool:
        m = self.manifest(at)
        return bool(m and m["tables"].get(name))

    def read(self, name: str, at: int | None = None) -> DataFrame:
        """A table as a commit left it; raises KeyError where that commit has no such table."""
        m = self.manifest(at)
        if not m or name not in m["tables"]:
            raise KeyError(name)
        return self._of(name, m["tables"][name])

    def tables(self, at: int | None = None) -> dict[str, DataFrame]:
        """All tables of one commit, so that what is read together belongs together."""
        m = self.manifest(at)
        return {n: self._of(n, table) for n, table in m["tables"].items()} if m else {}

    def _of(self, name: str, table: dict) -> DataFrame:
        schema = StructType.fromJson(table["schema"])  # no file may be there to tell it
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/data/{name}").parquet(*table["paths"]).select(*schema.names)

    @contextmanager
    def commit(self, note: str = "") -> Iterator[Commit]:
        """What is staged in the body becomes visible when the body ends, and not at all where it raises."""
        m = self.manifest()
        staged = Commit(self, m["seq"] if m else 0, m["tables"] if m else {})
        yield staged
        self._publish(staged.base + 1, staged.tables, note)

    def _publish(self, seq: int, tables: dict[str, dict], note: str) -> None:
        token = uuid.uuid4().hex
        row = self.spark.createDataFrame([(token, json.dumps(tables), note)], "token string, tables string, note string").withColumn("written_at", F.current_timestamp())
        try:
            row.coalesce(1).write.json(f"{self.folder}/manifests/seq={seq}")  # fails where the number is taken
        except AnalysisException as e:
            if e.getCondition() == "PATH_ALREADY_EXISTS":
                raise ConflictError(f"commit {seq} is there already") from e
            raise
        if self.manifest(seq)["token"] != token:
            raise ConflictError(f"commit {seq} is there already")

    def rollback(self, to: int | None = None) -> int:
        """The tables of an older commit, by default the one before the newest, as a new commit; returns its number."""
        history = self.history()
        target = next((m for m in history if m["seq"] == to), None) if to is not None else history[1] if len(history) > 1 else None
        if target is None:
            raise ValueError("no such commit")
        self._publish(history[0]["seq"] + 1, target["tables"], f"rollback to {target['seq']}")
        return history[0]["seq"] + 1

    def sweep(self, keep: int = 12, staged_before_hours: float = 24.0) -> int:
        """Empties folders that none of the newest ``keep`` commits names, and older manifests; returns how many folders.

        Staged folders of commits that may still be under way stay for so many hours.
        """
        history = self.history()
        named = {p.rstrip("/").rpartition("/data/")[2] for m in history[:keep] for t in m["tables"].values() for p in t["paths"]}
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.folder}/data")
        except AnalysisException:
            return 0
        own = F.regexp_extract("path", r"/data/([^/]+/[^/]+)/", 1)
        known = {p.rstrip("/").rpartition("/data/")[2] for m in history[keep:] for t in m["tables"].values() for p in t["paths"]}
        found = files.where(F.col("length") > 0).groupBy(own.alias("own")).agg(F.max("modificationTime").alias("at")).where(~F.col("own").isin(list(named)) if named else F.lit(True))
        late = F.col("at") < F.current_timestamp() - F.expr(f"make_dt_interval(0, 0, 0, {float(staged_before_hours) * 3600})")
        gone = [r.own for r in found.where(F.col("own").isin(list(known)) | late if known else late).collect()]  # a row for each folder
        nothing = self.spark.createDataFrame([], "swept boolean")
        for own_folder in gone:
            nothing.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/data/{own_folder}")
        for m in history[keep:]:
            nothing.coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifests/seq={m['seq']}")
        return len(gone)
