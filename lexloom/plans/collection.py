"""A collection whose tables change together: deleting, restoring, renaming and purging papers, each as one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import ids
from lexloom.operators import dense, lifecycle, registry
from lexloom.operators.ranking import checkpointed
from lexloom.sources.store import Store

KEY = ["category", "paper_id"]
STONES = "category string, paper_id string, reason string, deleted_at string"
#: Tables that a deletion hides and a restoration shows again; vectors are pruned and made anew.
HIDDEN = ("papers", "chunks", "overrides")
Embed = Callable[[DataFrame], DataFrame]


class Collection:
    """Tables papers, chunks and vectors (with category, paper_id and, below papers, chunk_id), overrides, registry and tombstones.

    An embedder takes chunks and gives their rows of vectors. What raises leaves everything as it was.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)

    def create(self, **tables: DataFrame) -> None:
        with self.store.commit("create") as c:
            for name, df in tables.items():
                c.replace(name, df)
            c.replace("tombstones", self.spark.createDataFrame([], STONES))

    def live(self, name: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
        """A table as readers see it."""
        t = tables or self.store.tables()
        return lifecycle.visible(t[name], t["tombstones"]) if name in HIDDEN else t[name]

    def aligned(self, tables: dict[str, DataFrame] | None = None) -> bool:
        """Whether vectors and visible chunks are each other's."""
        t = tables or self.store.tables()
        return not dense.coherence(t["vectors"], self.live("chunks", t), "chunk_id").limit(1).count()

    def delete(self, papers: DataFrame, reason: str, now: str, embed: Embed | None = None) -> int:
        """Hides papers and takes their vectors out of the index; returns how many papers went.

        Vectors of the others stay as they are. Where index and chunks didn't agree before, all
        visible chunks are embedded anew, or ValueError is raised where there is no embedder.
        """
        t = self.store.tables()
        gone = checkpointed(self.live("papers", t).join(papers.select(*KEY).distinct(), KEY, "left_semi").select(*KEY).distinct())
        n = gone.count()
        if not n:
            return 0
        whole = self.aligned(t)
        if not whole and embed is None:
            raise ValueError("vectors and chunks don't agree, and there is no embedder to make them anew")
        stones = lifecycle.quarantine(t["tombstones"], gone, reason, now)
        with self.store.commit(f"delete {n}: {reason}") as c:
            c.replace("tombstones", stones)
            left = lifecycle.visible(t["chunks"], stones)
            c.replace("vectors", t["vectors"].join(gone, KEY, "left_anti") if whole else embed(left))
        return n

    def restore(self, papers: DataFrame, embed: Embed) -> int:
        """Shows papers again and embeds their chunks; returns how many came back."""
        t = self.store.tables()
        back = checkpointed(t["tombstones"].join(papers.select(*KEY).distinct(), KEY, "left_semi").select(*KEY).distinct())
        n = back.count()
        if n:
            with self.store.commit(f"restore {n}") as c:
                stones = lifecycle.restore(t["tombstones"], back)
                c.replace("tombstones", stones)
                _, new = dense.incremental(t["vectors"], lifecycle.visible(t["chunks"], stones), "chunk_id")
                c.append("vectors", embed(new).select(*t["vectors"].columns))
        return n

    def rename(self, renames: DataFrame) -> None:
        """New ids by (category, old_id, new_id) in every table that has them; raises TakenError where one is taken."""
        t = self.store.tables()
        own = {name: df for name, df in t.items() if {*KEY} <= {*df.columns} and name != "registry"}
        changed = lifecycle.rename(own, renames, "papers")
        with self.store.commit("rename") as c:
            for name, df in changed.items():
                c.replace(name, df)

    def purge(self, dois: DataFrame, today: str, reason: str = "") -> int:
        """Papers of these DOIs, each in the first category that has it, go from every table for good, and the DOIs are blocked."""
        t = self.store.tables()
        wanted = dois.select(ids.doi("doi", "corpus").alias("_d")).where("_d != ''").distinct()
        hits = t["papers"].withColumn("_d", ids.doi("doi", "corpus")).join(wanted, "_d", "left_semi")
        first = hits.groupBy("_d").agg(F.min("category").alias("category"))
        gone = checkpointed(hits.join(first, ["_d", "category"]).select(*KEY).distinct())
        n = gone.count()
        with self.store.commit(f"purge {n}") as c:
            for name in (*HIDDEN, "vectors", "tombstones"):
                c.replace(name, t[name].join(gone, KEY, "left_anti"))
            c.replace("registry", registry.block(t["registry"], dois, today, reason))
        return n
