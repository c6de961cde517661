from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexloom.operators.lifecycle import TakenError
from lexloom.plans.collection import KEY, Collection
from lexloom.sources.store import ConflictError, Store


def sizes(store: Store, at: int | None = None) -> dict[str, int]:
    return {n: df.count() for n, df in store.tables(at).items()}


def test_commits_are_seen_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    assert store.history() == [] and store.tables() == {} and not store.has("a") and store.sweep() == 0
    with store.commit("one") as c:
        c.replace("a", spark.range(5))
        c.append("b", spark.range(4).withColumn("p", F.col("id") % 2), by=["p"])
    with store.commit("two") as c:
        c.append("b", spark.range(3).withColumn("p", F.col("id") % 2), by=["p"])
        c.replace("a", spark.range(1))
    assert sizes(store) == {"a": 1, "b": 7} and sizes(store, 1) == {"a": 5, "b": 4}
    assert "PartitionFilters: [isnotnull(p" in store.read("b").where("p = 1")._jdf.queryExecution().toString()
    with pytest.raises(RuntimeError, match="between two writes"):
        with store.commit() as c:
            c.replace("a", spark.range(100))
            raise RuntimeError("between two writes")
    assert sizes(store) == {"a": 1, "b": 7} and store.manifest()["note"] == "two"
    with pytest.raises(KeyError):
        store.read("c")
    assert store.rollback() == 3 and sizes(store) == {"a": 5, "b": 4}
    with pytest.raises(ValueError, match="no such commit"):
        store.rollback(99)


def test_of_two_commits_at_once_one_wins(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    with store.commit() as c:
        c.replace("a", spark.range(1))
    with pytest.raises(ConflictError):
        with store.commit() as late:
            late.replace("a", spark.range(9))
            with store.commit() as soon:
                soon.replace("a", spark.range(2))
    assert sizes(store) == {"a": 2}


def test_sweep_keeps_what_is_named(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    for n in range(4):
        with store.commit() as c:
            c.replace("a", spark.range(n + 1))
            if n == 0:
                c.append("b", spark.range(7))
    assert store.sweep(keep=2) == 2
    assert [m["seq"] for m in store.history()] == [4, 3] and sizes(store) == {"a": 4, "b": 7} and sizes(store, 3) == {"a": 3, "b": 7}


@pytest.fixture
def collection(spark, tmp_path):
    c = Collection(spark, f"{tmp_path}/collection")
    chunks = spark.range(12).select(F.col("id").alias("chunk_id"), F.when(F.col("id") < 8, "a").otherwise("b").alias("category"), F.concat(F.lit("p"), F.expr("id div 2")).alias("paper_id"))
    embed = lambda rows: rows.select("chunk_id", *KEY, F.array(F.lit(1.0)).alias("embedding"))
    papers = chunks.select(*KEY).distinct().withColumn("doi", F.concat(F.lit("10.1/"), "paper_id"))
    registry = spark.createDataFrame([], ", ".join(f"{n} string" for n in ("doi", "title", "year", "category", "landing_url", "status", "reason", "last_checked", "notes", "snooze_until")))
    c.create(papers=papers, chunks=chunks, vectors=embed(chunks), overrides=papers.select(*KEY, F.lit("year").alias("field")), registry=registry)
    return c, embed


def named(spark, *ids):
    return spark.createDataFrame([("a" if int(i[-1]) < 4 else "b", i) for i in ids], "category string, paper_id string")


def test_delete_hides_and_prunes_in_one_commit(spark, collection):
    c, embed = collection
    assert c.delete(named(spark, "p9"), "none", "2026") == 0 and c.store.manifest()["seq"] == 1
    assert c.delete(named(spark, "p1", "p4", "p9"), "bad", "2026") == 2 and c.store.manifest()["seq"] == 2
    assert (c.live("papers").count(), c.live("chunks").count(), c.live("vectors").count(), c.live("overrides").count()) == (4, 8, 8, 4)
    assert c.aligned() and c.store.read("chunks").count() == 12
    assert c.delete(named(spark, "p1"), "again", "2027") == 0
    assert c.restore(named(spark, "p1"), embed) == 1 and c.aligned() and c.live("vectors").count() == 10
    assert [r.reason for r in c.store.read("tombstones").collect()] == ["bad"]


def test_delete_stops_between_two_writes(spark, collection, monkeypatch):
    """Whatever breaks, readers see what was there before."""
    c, _ = collection
    from lexloom.sources.store import Commit

    replace, done = Commit.replace, []

    def second_fails(self, name, df, by=None):
        if done:
            raise OSError("disk full")
        done.append(name)
        replace(self, name, df, by)

    monkeypatch.setattr(Commit, "replace", second_fails)
    with pytest.raises(OSError, match="disk full"):
        c.delete(named(spark, "p1"), "bad", "2026")
    assert done == ["tombstones"] and c.live("papers").count() == 6 and c.live("vectors").count() == 12 and c.store.read("tombstones").count() == 0


def test_an_index_out_of_step_is_made_anew(spark, collection):
    c, embed = collection
    with c.store.commit("vectors lost") as staged:
        staged.replace("vectors", c.store.read("vectors").where("chunk_id > 2"))
    with pytest.raises(ValueError, match="no embedder"):
        c.delete(named(spark, "p4"), "bad", "2026")
    assert c.live("papers").count() == 6
    assert c.delete(named(spark, "p4"), "bad", "2026", embed) == 1
    assert c.aligned() and c.live("vectors").count() == 10


def test_rename_and_purge_touch_every_table(spark, collection):
    c, _ = collection
    moved = lambda old, new: spark.createDataFrame([("a", old, new)], "category string, old_id string, new_id string")
    with pytest.raises(TakenError):
        c.rename(moved("p1", "p2"))
    assert c.store.manifest()["seq"] == 1
    c.rename(moved("p1", "p77"))
    for name in ("papers", "chunks", "vectors", "overrides"):
        assert c.live(name).where("paper_id = 'p77'").count() > 0 and c.live(name).where("paper_id = 'p1'").count() == 0
    assert c.purge(spark.createDataFrame([("10.1/p2",), ("10.1/none",)], "doi string"), "2026", "retracted") == 1
    assert c.store.read("papers").count() == 5 and c.store.read("vectors").count() == 10
    assert sorted((r.doi, r.status) for r in c.store.read("registry").collect()) == [("10.1/none", "blocked"), ("10.1/p2", "blocked")]
