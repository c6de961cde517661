"""Retrieval quality: hits, reciprocal ranks, pools of candidates and golden sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judge(rankings: DataFrame, relevant: DataFrame, k: int, asked: DataFrame | None = None) -> DataFrame:
    """(qid, hit, rr, first_position): of every question with a relevant paper, found among the first ``k`` or not.

    ``rankings`` has qid, item and position from 1; ``relevant`` has qid and item. ``asked`` (qid)
    names the questions where ``relevant`` holds no more than what rankings found.
    """
    first = rankings.where(F.col("position") <= k).join(relevant, ["qid", "item"], "left_semi").groupBy("qid").agg(F.min("position").alias("first_position"))
    asked = (relevant if asked is None else asked).select("qid").distinct()
    return asked.join(first, "qid", "left").select("qid", F.col("first_position").isNotNull().cast("int").alias("hit"), F.coalesce(1.0 / F.col("first_position"), F.lit(0.0)).alias("rr"), "first_position")


def hit_rate_and_mrr(judged: DataFrame) -> DataFrame:
    return judged.agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("rr"), 6).alias("mrr"))


def pool(**rankings: DataFrame) -> DataFrame:
    """(qid, item, a position for each ranking, best): candidates of all rankings, by their best place."""
    out = None
    for name, r in rankings.items():
        own = r.select("qid", "item", F.col("position").alias(name))
        out = own if out is None else out.join(own, ["qid", "item"], "full")
    return out.withColumn("best", F.least(*(F.coalesce(F.col(n), F.lit(1 << 30)) for n in rankings)) if len(rankings) > 1 else F.col(next(iter(rankings))))


def reviewed(lines: DataFrame) -> DataFrame:
    """(qid, item) of marked lines of a review: a line that names a question holds for the lines after it.

    ``lines`` has review, seq, qid (null but where a question begins), item and mark.
    """
    carried = lines.withColumn("qid", F.last("qid", ignorenulls=True).over(Window.partitionBy("review").orderBy("seq")))
    return carried.where(F.lower(F.trim("mark")).isin("x", "1", "si", "sí", "yes") & F.col("item").isNotNull()).select("qid", "item")


def golden(marked: DataFrame, known: DataFrame) -> DataFrame:
    """(qid, relevant): marked items by question; an item that nobody knows stops the build."""
    unknown = marked.join(known.select("item"), "item", "left_anti").select("item").distinct().orderBy("item").limit(5).collect()
    if unknown:
        raise ValueError("unknown items: " + ", ".join(str(r.item) for r in unknown))
    return marked.groupBy("qid").agg(F.sort_array(F.collect_set("item")).alias("relevant"))
