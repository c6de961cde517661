"""Fusing rankings, quotas for attachments, filters and pools."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.ids import year_in_id
from lexloom.operators.ranking import numbered

RRF_K = 60
#: Rows that one task may number.
ONE_TASK = 10_000


def ranked(scored: DataFrame, order: list[Column], pool: int | None = None) -> DataFrame:
    """``scored`` with rank 0, 1, ... in the given total order, the best ``pool`` of them.

    A small pool is taken first and numbered in one place; otherwise rows are numbered where they are.
    """
    if pool is not None and pool <= ONE_TASK:
        top = scored.orderBy(*order).limit(pool)
        return top.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))
    out = numbered(scored, order).withColumn("rank", F.col("rank").cast("int"))
    return out if pool is None else out.where(F.col("rank") < pool)


def rrf(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, score): the sum of 1 / (k + rank + 1) over rankings with id and rank from 0."""
    parts = [r.select("id", (1.0 / (F.lit(k) + F.col("rank") + 1)).alias("part")) for r in rankings]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("part").alias("score"))


def pool_size(k: int, total: int, filtered: bool) -> int:
    """Everything where a filter follows, so that it can't starve the result; else ten times ``k``, 200 at least."""
    return total if filtered else min(total, max(10 * k, 200))


@dataclass(frozen=True)
class ChunkFilter:
    """What a search may be cut to. Empty values ask for nothing."""

    type: str | None = None
    paper: str | list[str] | None = None
    sections: list[str] = field(default_factory=list)
    year_start: int | None = None
    year_end: int | None = None
    doc_type: str | None = None

    def __bool__(self) -> bool:
        return any((self.type, self.paper, self.sections, self.year_start, self.year_end, self.doc_type))

    def condition(self) -> Column:
        """True for chunks that pass. A text asks for part of paper_id, a list for one of its ids; a null year fails a bound."""
        out = F.lit(True)
        if self.doc_type:
            out &= F.col("doc_type") == self.doc_type
        if self.type:
            out &= F.col("type") == self.type
        if isinstance(self.paper, str) and self.paper:
            out &= F.lower("paper_id").contains(self.paper.lower())
        elif self.paper:
            out &= F.col("paper_id").isin(list(self.paper))
        if self.sections:
            out &= F.col("section_canonical").isin(list(self.sections))
        year = F.coalesce(F.nullif(F.col("year").cast("int"), F.lit(0)), year_in_id("paper_id"))
        if self.year_start:
            out &= year >= self.year_start
        if self.year_end:
            out &= year <= self.year_end
        return F.coalesce(out, F.lit(False))


def export_condition(year_start: int | None = None, year_end: int | None = None, quality: float = 0.0, with_doi: bool = False) -> Column:
    """For exports a null year passes; a null quality fails once any is asked."""
    out = F.lit(True)
    if with_doi:
        out &= F.coalesce(F.trim("doi"), F.lit("")) != ""
    if year_start is not None and year_end is not None:
        out &= F.col("year").isNull() | F.col("year").between(year_start, year_end)
    if quality > 0:
        out &= F.coalesce(F.col("quality_score") >= quality, F.lit(False))
    return out


def catalogue_condition(text: str = "", journals: list[str] | None = None, year_start: int | None = None, year_end: int | None = None, doi: str = "any") -> Column:
    """For the catalogue a null year fails; ``doi`` is any, with or without."""
    out = F.lit(True)
    if text:
        hit = reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False)) for c in ("title", "doi", "authors")])
        out &= hit
    if journals:
        out &= F.col("journal").isin(journals)
    if year_start is not None and year_end is not None:
        out &= F.coalesce(F.col("year").between(year_start, year_end), F.lit(False))
    has = F.coalesce(F.trim("doi"), F.lit("")) != ""
    return out & (has if doi == "with" else ~has if doi == "without" else F.lit(True))


def fuse_dense(corpus: DataFrame, attached: DataFrame, k: int, least: int) -> DataFrame:
    """(source, id, distance, position): the attachment's nearest ``least`` are in; the rest and all order go by distance.

    At equal distance reserved rows come first, then other attached rows, then the corpus.
    """
    own = ranked(attached.select("id", "distance"), [F.col("distance"), F.col("id")], max(k, 1)).withColumn("reserved", F.col("rank") < min(least, k))
    both = own.select(F.lit("attachment").alias("source"), "id", "distance", F.when(F.col("reserved"), 0).otherwise(1).alias("turn")).unionByName(corpus.select(F.lit("corpus").alias("source"), "id", "distance", F.lit(2).alias("turn")))
    filled = both.orderBy(F.when(F.col("turn") == 0, 0).otherwise(1), "distance", "turn", "id").limit(k)
    return filled.withColumn("position", F.row_number().over(Window.orderBy("distance", "turn", "id"))).select("source", "id", "distance", "position")


def fuse_hybrid(corpus: DataFrame, attached: DataFrame, k: int, least: int) -> DataFrame:
    """(source, id, score, position): the attachment's nearest ``least``, then the corpus by its fused score.

    A fused score and a distance can't be compared, so the attachment has its quota and no more.
    """
    own = ranked(attached.select("id", "distance"), [F.col("distance"), F.col("id")], max(min(least, k), 0))
    both = own.select(F.lit("attachment").alias("source"), "id", F.col("distance").alias("score"), F.lit(0).alias("turn"), F.col("distance").alias("by")).unionByName(corpus.select(F.lit("corpus").alias("source"), "id", "score", F.lit(1).alias("turn"), (-F.col("score")).alias("by")))
    return ranked(both, [F.col("turn"), F.col("by"), F.col("id")], k).select("source", "id", "score", (F.col("rank") + 1).alias("position"))


def quota_by_group(scored: DataFrame, group: str, quota: int, k: int) -> DataFrame:
    """Each group's nearest ``quota``, then the ``k`` nearest of these by distance."""
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("distance", "id"))).where(F.col("n") <= quota).drop("n")
    return best.orderBy("distance", "id").limit(k)


def first_by_group(ranking: DataFrame, group: str, k: int) -> DataFrame:
    """(qid, group, position): groups by their first place in a ranking of members, from 1, ``k`` at most."""
    best = ranking.groupBy("qid", group).agg(F.min("rank").alias("first"))
    return best.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("first", group))).where(F.col("position") <= k).select("qid", group, "position")
