"""Counts and rates over categories, usage and downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.metadata import blank


def monthly_usage(events: DataFrame, month: str | None = None) -> DataFrame:
    """(month, level, provider, model, n, cost): totals, by provider and by model in one pass."""
    rows = events.withColumn("month", F.date_format("ts", "yyyy-MM"))
    if month:
        rows = rows.where(F.col("month") == month)
    out = rows.groupingSets([["month"], ["month", "provider"], ["month", "model"]], "month", "provider", "model").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 6).alias("cost"), F.grouping("provider").alias("gp"), F.grouping("model").alias("gm"))
    level = F.when(F.col("gp") + F.col("gm") == 2, "total").when(F.col("gm") == 1, "provider").otherwise("model")
    return out.select("month", level.alias("level"), "provider", "model", "n", "cost")


def model_usage(events: DataFrame) -> DataFrame:
    """By model: calls, tokens in and out, cost; free models are left out."""
    out = events.groupBy("model").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 6).alias("cost"))
    return out.where("cost > 0").orderBy(F.desc("cost"), "model")


def share(condition: Column) -> Column:
    """Percent of rows, to the nearest even whole number."""
    return F.bround(100 * F.count_if(condition) / F.count("*"), 0)


def category_quality(papers: DataFrame) -> DataFrame:
    """By category: papers, those with a score, mean score, and percent with DOI, title, year, abstract and five references."""
    return papers.groupBy("category").agg(
        F.count("*").alias("n"),
        F.count("quality_score").alias("n_scored"),
        F.bround(F.round(F.avg("quality_score"), 9), 2).alias("mean_score"),
        share(~blank("doi")).alias("pct_doi"),
        share(~blank("title")).alias("pct_title"),
        share(F.coalesce(F.col("year"), F.lit(0)) != 0).alias("pct_year"),
        share(~blank("abstract")).alias("pct_abstract"),
        share(F.coalesce(F.col("n_references"), F.lit(0)) >= 5).alias("pct_references"),
    )


def top_warnings(papers: DataFrame, k: int = 5) -> DataFrame:
    """(category, warning, n, rank): the most frequent warnings of each category, ties by name."""
    counts = papers.select("category", F.explode("warnings").alias("warning")).groupBy("category", "warning").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("n"), "warning"))).where(F.col("rank") <= k)


def artefact_gaps(categories: DataFrame, expected: str, **artefacts: DataFrame) -> DataFrame:
    """By category: how many of each artefact there are and how many are missing against ``expected``."""
    out = categories
    counts = {expected: None} | dict.fromkeys(artefacts)
    for name in counts:
        n = artefacts[name].groupBy("category").agg(F.count("*").alias(f"n_{name}"))
        out = out.join(n, "category", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0).cast("long")))
    return out.withColumns({f"missing_{name}": F.greatest(F.lit(0).cast("long"), F.col(f"n_{expected}") - F.col(f"n_{name}")) for name in artefacts if name != expected})


def source_pivot(papers: DataFrame, kinds: list[str]) -> DataFrame:
    """By category: papers of each source kind, of any other or none as unknown, and in all."""
    kind = F.when(F.col("source_type").isin(kinds), F.col("source_type")).otherwise("unknown")
    names = [*kinds, "unknown"]
    out = papers.withColumn("_kind", kind).groupBy("category").pivot("_kind", names).count()
    filled = out.select("category", *(F.coalesce(F.col(f"`{k}`"), F.lit(0).cast("long")).alias(k) for k in names))
    return filled.withColumn("total", sum((F.col(f"`{k}`") for k in names), F.lit(0)).cast("long"))


def corpus_manifest(papers: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """By category: papers, chunks, mean quality, and whether a PDF is newer than every index.

    ``files`` has category, kind (pdf or index) and modified.
    """
    p = papers.groupBy("category").agg(F.count("*").alias("n_papers"), F.bround(F.round(F.avg("quality_score"), 9), 3).alias("mean_quality"))
    c = chunks.groupBy("category").agg(F.count("*").alias("n_chunks"))
    f = files.groupBy("category").agg(F.max(F.when(F.col("kind") == "pdf", F.col("modified"))).alias("newest_pdf"), F.max(F.when(F.col("kind") == "index", F.col("modified"))).alias("newest_index"))
    stale = F.coalesce(F.col("newest_pdf") > F.col("newest_index"), F.lit(False))
    return p.join(c, "category", "left").join(f, "category", "left").select("category", "n_papers", F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"), "mean_quality", stale.alias("stale"))


def download_stats(results: DataFrame) -> DataFrame:
    return results.groupBy("status", F.coalesce("method", F.lit("none")).alias("method")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "status", "method")


def catalogue_metrics(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count("*").alias("n"), share(~blank("doi")).alias("pct_doi"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.bround(F.round(F.avg("quality_score"), 9), 2).alias("mean_score"))


def last_queries(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def corpus_header(papers: DataFrame, keywords: DataFrame) -> DataFrame:
    """By category: papers, period and the first six keywords."""
    p = papers.groupBy("category").agg(F.count("*").alias("n_papers"), F.concat_ws("-", F.min("year"), F.max("year")).alias("period"))
    k = keywords.groupBy("category").agg(F.array_join(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("seq", "keyword"))), lambda x: x["keyword"]), 1, 6), ", ").alias("keywords"))
    return p.join(k, "category", "left")


def shortest(docs: DataFrame, n: int = 5, words: str = "n_words", id_col: str = "paper_id") -> DataFrame:
    return docs.orderBy(words, id_col).limit(n)


def listing(papers: DataFrame, chunks: DataFrame, index: DataFrame) -> DataFrame:
    """(category, n_papers, n_chunks, n_vectors, models) of every category that any of the tables names.

    ``index`` has category and model; models are sorted and joined by commas, empty without an index.
    """
    counts = [t.groupBy("category").agg(F.count("*").alias(n)) for t, n in ((papers, "n_papers"), (chunks, "n_chunks"), (index, "n_vectors"))]
    models = index.groupBy("category").agg(F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"))
    out = counts[0].join(counts[1], "category", "full").join(counts[2], "category", "full").join(models, "category", "left")
    return out.fillna(0, ["n_papers", "n_chunks", "n_vectors"]).fillna("", ["models"])
