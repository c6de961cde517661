"""Searching a collection of chunks: dense, lexical or both, filters, quotas and citations, as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.ids import year_in_id
from lexloom.operators.blocks import fused
from lexloom.operators.citations import cited, contexts
from lexloom.operators.dense import distances, grid, nearest
from lexloom.operators.fusion import ChunkFilter, fuse_dense, fuse_hybrid, pool_size, ranked, rrf
from lexloom.operators.lexical import bm25_query, counted_terms, question_weights
from lexloom.operators.ranking import checkpointed


@dataclass(frozen=True)
class SearchSpec:
    """A question: its text, its vector, how many chunks to return and from which."""

    text: str
    vector: list[float] | None = None
    k: int = 8
    hybrid: bool = False
    only: ChunkFilter = field(default_factory=ChunkFilter)
    scaled: bool = True


def search(chunks: DataFrame, spec: SearchSpec) -> DataFrame:
    """(rank from 0, id, score and the chunk's columns): the best ``k`` chunks that pass the filter.

    ``chunks`` has id, text and embedding. A dense search filters first, which gives the same as
    filtering after. A hybrid search ranks the whole collection on both sides and filters what is
    fused, so the filter changes no statistic. Texts join after the ranking.
    """
    if not spec.hybrid:
        hits = nearest(chunks.where(spec.only.condition()), spec.vector, spec.k, "id", "embedding", spec.scaled).withColumnRenamed("distance", "score")
        top = ranked(hits, [F.col("score"), F.col("id")], spec.k)
        return top.join(chunks.drop("embedding"), "id").orderBy("rank")
    fused = hybrid(chunks, spec)
    kept = fused.join(chunks.drop("embedding"), "id").where(spec.only.condition()) if spec.only else fused
    top = ranked(kept.select("id", "score"), [F.desc("score"), F.col("id")], spec.k)
    return top.join(chunks.drop("embedding"), "id").orderBy("rank")


def hybrid(chunks: DataFrame, spec: SearchSpec) -> DataFrame:
    """(id, score): both rankings, each cut to its pool, fused by reciprocal ranks rounded to nine places."""
    pool = pool_size(spec.k, chunks.count(), bool(spec.only))
    dense = ranked(distances(chunks, spec.vector, "id", "embedding", spec.scaled), [F.col("distance"), F.col("id")], pool)
    lexical = ranked(bm25_query(chunks, spec.text, "id").withColumn("score", F.round("score", 6)), [F.desc("score"), F.col("id")], pool)
    return rrf([dense, lexical]).withColumn("score", F.round("score", 9))


QUESTIONS = "qid string, text string, vector array<double>, k int, hybrid boolean, type string, part string, papers array<string>, sections array<string>, year_start int, year_end int, doc_type string, scaled boolean"
FILTER = ["type", "part", "papers", "sections", "year_start", "year_end", "doc_type"]
#: Different filters of one batch, which all tasks get.
MOST_FILTERS = 10_000


def search_many(chunks: DataFrame, specs: dict[str, SearchSpec]) -> DataFrame:
    """Results of several questions with their qid; each has its own filter. Raises where there is no question.

    As ``search_batch``, without the rows of questions that can't be answered.
    """
    if not specs:
        raise ValueError("no questions")
    rows = []
    for qid, s in specs.items():
        f = s.only
        paper = (f.paper or None, None) if isinstance(f.paper, str) else (None, list(f.paper) if f.paper else None)
        rows.append((qid, s.text, None if s.vector is None else [float(x) for x in s.vector], s.k, s.hybrid, f.type or None, *paper, list(f.sections) or None, f.year_start or None, f.year_end or None, f.doc_type or None, s.scaled))
    return search_batch(chunks, chunks.sparkSession.createDataFrame(rows, QUESTIONS)).where("error IS NULL").drop("error")


def asked_wrongly(questions: DataFrame, dims: int | None) -> DataFrame:
    """``questions`` with ``error``: what keeps a question from being answered, or null."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    again = F.count("*").over(Window.partitionBy("qid")) > 1
    problems = [(F.col("qid").isNull(), "no qid"), (again, "several questions of one qid"), (F.col("k").isNull() | (F.col("k") < 1), "k below 1"), (F.col("vector").isNull(), "no vector"), (bad, "a vector with an entry that is no number")]
    if dims is not None:
        problems.append((F.size("vector") != dims, f"a vector of other than {dims} entries"))
    problems.append((F.coalesce(F.col("hybrid"), F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) == ""), "no text"))
    return questions.withColumn("error", F.coalesce(*(F.when(c, F.lit(m)) for c, m in problems)))


def passes(f) -> Column:
    """Whether a chunk passes a filter given as a struct of FILTER; as ``ChunkFilter.condition`` for one that is known."""
    year = F.coalesce(F.nullif(F.col("year").cast("int"), F.lit(0)), year_in_id("paper_id"))
    conditions = [F.col("doc_type") == f["doc_type"], F.col("type") == f["type"], F.lower("paper_id").contains(F.lower(f["part"])), F.array_contains(f["papers"], F.col("paper_id")), F.array_contains(f["sections"], F.col("section_canonical")), year >= f["year_start"], year <= f["year_end"]]
    asked = [f[c] for c in ("doc_type", "type", "part", "papers", "sections", "year_start", "year_end")]
    return reduce(lambda a, b: a & b, (a.isNull() | F.coalesce(c, F.lit(False)) for a, c in zip(asked, conditions, strict=True)))


def search_batch(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, rank from 0, id, score, error and the chunk's columns): ``search`` for a table of QUESTIONS, in one plan.

    The plan has the same size for any number of questions. Ranks of hybrid ones are counted where
    they are needed (see ``blocks``); texts are tokenized only where there is a hybrid one. A question that can't be answered
    (no qid or one that others have, no vector or one of other length, k below 1, a hybrid one
    without text) has one row with its error, and the others are as without it. A question that
    nothing answers has no row. Without questions there are no rows.
    """
    spark = chunks.sparkSession
    one = chunks.where("embedding IS NOT NULL").select(F.size("embedding").alias("n")).first()
    judged = checkpointed(asked_wrongly(questions.select(*spark.createDataFrame([], QUESTIONS).columns), one.n if one else None))
    wrong, good = judged.where("error IS NOT NULL").select("qid", "error"), judged.where("error IS NULL")
    filters = good.select(*FILTER).distinct().where(F.coalesce(*(F.col(c).cast("string") for c in FILTER)).isNotNull())
    filters = checkpointed(filters.withColumn("only", F.row_number().over(Window.orderBy(*FILTER)).cast("int")))  # of few rows, see below
    if filters.count() > MOST_FILTERS:
        raise ValueError(f"more than {MOST_FILTERS} different filters: ask in several batches")
    same = reduce(lambda a, b: a & b, (good[c].eqNullSafe(filters[c]) for c in FILTER))
    asked = good.join(F.broadcast(filters), same, "left").select(good["qid"], "text", "vector", "k", F.coalesce(good["hybrid"], F.lit(False)).alias("hybrid"), "only", F.coalesce(good["scaled"], F.lit(True)).alias("scaled"))
    total = chunks.count()
    pool = F.when(F.col("only").isNotNull(), F.lit(total)).otherwise(F.least(F.lit(total), F.greatest(10 * F.col("k"), F.lit(200))))
    asked = checkpointed(asked.withColumn("pool", F.when(F.col("hybrid"), pool).otherwise(F.col("k"))))
    every = filters.agg(F.collect_list(F.struct("only", *FILTER)).alias("filters"))  # one row, of MOST_FILTERS at most
    seen = F.transform(F.filter("filters", passes), lambda f: f["only"])
    kinds = {"type": "string", "paper_id": "string", "section_canonical": "string", "year": "int", "doc_type": "string"}
    described = chunks.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in chunks.columns})
    seen_by = lambda rows: rows.crossJoin(F.broadcast(every)).select("id", F.col("embedding").cast("array<double>").alias("v"), "text", seen.alias("passes"))
    # A hybrid question ranks the whole collection and is filtered afterwards, a dense one first.
    plain = asked.where("NOT hybrid")
    hits = spark.createDataFrame([], f"qid string, id {dict(chunks.dtypes)['id']}, score double, rank int")
    if plain.limit(1).count():
        near = grid(checkpointed(seen_by(described.where("embedding IS NOT NULL")).select("id", "v", "passes")), plain.select("qid", F.col("vector").alias("v"), F.col("k").alias("keep"), "only", "scaled"))
        best = near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id")) - 1).join(plain.select("qid", "k"), "qid").where(F.col("rank") < F.col("k"))
        hits = hits.unionByName(best.select("qid", "id", F.col("distance").alias("score"), F.col("rank").cast("int").alias("rank")))
    both = asked.where("hybrid")
    if both.limit(1).count():
        corpus = counted_terms(seen_by(described))
        terms, avgdl = question_weights(corpus, both.select("qid", F.col("text").alias("query")))
        given = both.select("qid", F.col("vector").alias("v"), "only", "scaled", "k", "pool").join(terms, "qid", "left")
        hits = hits.unionByName(fused(corpus, checkpointed(given), avgdl))
    found = checkpointed(hits).join(chunks.drop("embedding"), "id").withColumn("error", F.lit(None).cast("string")).orderBy("qid", "rank")
    return found.unionByName(wrong, allowMissingColumns=True)


def with_attachment(results: DataFrame, attached: DataFrame, k: int, least: int, hybrid_scores: bool) -> DataFrame:
    """Corpus results and an attachment's chunks (id, distance) under its quota."""
    if hybrid_scores:
        return fuse_hybrid(results.select("id", "score"), attached, k, least)
    return fuse_dense(results.select("id", F.col("score").alias("distance")), attached, k, least)


def deepen(chunks: DataFrame, spec: SearchSpec, papers: list[str]) -> DataFrame:
    """The same question within some papers."""
    only = ChunkFilter(spec.only.type, papers, spec.only.sections, spec.only.year_start, spec.only.year_end, spec.only.doc_type)
    return search(chunks, SearchSpec(spec.text, spec.vector, spec.k, spec.hybrid, only, spec.scaled))


def numbered_context(results: DataFrame, papers: DataFrame) -> DataFrame:
    """(qid, context, chars, tokens) of one question's results with their citation keys as labels."""
    labelled = cited(results, papers).select(F.lit("q").alias("qid"), "n", F.col("cite").alias("label"), "text")
    return contexts(labelled)


#: What an answer is asked to keep to; callers may give rules of their own.
RULES = "Answer from the numbered fragments only. After each statement put the number of its fragment in square brackets, and every number where several support it. Where no fragment answers the question, say that."


def prompts(context: DataFrame, questions: DataFrame, on: str = "qid", rules: str = RULES) -> DataFrame:
    """(qid, prompt): rules, fragments, question."""
    return context.join(questions, on).select(on, F.concat_ws("\n\n", F.lit(rules), F.col("context"), F.col("question")).alias("prompt"))
