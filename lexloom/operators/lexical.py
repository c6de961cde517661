"""Lexical ranking: corpus statistics and Okapi BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.operators.ranking import bounded_batches, checkpointed, let

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Terms of all questions, counted in each, up to which their weights go to all tasks; of more they are joined by term.
MOST_WEIGHTS = 500_000


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., toks) as (..., dl, terms, tfs): the different tokens of each row, and how often it has them."""
    for batch in batches:
        toks = batch.column(batch.num_columns - 1)
        size = np.diff(np.asarray(toks.offsets))
        coded = toks.flatten().dictionary_encode()
        row = np.repeat(np.arange(batch.num_rows), size)
        pair, tf = np.unique(row * max(1, len(coded.dictionary)) + np.asarray(coded.indices, np.int64), return_counts=True)
        own, term = np.divmod(pair, max(1, len(coded.dictionary)))
        ends = pa.array(np.searchsorted(own, np.arange(batch.num_rows + 1)), pa.int32())
        made = [pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(term))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "dl", "terms", "tfs"])


def tokenized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, toks) of every row; a null text has no tokens."""
    return docs.select(F.col(id_col).alias("id"), tokens(text_col).alias("toks"))


def corpus_size(toks: DataFrame) -> DataFrame:
    """One row: documents and mean length."""
    return toks.agg(F.count("*").alias("n_docs"), F.avg(F.size("toks")).alias("avgdl"))


def document_frequency(toks: DataFrame) -> DataFrame:
    """(term, df): each document counts a term once."""
    return toks.select(F.explode(F.array_distinct("toks")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def idf(df: DataFrame, size: DataFrame) -> DataFrame:
    """(term, df, idf); negative values are EPSILON times the mean over all terms."""
    raw = df.crossJoin(F.broadcast(size)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # size is one row
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(qid, term, qtf): repeated tokens of a query count as often."""
    return queries.select(F.col(id_col).alias("qid"), F.explode(tokens(text_col)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "qid", query_text: str = "query") -> DataFrame:
    """(qid, id, score) of all pairs with a positive score.

    Statistics cover the whole corpus. Only postings of query terms are made: terms are cut to
    those before the join, and a term's postings meet the queries that ask for it. Null texts
    are empty documents, which count. Without documents or query terms there are no rows. The
    corpus is tokenized once, into the shared checkpoint folder.
    """
    toks = checkpointed(tokenized(docs, doc_id, text))
    size = corpus_size(toks)
    asked = query_terms(queries, query_id, query_text)
    known = asked.select("term").distinct().withColumnRenamed("term", "asked_term")
    weights = idf(document_frequency(toks), size).join(asked, "term").select("term", "idf", "qid", "qtf")
    weights = checkpointed(weights)
    if weights.limit(MOST_WEIGHTS + 1).count() <= MOST_WEIGHTS:  # a term of very many documents is then no task of its own
        weights, known = F.broadcast(weights), F.broadcast(known)
    # By document, so that what the questions give it adds up where its postings are.
    own = toks.select("id", F.size("toks").alias("dl"), F.explode("toks").alias("term")).join(known, F.col("term") == F.col("asked_term"), "left_semi").repartition("id")
    postings = own.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    found = postings.join(weights, "term").crossJoin(F.broadcast(size))  # size is one row
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return found.groupBy("qid", "id").agg(F.sum(part).alias("score")).where("score > 0")


def counted_terms(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with dl, terms and tfs, the counts of each text's tokens, in place of their text; computed once."""
    bounded_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    kinds = dict(docs.dtypes)
    made = docs.select(*rest, tokens(text).alias("toks")).mapInArrow(term_counts, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "dl int, terms array<string>, tfs array<int>"]))
    return checkpointed(made)


def question_weights(corpus: DataFrame, queries: DataFrame) -> tuple[DataFrame, float]:
    """((qid, terms, ws) of each question, the corpus' mean length), from ``counted_terms``."""
    size = corpus.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    df = corpus.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = idf(checkpointed(df), size).join(query_terms(queries, "qid", "query"), "term").select("qid", "term", (F.col("idf") * F.col("qtf")).alias("w"))
    listed = weights.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("x"))  # the terms of a question
    return listed.select("qid", F.col("x.term").alias("terms"), F.col("x.w").alias("ws")), float(size.first().avgdl or 1.0)


def bm25_query(docs: DataFrame, query: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) for one query, of rows with a positive score.

    One pass tokenizes the corpus into the shared checkpoint folder; lengths and counts of the
    query's terms follow from there. Only a negative idf asks for the whole vocabulary.
    """
    spark = docs.sparkSession
    asked = [r.term for r in spark.range(1).select(F.explode(tokens(F.lit(query))).alias("term")).collect()]
    terms = sorted(set(asked))
    counts = lambda w: F.struct(F.size(w).alias("dl"), F.array(*(F.size(w) - F.size(F.array_remove(w, t)) for t in terms)).cast("array<int>").alias("tf"))
    toks = checkpointed(tokenized(docs, doc_id, text))
    kept = checkpointed(toks.select("id", let(F.col("toks"), counts).alias("p"))).select("id", "p.dl", "p.tf")
    stats = kept.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    if not asked or not stats.n:
        return kept.select("id", F.lit(0.0).alias("score")).where(F.lit(False))
    value = lambda df: spark.range(1).select((F.log(F.lit(stats.n - df + 0.5)) - F.log(F.lit(df + 0.5))).alias("x")).first().x
    raw = [value(stats[f"df{i}"]) for i in range(len(terms))]
    if any(r < 0 for r in raw):
        size = spark.createDataFrame([(stats.n,)], "n_docs long")
        mean = document_frequency(toks).crossJoin(F.broadcast(size)).agg(F.avg(F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("m")).first().m  # size is one row
        raw = [EPSILON * mean if r < 0 else r for r in raw]
    score = F.lit(0.0)
    for i, (t, weight) in enumerate(zip(terms, raw, strict=True)):
        tf = F.get("tf", F.lit(i))
        score = score + asked.count(t) * weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(stats.avgdl)))
    return kept.select("id", score.alias("score")).where("score > 0")


def top_by_query(scored: DataFrame, k: int, score: str = "score", descending: bool = True, digits: int = 6) -> DataFrame:
    """The best ``k`` of each query with their rank; scores are rounded first and ties go by id."""
    rounded = scored.withColumn(score, F.round(score, digits))
    order = F.col(score).desc() if descending else F.col(score)
    return rounded.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(order, "id"))).where(F.col("rank") <= k)
