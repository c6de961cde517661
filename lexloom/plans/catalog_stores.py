"""Registered queries of what is stored: inverted indexes, collections that change by commits, batches of questions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions.vectors import normalize
from lexloom.operators.inverted import InvertedIndex, _raw
from lexloom.operators.lexical import EPSILON
from lexloom.operators.ranking import shared_folder
from lexloom.operators.registry import shaped
from lexloom.plans import retrieval
from lexloom.plans.catalog import DISTANCE_SQL, ORACLES, QUESTION, UNIT_SQL, bm25_sql, chunk_collection, query, registry_parts
from lexloom.plans.collection import KEY, Collection
from lexloom.plans.tables import table
from lexloom.sources.readers import file_marks
from lexloom.sources.store import Store
from lexloom.streaming.ledger import embedded, logged, once, registered


def folder_of(spark: SparkSession, d: str, name: str) -> str:
    """A folder beside the checkpoints that stays the same for the same tables while the application runs."""
    return f"{shared_folder(spark)}/{name}-{hashlib.sha256(d.encode()).hexdigest()[:16]}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    from uuid import uuid4

    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def index_of(spark: SparkSession, d: str) -> InvertedIndex:
    """The index of ``documents``; it is looked through anew only where the table's files have changed."""
    index = InvertedIndex(spark, folder_of(spark, d, "lexical"))
    marks = file_marks(spark, f"{d}/documents.parquet")
    if index.marks() != marks:
        index.refresh(table(spark, d, "documents"), marks=marks)
    return index


# --- inverted indexes -------------------------------------------------------------


@query(ORACLES["bm25_topk"])
def bm25_index_topk(spark, d):
    return index_of(spark, d).top_one(QUESTION, 50)


@query(ORACLES["bm25_multi_query"])
def bm25_index_many(spark, d):
    return index_of(spark, d).top(table(spark, d, "benchmark"), 10, "item_id", "text").select("qid", "id", "score", "rank")


OTHER = "haha onen nicht la maison"


@query(f"WITH {bm25_sql(f'SELECT 0 AS qid, {OTHER!r} AS query', 30)} SELECT rank, id, score, (SELECT n_docs FROM size) AS n_docs, true AS ok FROM lexical")
def bm25_index_refresh(spark, d):
    """An index of two thirds of the documents, some with other texts, brought up to date and compacted."""
    docs = table(spark, d, "documents")
    index = InvertedIndex(spark, fresh_folder(spark, "refreshed"))
    index.refresh(docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.reverse("text")).otherwise(F.col("text"))))
    index.refresh(docs)
    index.compact()
    return index.top_one(OTHER, 30).crossJoin(F.broadcast(index.integrity().select("n_docs", "ok")))  # one row


@query(f"WITH {bm25_sql(f'SELECT 0 AS qid, {OTHER!r} AS query', 30).replace('FROM documents)', 'FROM documents WHERE doc_id % 11 <> 0)')} SELECT rank, id, score FROM lexical")
def bm25_index_increments(spark, d):
    """An index that takes in the documents in turns, one of them twice, with texts that change later, and then loses some."""
    docs = table(spark, d, "documents")
    index = InvertedIndex(spark, fresh_folder(spark, "increments"))
    index.add(docs.where("doc_id % 3 = 0").withColumn("text", F.lit("what it was before")))
    for turn in (1, 0, 2, 2):
        index.add(docs.where(F.col("doc_id") % 3 == turn))
    index.remove(docs.where("doc_id % 11 = 0"))
    return index.top_one(OTHER, 30)


@query(f"WITH {bm25_sql('SELECT 0 AS qid, text AS query FROM benchmark', 1)} SELECT term, df, round(idf, 6) AS idf FROM df JOIN idf USING (term)")
def index_statistics(spark, d):
    t = index_of(spark, d).tables()
    raw = t["terms"].crossJoin(F.broadcast(t["size"])).withColumn("raw", _raw(F.col("n_docs"), F.col("df")))  # size is one row
    return raw.select("term", "df", F.round(F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")), 6).alias("idf"))


# --- collections ------------------------------------------------------------------


def paper_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Documents with vectors as chunks, five to a paper of each source; labels as overrides."""
    keyed = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("category"), F.concat(F.lit("p"), F.expr("doc_id div 5")).alias("paper_id"), "text")
    vectors = keyed.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id").select("chunk_id", *KEY, normalize("embedding").alias("embedding"))
    chunks = keyed.join(vectors.select("chunk_id"), "chunk_id", "left_semi")
    papers = chunks.select(*KEY).distinct().withColumn("doi", F.concat(F.lit("10.1000/"), "paper_id"))
    overrides = chunks.join(table(spark, d, "labels").select(F.col("doc_id").alias("chunk_id"), "quality"), "chunk_id").select(*KEY, F.concat(F.lit("quality"), "quality").alias("field")).distinct()
    return {"papers": papers, "chunks": chunks, "vectors": vectors, "overrides": overrides, "registry": shaped(papers.where("cast(substr(paper_id, 2) as bigint) % 2 = 0").select("doi").distinct())}


def collection_of(spark: SparkSession, d: str) -> tuple[Collection, dict[str, DataFrame]]:
    c, made = Collection(spark, fresh_folder(spark, "collection")), paper_tables(spark, d)
    c.create(**made)
    return c, made


def counts_of(c: Collection) -> DataFrame:
    """(name, category, paper_id, n): rows of each paper in each table that readers see."""
    t = c.store.tables()
    parts = [c.live(n, t).groupBy(*KEY).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), *KEY, "n") for n in ("papers", "chunks", "vectors", "overrides", "tombstones")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PAPER_TABLES_SQL = """
keyed AS (SELECT doc_id AS chunk_id, source AS category, 'p' || (doc_id // 5) AS paper_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
toxic AS (SELECT DISTINCT category, paper_id FROM keyed WHERE chunk_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
overrides AS (SELECT DISTINCT category, paper_id, quality FROM keyed JOIN labels ON chunk_id = doc_id)"""


@query(f"""WITH {PAPER_TABLES_SQL}, gone AS (SELECT * FROM toxic WHERE paper_id NOT LIKE '%3'), left_ AS (SELECT k.* FROM keyed k ANTI JOIN gone g ON k.category = g.category AND k.paper_id = g.paper_id)
SELECT 'papers' AS name, category, paper_id, 1 AS n FROM (SELECT DISTINCT category, paper_id FROM left_) UNION ALL SELECT 'chunks', category, paper_id, count(*) FROM left_ GROUP BY ALL
UNION ALL SELECT 'vectors', category, paper_id, count(*) FROM left_ GROUP BY ALL UNION ALL SELECT 'tombstones', category, paper_id, 1 FROM gone
UNION ALL SELECT 'overrides', o.category, o.paper_id, count(*) FROM overrides o ANTI JOIN gone g ON o.category = g.category AND o.paper_id = g.paper_id GROUP BY ALL""")
def delete_papers(spark, d):
    """Papers with a toxic chunk are deleted, some of them restored, and a deletion that breaks off half-way leaves no trace."""
    c, made = collection_of(spark, d)
    toxic = made["chunks"].join(table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi").select(*KEY)
    c.delete(toxic, "toxic", "2026-01-01")
    c.restore(toxic.where("paper_id like '%3'"), lambda new: made["vectors"].join(new.select("chunk_id"), "chunk_id", "left_semi"))
    try:
        with c.store.commit("broken") as broken:
            broken.replace("papers", made["papers"].where("paper_id like '%1'"))
            raise InterruptedError
    except InterruptedError:
        pass
    return counts_of(c)


@query(f"""WITH {PAPER_TABLES_SQL}, p AS (SELECT DISTINCT category, paper_id FROM keyed), first AS (SELECT min(category) AS category, paper_id FROM p WHERE paper_id LIKE '%7' GROUP BY paper_id),
named AS (SELECT k.category, CASE WHEN k.paper_id LIKE '%2' THEN 'new_' || k.paper_id ELSE k.paper_id END AS paper_id FROM keyed k ANTI JOIN first f ON k.category = f.category AND k.paper_id = f.paper_id),
own AS (SELECT o.category, CASE WHEN o.paper_id LIKE '%2' THEN 'new_' || o.paper_id ELSE o.paper_id END AS paper_id FROM overrides o ANTI JOIN first f ON o.category = f.category AND o.paper_id = f.paper_id)
SELECT 'papers' AS name, category, paper_id, 1 AS n FROM (SELECT DISTINCT * FROM named) UNION ALL SELECT 'chunks', category, paper_id, count(*) FROM named GROUP BY ALL UNION ALL SELECT 'vectors', category, paper_id, count(*) FROM named GROUP BY ALL
UNION ALL SELECT 'overrides', category, paper_id, count(*) FROM own GROUP BY ALL
UNION ALL SELECT 'blocked', '', '10.1000/' || paper_id, 1 FROM (SELECT DISTINCT paper_id FROM p WHERE paper_id LIKE '%7')""")
def collection_history(spark, d):
    """Papers renamed in all tables, one wrong commit rolled back, and papers purged by DOI, which the registry then blocks."""
    c, made = collection_of(spark, d)
    c.rename(made["papers"].where("paper_id like '%2'").select("category", F.col("paper_id").alias("old_id"), F.concat(F.lit("new_"), "paper_id").alias("new_id")))
    c.delete(made["papers"], "by mistake", "2026-01-01")
    c.store.rollback()
    c.purge(made["papers"].where("paper_id like '%7'").select("doi"), "2026-01-02")
    blocked = c.live("registry").where("status = 'blocked'").groupBy("doi").agg(F.count("*").alias("n"))
    return counts_of(c).unionByName(blocked.select(F.lit("blocked").alias("name"), F.lit("").alias("category"), F.col("doi").alias("paper_id"), "n"))


# --- batches ----------------------------------------------------------------------


@query(f"""WITH b AS (SELECT item_id AS qid, text, CASE WHEN item_id % 10 = 9 THEN 0 ELSE 10 END AS k, item_id % 3 AS f, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
bad AS (SELECT qid, CASE WHEN k < 1 THEN 'k below 1' WHEN embedding IS NULL THEN 'no vector' END AS error FROM b WHERE k < 1 OR embedding IS NULL),
{bm25_sql("SELECT qid, text AS query FROM b WHERE qid NOT IN (SELECT qid FROM bad)", 1_000_000_000)},
a AS (SELECT vec_id AS id, {UNIT_SQL.replace("v,", "embedding,")} AS u FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)),
q AS (SELECT qid, {UNIT_SQL.replace("v,", "embedding,")} AS u FROM b WHERE qid NOT IN (SELECT qid FROM bad)),
near AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM (SELECT qid, a.id, {DISTANCE_SQL} AS distance FROM a, q)),
fused AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT qid, id, rank FROM near UNION ALL SELECT qid, id, rank FROM lexical) JOIN b USING (qid) WHERE f > 0 OR rank <= 200 GROUP BY ALL)
SELECT qid::VARCHAR AS qid, id, score, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1)::INT AS rank, NULL::VARCHAR AS error FROM fused JOIN b USING (qid) JOIN documents ON doc_id = id
WHERE f = 0 OR (f = 1 AND lang IN ('de', 'fr') AND 1990 + doc_id % 40 >= 2000) OR (f = 2 AND lang = 'en') QUALIFY rank < 10
UNION ALL SELECT qid::VARCHAR, NULL, NULL, NULL, error FROM bad""")
def batch_hybrid(spark, d):
    """Every text of ``benchmark`` as a hybrid question with a filter of its own; some ask for nothing and get their error."""
    f, null = F.col("item_id") % 3, F.lit(None)
    asked = table(spark, d, "benchmark").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding"), "item_id", "left")
    sections = F.when(f == 1, F.array(F.lit("de"), F.lit("fr"))).when(f == 2, F.array(F.lit("en")))
    kinds = {"type": "string", "part": "string", "papers": "array<string>", "year_end": "int", "doc_type": "string"}
    questions = asked.select(F.col("item_id").cast("string").alias("qid"), "text", F.col("embedding").cast("array<double>").alias("vector"), F.when(F.col("item_id") % 10 == 9, 0).otherwise(10).alias("k"), F.lit(True).alias("hybrid"), sections.alias("sections"), F.when(f == 1, 2000).alias("year_start"), F.lit(False).alias("scaled"), *(null.cast(t).alias(c) for c, t in kinds.items()))
    return retrieval.search_batch(chunk_collection(spark, d), questions).select("qid", "id", "score", "rank", "error")


# --- micro-batches ----------------------------------------------------------------

LIMIT = 3000


class Counter:
    """An embedder for tests: how many characters it was given, and how many of them are an e. Long texts are too long."""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if any(len(t) > LIMIT for t in texts):
            raise ValueError("too long")
        return [[float(len(t)), float(t.count("e"))] for t in texts]


def in_turns(rows: DataFrame, write, store: Store, name: str, turns: int, seq: str) -> None:
    """``rows`` as so many micro-batches by ``seq``, the last two of them handed over again, as after a failure."""
    run = once(store, name, write)
    for i in [*range(turns), *range(max(0, turns - 2), turns)]:
        run(rows.where(F.pmod(F.col(seq), F.lit(turns)) == i), i)


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
u AS (SELECT *, list_reduce(range(12), lambda c, i: CASE WHEN c > {LIMIT} THEN greatest(400, c * 2 // 3) ELSE c END, least(n, 8000)) AS used FROM t)
SELECT doc_id, used::DOUBLE AS used, (used - length(replace(substr(text, 1, used), 'e', '')))::DOUBLE AS n_e, n > used AS embed_truncated FROM u""")
def embedded_once(spark, d):
    """Vectors of all documents from four micro-batches, of which some are handed over twice and one breaks off in the middle."""
    store, docs = Store(spark, fresh_folder(spark, "embedded")), table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    write = embedded(store, "vectors", Counter)

    def broken(c, rows):
        write(c, rows)
        raise InterruptedError

    try:
        once(store, "documents", broken)(docs.where("chunk_id % 4 = 0"), 0)
    except InterruptedError:
        pass
    in_turns(docs, write, store, "documents", 4, "chunk_id")
    in_turns(docs, write, store, "the same again", 2, "chunk_id")
    v = store.read("vectors")
    return v.select(F.col("chunk_id").alias("doc_id"), F.get("embedding", F.lit(0)).cast("double").alias("used"), F.get("embedding", F.lit(1)).cast("double").alias("n_e"), "embed_truncated")


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def monthly_log(spark, d):
    """Events logged by month from five micro-batches, some of them handed over twice."""
    store = Store(spark, fresh_folder(spark, "log"))
    in_turns(table(spark, d, "events"), logged("usage"), store, "events", 5, "event_id")
    return store.read("usage").groupBy("month", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query(ORACLES["registry_upsert"])
def registry_by_increments(spark, d):
    """The registry after three micro-batches, in the order of their rows, of which the last two come twice."""
    old, rows = registry_parts(spark, d)
    store = Store(spark, fresh_folder(spark, "registry"))
    with store.commit("before") as c:
        c.replace("registry", old)
    given = rows.select("seq", "doi", "title", "year", "category", F.lit("").alias("reason"))
    low, high = given.agg(F.min("seq"), F.max("seq")).first()
    turn = F.least(F.lit(2), F.floor((F.col("seq") - low) * 3 / max(1, high - low))).cast("int")
    in_turns(given.withColumn("turn", turn), registered(store, "registry", "2026-01-01"), store, "papers", 3, "turn")
    return store.read("registry")
