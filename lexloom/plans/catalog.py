"""The registered queries: each an operator over whole tables, beside the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import ids, text
from lexloom.functions.vectors import norm
from lexloom.operators import chunking, citations, dedup, dense, evaluation, exports, fusion, lexical, lifecycle, metadata, pages, registry, rollups, validation
from lexloom.operators.ranking import checkpointed
from lexloom.plans import retrieval
from lexloom.plans.tables import PAPERS_SQL, papers, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


SEGMENTS = "regexp_extract_all(p, '[a-zα-ω]+|[0-9]+')"


def tokens_sql(x: str) -> str:
    raw = f"regexp_extract_all(strip_accents(lower(coalesce({x}, ''))), '[a-z0-9α-ω]+(?:-[a-z0-9α-ω]+)*')"
    segments = f"flatten(list_transform(string_split(r, '-'), lambda p: CASE WHEN len({SEGMENTS}) > 1 THEN {SEGMENTS} ELSE []::VARCHAR[] END))"
    return f"flatten(list_transform({raw}, lambda r: list_concat([r], CASE WHEN contains(r, '-') THEN string_split(r, '-') ELSE []::VARCHAR[] END, {segments})))"


# --- lexical -----------------------------------------------------------------


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY term")
def tokenize_terms(spark, d):
    return table(spark, d, "documents").select(F.explode(text.tokens("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def bm25_sql(queries: str, k: int) -> str:
    """Ranked BM25 of a query table (qid, query)."""
    return f"""
toks AS (SELECT doc_id AS id, {tokens_sql("text")} AS toks FROM documents),
size AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM toks),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT id, unnest(toks) AS term FROM toks) GROUP BY term),
raw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, size),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tokens_sql("query")}) AS term FROM ({queries})) GROUP BY ALL),
tf AS (SELECT id, len(toks) AS dl, unnest(toks) AS term FROM toks),
postings AS (SELECT id, dl, term, count(*) AS tf FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
scored AS (SELECT qid, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM postings JOIN idf USING (term) JOIN asked USING (term), size GROUP BY ALL HAVING sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) > 0),
lexical AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= {k})"""


QUESTION = "the eine inst eau"


@query(f"WITH {bm25_sql(f'SELECT 0 AS qid, {QUESTION!r} AS query', 50)} SELECT rank, id, score FROM lexical")
def bm25_topk(spark, d):
    scored = lexical.bm25_query(table(spark, d, "documents"), QUESTION).withColumn("score", F.round("score", 6))
    return fusion.ranked(scored, [F.desc("score"), F.col("id")], 50).select((F.col("rank") + 1).alias("rank"), "id", "score")


@query(f"WITH {bm25_sql('SELECT item_id AS qid, text AS query FROM benchmark', 10)} SELECT qid, id, score, rank FROM lexical")
def bm25_multi_query(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return lexical.top_by_query(lexical.bm25_scores(table(spark, d, "documents"), asked), 10).select("qid", "id", "score", "rank")


SPANISH_SQL = f"""len(list_intersect(list_distinct({tokens_sql("text")}), {text.SPANISH_WORDS})) + regexp_matches(lower(coalesce(text, '')), '{text.SPANISH_LETTERS}')::INT"""


@query(f"""SELECT kind, id, hits, hits >= 2 AS spanish FROM (SELECT 'document' AS kind, doc_id AS id, {SPANISH_SQL} AS hits FROM documents
UNION ALL SELECT 'turn', conv_id * 1000 + turn, {SPANISH_SQL} FROM conversations)""")
def language_hint(spark, d):
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    turns = table(spark, d, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return docs.unionByName(turns).select("kind", "id", text.spanish_hits("text").alias("hits"), text.looks_spanish("text").alias("spanish"))


# --- dense and fused -----------------------------------------------------------

UNIT_SQL = "list_transform(v, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(v, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12))"
DISTANCE_SQL = "round(list_sum(list_transform(list_zip(a.u, q.u), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)"


def query_vector(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings").orderBy("vec_id").first().embedding)


@query(f"""WITH a AS (SELECT vec_id AS id, {UNIT_SQL.replace("v,", "embedding,")} AS u FROM embeddings), q AS (SELECT u FROM a ORDER BY id LIMIT 1)
SELECT id, {DISTANCE_SQL} AS distance FROM a, q ORDER BY distance, id LIMIT 20""")
def dense_knn(spark, d):
    return dense.nearest(table(spark, d, "embeddings"), query_vector(spark, d), 20, scaled=False)


@query(f"""WITH s AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 7 + 1)) AS v FROM embeddings),
a AS (SELECT id, {UNIT_SQL} AS u FROM s), q AS (SELECT u FROM a ORDER BY id LIMIT 1)
SELECT id, {DISTANCE_SQL} AS distance FROM a, q ORDER BY distance, id LIMIT 20""")
def dense_knn_scaled(spark, d):
    longer = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 7 + 1))
    return dense.nearest(table(spark, d, "embeddings").withColumn("embedding", longer), query_vector(spark, d), 20, scaled=False)


@query("SELECT count(*) AS n_vectors, (SELECT count(*) FROM documents) AS n_rows, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 5) AS mean_norm, CASE WHEN count(*) <> (SELECT count(*) FROM documents) THEN 'count' ELSE '' END AS problems FROM embeddings")
def index_integrity(spark, d):
    return dense.integrity(table(spark, d, "embeddings"), table(spark, d, "documents"), True).select("n_vectors", "n_rows", F.round("mean_norm", 5).alias("mean_norm"), "problems")


HYBRID_SQL = f"""{bm25_sql(f'SELECT 0 AS qid, {QUESTION!r} AS query', 200)},
a AS (SELECT vec_id AS id, {UNIT_SQL.replace("v,", "embedding,")} AS u FROM embeddings), q AS (SELECT u FROM a ORDER BY id LIMIT 1),
dist AS (SELECT id, {DISTANCE_SQL} AS distance FROM a, q WHERE id IN (SELECT doc_id FROM documents)),
nearest AS (SELECT id, row_number() OVER (ORDER BY distance, id) AS rank FROM dist QUALIFY rank <= POOL),
fused AS (SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT id, rank FROM nearest UNION ALL SELECT id, rank FROM lexical) GROUP BY id)"""


def chunk_collection(spark, d) -> DataFrame:
    """Documents as chunks, with the vectors that share their numbers."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.concat(F.lit("doc_"), F.col("doc_id")).alias("paper_id"), F.col("lang").alias("section_canonical"), F.lit("text").alias("type"), F.lit("article").alias("doc_type"), (F.lit(1990) + F.col("doc_id") % 40).cast("int").alias("year"))
    return docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


@query(f"WITH {HYBRID_SQL.replace('POOL', '200')} SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM fused QUALIFY rank < 20")
def hybrid_rrf(spark, d):
    spec = retrieval.SearchSpec(QUESTION, query_vector(spark, d), 20, hybrid=True, scaled=False)
    return retrieval.search(chunk_collection(spark, d), spec).select("id", "score", "rank")


@query(
    f"""WITH {HYBRID_SQL.replace("POOL", "1000000000").replace("rank <= 200", "rank <= 1000000000")}
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM fused JOIN documents ON doc_id = id
WHERE lang IN ('de', 'fr') AND 1990 + doc_id % 40 >= 2000 QUALIFY rank < 20"""
)
def hybrid_rrf_filtered(spark, d):
    only = fusion.ChunkFilter(sections=["de", "fr"], year_start=2000)
    spec = retrieval.SearchSpec(QUESTION, query_vector(spark, d), 20, hybrid=True, only=only, scaled=False)
    return retrieval.search(chunk_collection(spark, d), spec).select("id", "score", "rank")


@query(
    f"""WITH e AS (SELECT vec_id AS id, {UNIT_SQL.replace("v,", "embedding,")} AS u FROM embeddings), a AS (SELECT * FROM e WHERE id IN (SELECT doc_id FROM documents)),
q AS ((SELECT 'any' AS qid, 20 AS k, u FROM e ORDER BY id LIMIT 1) UNION ALL (SELECT 'some', 12, u FROM e ORDER BY id DESC LIMIT 1)),
dist AS (SELECT qid, k, a.id, {DISTANCE_SQL} AS score FROM a, q)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score, id) - 1 AS rank FROM dist JOIN documents ON doc_id = id
WHERE qid = 'any' OR (lang IN ('de', 'fr') AND 1990 + doc_id % 40 >= 2000) QUALIFY rank < k"""
)
def batch_questions(spark, d):
    last = list(table(spark, d, "embeddings").orderBy(F.desc("vec_id")).first().embedding)
    only = fusion.ChunkFilter(sections=["de", "fr"], year_start=2000)
    specs = {"any": retrieval.SearchSpec("", query_vector(spark, d), 20, scaled=False), "some": retrieval.SearchSpec("", last, 12, only=only, scaled=False)}
    return retrieval.search_many(chunk_collection(spark, d), specs).select("qid", "id", "score", "rank")


ATTACHED_SQL = f"""a AS (SELECT vec_id AS id, {UNIT_SQL.replace("v,", "embedding,")} AS u FROM embeddings), q AS (SELECT u FROM a ORDER BY id LIMIT 1),
dist AS (SELECT id, {DISTANCE_SQL} AS distance FROM a, q),
att AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS n FROM dist WHERE id % 10 = 9),
corpus AS (SELECT *, row_number() OVER (ORDER BY distance, id) AS n FROM dist WHERE id % 10 <> 9)"""


def attachment_parts(spark, d) -> tuple[DataFrame, DataFrame]:
    every = dense.distances(table(spark, d, "embeddings"), query_vector(spark, d), scaled=False)
    return every.where("id % 10 <> 9"), every.where("id % 10 = 9")


@query(f"""WITH {ATTACHED_SQL}, pool AS (SELECT 'attachment' AS source, id, distance, CASE WHEN n <= 3 THEN 0 ELSE 1 END AS turn FROM att UNION ALL SELECT 'corpus', id, distance, 2 FROM corpus),
chosen AS (SELECT *, row_number() OVER (ORDER BY (turn > 0), distance, turn, id) AS m FROM pool QUALIFY m <= 10)
SELECT source, id, distance, row_number() OVER (ORDER BY distance, turn, id) AS position FROM chosen""")
def attachment_fusion_dense(spark, d):
    corpus, attached = attachment_parts(spark, d)
    return fusion.fuse_dense(corpus, attached, 10, 3)


@query(f"""WITH {ATTACHED_SQL}, pool AS (SELECT 'attachment' AS source, id, distance AS score, 0 AS turn, distance AS by_ FROM att WHERE n <= 3
UNION ALL SELECT 'corpus', id, round(1.0 / (60 + n), 9), 1, -round(1.0 / (60 + n), 9) FROM corpus)
SELECT source, id, score, row_number() OVER (ORDER BY turn, by_, id) AS position FROM pool QUALIFY position <= 10""")
def attachment_fusion_hybrid(spark, d):
    corpus, attached = attachment_parts(spark, d)
    fused = fusion.rrf([fusion.ranked(corpus, [F.col("distance"), F.col("id")], 200)]).withColumn("score", F.round("score", 9))
    return fusion.fuse_hybrid(fused, attached, 10, 3)


@query(f"""WITH a AS (SELECT vec_id AS id, label, {UNIT_SQL.replace("v,", "embedding,")} AS u FROM embeddings), q AS (SELECT u FROM a ORDER BY id LIMIT 1),
dist AS (SELECT id, label, {DISTANCE_SQL} AS distance FROM a, q), best AS (SELECT * FROM dist QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, id) <= 3)
SELECT id, label, distance FROM best ORDER BY distance, id LIMIT 12""")
def multi_index_quota(spark, d):
    vectors = table(spark, d, "embeddings")
    scored = dense.distances(vectors, query_vector(spark, d), scaled=False).join(vectors.select(F.col("vec_id").alias("id"), "label"), "id")
    return fusion.quota_by_group(scored, "label", 3, 12).select("id", "label", "distance")


SELF_SQL = f"""a AS (SELECT vec_id AS id, label, {UNIT_SQL.replace("v,", "embedding,")} AS u FROM embeddings),
pairs AS (SELECT q.id AS qid, q.label AS qlabel, a.id, a.label, {DISTANCE_SQL} AS distance FROM a, a q WHERE q.id % 50 = 0 AND a.id <> q.id),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM pairs QUALIFY rank <= 8)"""


def self_neighbours(spark, d, k: int) -> DataFrame:
    """The nearest of every vector whose number divides by 50, among all others."""
    vectors = table(spark, d, "embeddings")
    return dense.nearest_many(vectors, vectors.where("vec_id % 50 = 0"), k, drop_self=True)


@query(f"WITH {SELF_SQL} SELECT qid, id, distance, rank FROM top")
def knn_queries(spark, d):
    return self_neighbours(spark, d, 8)


@query(
    f"""WITH {SELF_SQL}, first AS (SELECT qid, min(rank) FILTER (label = qlabel) AS pos FROM top GROUP BY qid)
SELECT count(*) AS n, round(avg((pos IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0 / pos, 0)), 6) AS mrr FROM first"""
)
def eval_hit_mrr(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "label")
    found = self_neighbours(spark, d, 8).select("qid", F.col("id").alias("item"), F.col("rank").alias("position"))
    asked = vectors.where("item % 50 = 0").select(F.col("item").alias("qid"), F.col("label").alias("asked_label"))
    relevant = found.join(vectors, "item").join(asked, "qid").where("label = asked_label").select("qid", "item")
    return evaluation.hit_rate_and_mrr(evaluation.judge(found, relevant, 8, asked))


@query(
    f"""WITH {SELF_SQL}, dense AS (SELECT qid, label AS item, min(rank) AS first FROM top GROUP BY ALL),
d AS (SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY first, item) AS dense FROM dense),
halves AS (SELECT vec_id AS id, label, {UNIT_SQL.replace("v,", "embedding[1:32],")} AS u FROM embeddings),
half_pairs AS (SELECT q.id AS qid, a.id, a.label, {DISTANCE_SQL} AS distance FROM halves a, halves q WHERE q.id % 50 = 0 AND a.id <> q.id),
half_items AS (SELECT qid, label AS item, min(rank) AS first FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM half_pairs QUALIFY rank <= 8) GROUP BY ALL),
e AS (SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY first, item) AS half FROM half_items)
SELECT qid, item, coalesce(dense, 0) AS dense, coalesce(half, 0) AS half, least(coalesce(dense, 1073741824), coalesce(half, 1073741824)) AS best FROM d FULL JOIN e USING (qid, item)"""
)
def pool_candidates(spark, d):
    vectors = table(spark, d, "embeddings")
    labels = vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("item"))
    half = vectors.withColumn("embedding", F.slice("embedding", 1, 32))
    arms = [dense.nearest_many(v, v.where("vec_id % 50 = 0"), 8, drop_self=True) for v in (vectors, half)]
    groups = [fusion.first_by_group(r.join(labels, "id"), "item", 8) for r in arms]
    return evaluation.pool(dense=groups[0], half=groups[1]).fillna(0, ["dense", "half"])


# --- chunks, pages, links --------------------------------------------------------

WORDS_SQL = "list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')"
WINDOWS_SQL = f"""w AS (SELECT doc_id, text, {WORDS_SQL} AS w FROM documents),
chunks AS (SELECT doc_id, 1 AS chunk_index, len(w) AS n_words, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS chunk FROM w WHERE len(w) BETWEEN 1 AND 1020
UNION ALL SELECT doc_id, i // 730 + 1, len(list_slice(w, i + 1, i + 850)), array_to_string(list_slice(w, i + 1, i + 850), ' ') FROM (SELECT doc_id, w, unnest(range(0, len(w), 730)) AS i FROM w WHERE len(w) > 1020))"""


@query(f"WITH {WINDOWS_SQL} SELECT doc_id, chunk_index, n_words, md5(chunk) AS chunk_md5 FROM chunks")
def chunk_documents(spark, d):
    return chunking.chunk_windows(table(spark, d, "documents")).select("doc_id", "chunk_index", "n_words", F.md5("chunk").alias("chunk_md5"))


@query(f"WITH {WINDOWS_SQL} SELECT count(*) AS n, sum(n_words) AS n_words, max(length(chunk)) AS longest, count(*) FILTER (length(chunk) > 8000) AS too_long, round(avg(length(chunk)), 6) AS mean_chars FROM chunks")
def chunk_stats(spark, d):
    c = chunking.chunk_windows(table(spark, d, "documents"))
    return c.agg(F.count("*").alias("n"), F.sum("n_words").alias("n_words"), F.max(F.length("chunk")).alias("longest"), F.count_if(F.length("chunk") > 8000).alias("too_long"), F.round(F.avg(F.length("chunk")), 6).alias("mean_chars"))


def pieces_sql(x: str, most: int) -> str:
    """Pieces of texts (doc_id, ``x``): a fold over units as rows of one type, the open piece as text and what is done beside it."""
    strip = lambda v: f"regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"
    unit = lambda sep, text, fresh="false": f"{{'done': []::VARCHAR[], 'sep': '{sep}', 'text': {text}, 'fresh': {fresh}}}"
    word = f"CASE WHEN length(w) <= {most} THEN [{unit(' ', 'w')}] ELSE list_transform(range(1, length(w) + 1, {most}), lambda i: {unit('', f'substr(w, i, {most})', 'true')}) END"
    line = f"CASE WHEN length(l) <= {most} THEN [{unit(chr(10), 'l')}] ELSE flatten(list_transform(list_filter(regexp_split_to_array(l, '\\s+'), lambda w: w <> ''), lambda w: {word})) END"
    lines = f"flatten(list_transform(list_filter(string_split(p, chr(10)), lambda l: {strip('l')} <> ''), lambda l: {line}))"
    first = f"list_transform({lines}, lambda u, i: {{'done': u.done, 'sep': u.sep, 'text': u.text, 'fresh': u.fresh OR i = 1}})"
    paragraph = f"CASE WHEN length(p) <= {most} THEN [{unit(chr(10) * 2, 'p')}] ELSE {first} END"
    units = f"flatten(list_transform(list_filter(list_transform(string_split(t, chr(10) || chr(10)), lambda p: {strip('p')}), lambda p: p <> ''), lambda p: {paragraph}))"
    step = f"""CASE WHEN u.fresh OR length(a.text) + length(u.sep) + length(u.text) > {most} THEN {{'done': list_append(a.done, a.text), 'sep': '', 'text': u.text, 'fresh': false}}
ELSE {{'done': a.done, 'sep': '', 'text': a.text || u.sep || u.text, 'fresh': false}} END"""
    return f"""cut AS (SELECT doc_id, CASE WHEN length(t) <= {most} THEN [t] ELSE list_append(f.done, f.text) END AS pieces FROM
  (SELECT doc_id, t, CASE WHEN length(t) > {most} THEN list_reduce({units}, lambda a, u: {step}) END AS f FROM (SELECT doc_id, {strip(f"coalesce({x}, '')")} AS t FROM documents)) WHERE t <> ''),
pieces AS (SELECT doc_id, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1))::INT AS piece_index FROM cut)"""


PIECE_SQL = "SELECT doc_id, piece_index, length(piece)::INT AS chars, md5(piece) AS piece_md5 FROM pieces"


@query(f"WITH {pieces_sql('text', 8000)} {PIECE_SQL}")
def split_max_chars(spark, d):
    return chunking.split_long(table(spark, d, "documents")).select("doc_id", "piece_index", F.length("piece").alias("chars"), F.md5("piece").alias("piece_md5"))


LAID_OUT = "CASE doc_id % 4 WHEN 0 THEN replace(text, ' ', '') WHEN 1 THEN replace(text, '. ', chr(10)) WHEN 2 THEN replace(text, '. ', chr(10) || chr(10)) ELSE text || chr(10) || chr(10) || replace(text, ' ', '') || ' and ' || text END"


@query(f"WITH {pieces_sql(LAID_OUT, 300)} {PIECE_SQL}")
def split_at_every_level(spark, d):
    """Whole texts laid out as paragraphs, as lines, as one long word, and as all of them, in pieces of 300 characters."""
    laid_out = table(spark, d, "documents").withColumn("text", F.expr(LAID_OUT))
    return chunking.split_long(laid_out, most=300).select("doc_id", "piece_index", F.length("piece").alias("chars"), F.md5("piece").alias("piece_md5"))


@query(f"WITH {WINDOWS_SQL} SELECT doc_id, chunk_index, md5(chunk) AS chunk_md5 FROM chunks")
def packed_chunks(spark, d):
    return chunking.chunk_texts(table(spark, d, "documents")).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


SECTION_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(title, '')), '{w}')" for w in ws) + f" THEN '{name}'" for name, ws in text.SECTIONS.items()) + " ELSE 'other' END"


@query(f"""WITH t AS (SELECT p_name || ' ' || CASE p_size % 7 WHEN 0 THEN 'Materials and Methods' WHEN 1 THEN 'Removal efficiency' WHEN 2 THEN 'Abstract' WHEN 3 THEN 'General Discussion'
WHEN 4 THEN 'Future perspectives' WHEN 5 THEN 'Background' ELSE 'Appendix' END AS title FROM part) SELECT {SECTION_SQL} AS section, count(*) AS n FROM t GROUP BY ALL""")
def canonical_section_counts(spark, d):
    title = F.expr("concat(p_name, ' ', CASE p_size % 7 WHEN 0 THEN 'Materials and Methods' WHEN 1 THEN 'Removal efficiency' WHEN 2 THEN 'Abstract' WHEN 3 THEN 'General Discussion' WHEN 4 THEN 'Future perspectives' WHEN 5 THEN 'Background' ELSE 'Appendix' END)")
    return table(spark, d, "part").select(text.section(title).alias("section")).groupBy("section").agg(F.count("*").alias("n"))


LINE_KEY = "trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '', 'g'), '\\s+', ' ', 'g'))"


@query(
    f"""WITH l AS (SELECT source, doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
e AS (SELECT source, unnest(list_distinct(list_transform(list_concat(list_slice(l, 1, 2), list_slice(l, greatest(1, len(l) - 1), len(l))), lambda x: {LINE_KEY}))) AS line FROM l),
n AS (SELECT source, count(*) AS total FROM documents GROUP BY source)
SELECT source, line, count(*) AS n_pages FROM e JOIN n USING (source) WHERE length(line) BETWEEN 3 AND 80 GROUP BY source, line, total HAVING count(*) >= greatest(4, total // 100)"""
)
def running_lines(spark, d):
    return pages.running_lines(table(spark, d, "documents"), "source")


VISIBLE_SQL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, length({VISIBLE_SQL}) AS chars, md5({VISIBLE_SQL}) AS text_md5 FROM pages")
def clean_pages_text(spark, d):
    shown = table(spark, d, "pages").select("page_id", pages.visible_text("html").alias("t"))
    return shown.select("page_id", F.length("t").alias("chars"), F.md5("t").alias("text_md5"))


@query(
    """WITH a AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<a\\s[^>]*?href\\s*=\\s*["''][^"'']*["''][^>]*>.*?</a>')) AS a FROM pages),
l AS (SELECT page_id, lower(trim(regexp_extract(a, '(?is)href\\s*=\\s*["'']([^"'']*)["'']', 1))) || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '/pdfft' ELSE '' END AS h, lower(trim(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS t FROM a),
s AS (SELECT page_id, CASE WHEN regexp_matches(h, '/pdf|\\.pdf($|\\?)|/pdfdirect|/articlepdf|/content/pdf/|/fullpdf|/download/pdf|/pdfft|isDTMRedir') THEN 10 ELSE 0 END + CASE WHEN contains(h, 'pdfft') OR contains(h, 'istdmredir') THEN 8 ELSE 0 END
 + CASE WHEN contains(t, 'pdf') THEN 5 ELSE 0 END + CASE WHEN contains(t, 'download') THEN 2 ELSE 0 END + CASE WHEN contains(t, 'full text pdf') THEN 4 ELSE 0 END - CASE WHEN starts_with(h, 'javascript:') THEN 5 ELSE 0 END AS score FROM l)
SELECT page_id, score, count(*) AS n FROM s GROUP BY ALL"""
)
def pdf_link_score(spark, d):
    ending = F.when(F.col("page_id") % 3 == 0, ".pdf").when(F.col("page_id") % 3 == 1, "/pdfft").otherwise("")
    found = pages.links(table(spark, d, "pages")).withColumn("href", F.concat("href", ending))
    return found.select("page_id", pages.link_score("href", "text").alias("score")).groupBy("page_id", "score").agg(F.count("*").alias("n"))


KEYWORDS = {"river": ["eau", "sch"], "stone": ["tion", "keit"], "wind": ["ciónllm", "ärz"], "none": ["zzzz"]}


@query(
    """WITH k AS (SELECT * FROM (VALUES ('river', 'eau'), ('river', 'sch'), ('stone', 'tion'), ('stone', 'keit'), ('wind', 'ciónllm'), ('wind', 'ärz'), ('none', 'zzzz')) t(category, word)),
hits AS (SELECT doc_id, category FROM documents, k WHERE contains(lower(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), word) GROUP BY ALL),
one AS (SELECT doc_id, min(category) AS category FROM hits GROUP BY doc_id HAVING count(*) = 1)
SELECT doc_id, category, CASE WHEN category IS NULL THEN 0.0 ELSE 1.0 END AS confidence FROM documents LEFT JOIN one USING (doc_id)"""
)
def keyword_classify(spark, d):
    rows = [(c, w) for c, ws in KEYWORDS.items() for w in ws]
    return metadata.keyword_category(table(spark, d, "documents"), spark.createDataFrame(rows, "category string, keyword string"), "doc_id", F.col("text"))


# --- identifiers and duplicates --------------------------------------------------

CORPUS_DOI = "regexp_replace(regexp_replace(lower(trim(coalesce(doi, ''))), '^https?://(dx\\.)?doi\\.org/', ''), '/+$', '')"
TEXT_DOI = "regexp_extract(regexp_replace(regexp_replace(trim(coalesce(doi, '')), '(?i)https?://(dx\\.)?doi\\.org/', '', 'g'), '(?i)\\bdoi\\s*:\\s*', '', 'g'), '(?i)\\b(10\\.\\d{4,9}/[-._;(),<>/:A-Z0-9]+)\\b', 1)"
TAIL_DOI = f"regexp_replace(regexp_replace(regexp_replace({TEXT_DOI}, '[).,;\\]}}>]+$', ''), '(-[a-zA-Z])[a-zA-Z]{{2,}}$', '\\1'), '([0-9])[a-zA-Z]{{3,}}$', '\\1')"


@query(
    f"""WITH {PAPERS_SQL} SELECT seq, lower(trim(coalesce(doi, ''))) AS registry, {CORPUS_DOI} AS corpus,
regexp_replace(regexp_replace(trim(coalesce(doi, '')), '(?i)^https?://(dx\\.)?doi\\.org/', ''), '/+$', '') AS plain,
CASE WHEN regexp_matches(regexp_replace(trim(coalesce(doi, '')), 'https?://(dx\\.)?doi\\.org/', '', 'g'), '(?i)^10\\.\\d{{4,9}}/\\S+') THEN regexp_replace(trim(coalesce(doi, '')), 'https?://(dx\\.)?doi\\.org/', '', 'g') ELSE '' END AS screen,
nullif({TAIL_DOI}, '') AS text, lower({TAIL_DOI}) AS loose FROM papers"""
)
def doi_normalise_modes(spark, d):
    return papers(spark, d).select("seq", *(ids.doi("doi", m).alias(m) for m in ("registry", "corpus", "plain", "screen", "text", "loose")))


LOOSE = "loose AS (SELECT * REPLACE (lower(" + TAIL_DOI + ") AS doi) FROM papers)"


def loose_papers(spark, d) -> DataFrame:
    """Papers with their normalised DOI, which later steps use many times: computed once."""
    return checkpointed(papers(spark, d).withColumn("doi", ids.doi("doi", "loose")))


@query(f"""WITH {PAPERS_SQL}, {LOOSE} SELECT seq, doi, cited_by FROM loose WHERE doi = '' UNION ALL
SELECT seq, doi, cited_by FROM loose WHERE doi <> '' QUALIFY row_number() OVER (PARTITION BY doi ORDER BY coalesce(try_cast(cited_by AS BIGINT), 0) DESC, seq) = 1""")
def dedup_doi_most_cited(spark, d):
    return dedup.most_cited(loose_papers(spark, d)).select("seq", "doi", "cited_by")


@query(f"WITH {PAPERS_SQL} SELECT seq, doi FROM papers WHERE {CORPUS_DOI} <> '' QUALIFY row_number() OVER (PARTITION BY {CORPUS_DOI} ORDER BY seq) = 1")
def dedup_doi_first(spark, d):
    return dedup.first_doi(papers(spark, d)).select("seq", "doi")


@query(f"""WITH {PAPERS_SQL}, n AS (SELECT {CORPUS_DOI} AS d, count(*) AS n FROM papers GROUP BY ALL)
SELECT coalesce(sum(n) FILTER (d = ''), 0)::BIGINT AS n_no_doi, coalesce(sum(n - 1) FILTER (d <> ''), 0)::BIGINT AS n_duplicates FROM n""")
def doi_report(spark, d):
    return dedup.doi_report(papers(spark, d))


FULLNESS_SQL = "(" + " + ".join(f"(coalesce(trim({c}::VARCHAR), '') <> '')::INT" for c in ("title", "journal", "year", "abstract", "n_references")) + ")"
DECIDE_SQL = f"""r AS (SELECT doi, category, paper_id AS stem, seq AS line_no, {FULLNESS_SQL} AS completeness,
  CASE category WHEN 'BUILDING' THEN contains(lower(title || ' ' || coalesce(abstract, '')), 'steel')::INT WHEN 'MACHINERY' THEN contains(lower(title || ' ' || coalesce(abstract, '')), 'small')::INT ELSE 0 END AS relevance FROM loose WHERE doi <> ''),
i AS (SELECT *, row_number() OVER w AS n, first(stem) OVER w AS keep_stem FROM r WINDOW w AS (PARTITION BY doi, category ORDER BY NOT (stem = lower(stem) AND NOT regexp_matches(stem, '_10_\\d{{4,5}}_')), completeness DESC, lower(stem), line_no))"""


def dedup_records(spark, d) -> DataFrame:
    known = loose_papers(spark, d)
    shown = F.concat_ws(" ", "title", F.coalesce("abstract", F.lit("")))
    relevance = dedup.keyword_relevance(shown, {"BUILDING": ["steel"], "MACHINERY": ["small"]})
    return known.select("doi", "category", F.col("paper_id").alias("stem"), F.col("seq").alias("line_no"), dedup.completeness(["title", "journal", "year", "abstract", "n_references"]).alias("completeness"), relevance.alias("relevance"))


@query(f"WITH {PAPERS_SQL}, {LOOSE}, {DECIDE_SQL} SELECT doi, category, keep_stem, stem AS remove_stem, line_no AS remove_line FROM i WHERE n > 1")
def dedup_keep_intra(spark, d):
    return dedup.decide(dedup_records(spark, d)).select("doi", F.col("keep_category").alias("category"), "keep_stem", "remove_stem", "remove_line")


@query(
    f"""WITH {PAPERS_SQL}, {LOOSE}, {DECIDE_SQL}, b AS (SELECT *, max(relevance) OVER (PARTITION BY doi) AS most FROM i WHERE n = 1),
c AS (SELECT *, count(*) FILTER (relevance = most) OVER (PARTITION BY doi) AS at_most FROM b),
x AS (SELECT *, row_number() OVER w AS m, first(category) OVER w AS keep_category, first(stem) OVER w AS keep FROM c
 WINDOW w AS (PARTITION BY doi ORDER BY NOT (most > 0 AND at_most = 1 AND relevance = most), NOT (stem = lower(stem) AND NOT regexp_matches(stem, '_10_\\d{{4,5}}_')), lower(category), completeness DESC, lower(stem), line_no))
SELECT doi, 'intra' AS duplicate_type, category AS keep_category, keep_stem, category AS remove_category, stem AS remove_stem, line_no AS remove_line FROM i WHERE n > 1
UNION ALL SELECT doi, 'cross', keep_category, keep, category, stem, line_no FROM x WHERE m > 1"""
)
def dedup_keep_cross(spark, d):
    return dedup.decide(dedup_records(spark, d), across=True)


TITLE_KEY = "trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH {PAPERS_SQL} SELECT category, {TITLE_KEY} AS norm_title, count(*) AS n FROM papers WHERE length({TITLE_KEY}) >= 10 GROUP BY ALL
HAVING count(*) >= 2 AND count(DISTINCT nullif({CORPUS_DOI}, '')) < 2""")
def dup_groups_title(spark, d):
    return dedup.title_groups(papers(spark, d))


@query("SELECT lang AS category, sha256(text) AS sha256, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) >= 2")
def dup_groups_hash(spark, d):
    return dedup.content_groups(table(spark, d, "documents"), "text", "lang").withColumnRenamed("lang", "category")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id::VARCHAR) > 1")
def dup_losers_hash(spark, d):
    return dedup.content_losers(table(spark, d, "documents"), "doc_id", "text", "lang").select("doc_id")


@query(
    f"""WITH {PAPERS_SQL}, {LOOSE}, t AS (SELECT doi, sha256(title) AS sha, paper_id AS name, source_type FROM loose),
b AS (SELECT * FROM t WHERE source_type IS NOT NULL), c AS (SELECT * FROM t WHERE source_type IS NULL),
s AS (SELECT b.*, doi <> '' AND doi IN (SELECT doi FROM c) AS by_doi, sha IN (SELECT sha FROM c) AS by_hash FROM b)
SELECT name, CASE WHEN by_doi THEN 'duplicate_doi' WHEN by_hash THEN 'duplicate_hash' WHEN doi = '' THEN 'kept_no_doi'
 WHEN row_number() OVER (PARTITION BY doi, by_doi OR by_hash ORDER BY name) > 1 THEN 'duplicate_batch' ELSE 'kept' END AS outcome FROM s"""
)
def screen_batch(spark, d):
    rows = loose_papers(spark, d).select("doi", F.sha2("title", 256).alias("sha256"), F.col("paper_id").alias("name"), "source_type")
    return dedup.screen_batch(rows.where("source_type IS NOT NULL").drop("source_type"), rows.where("source_type IS NULL").select("doi", "sha256")).select("name", "outcome")


KEY_SQL = "regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query(
    f"""WITH n AS (SELECT DISTINCT text AS name FROM documents WHERE text IS NOT NULL), m AS (SELECT DISTINCT split_part(text, chr(10), 1) AS known FROM documents WHERE text IS NOT NULL),
a AS (SELECT name, {KEY_SQL.replace("lower(x)", "lower(name)")} AS k FROM n), b AS (SELECT known, {KEY_SQL.replace("lower(x)", "lower(known)")} AS k FROM m)
SELECT DISTINCT md5(name) AS name_md5, md5(known) AS known_md5 FROM a JOIN b ON a.k = b.k OR (length(b.k) >= 60 AND starts_with(a.k, b.k))"""
)
def prefix_match(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    names, known = docs.select(F.col("text").alias("name")).distinct(), docs.select(F.substring_index("text", "\n", 1).alias("known")).distinct()
    return dedup.matches_by_prefix(names, known).select(F.md5("name").alias("name_md5"), F.md5("known").alias("known_md5"))


# --- validation and metadata -------------------------------------------------------

STEM_SQL = "regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[\\s.,-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')"
T, J = STEM_SQL.format(c="title"), STEM_SQL.format(c="journal")
ISSUES_SQL = f"""issues AS (
SELECT seq, paper_id, 'title_eq_journal' AS code, 'title' AS field, 'high' AS severity FROM papers WHERE {T} <> '' AND {T} = {J}
UNION ALL SELECT seq, paper_id, 'title_has_journal_prefix', 'title', 'medium' FROM papers WHERE length({J}) >= 8 AND {T} <> {J} AND starts_with({T}, {J} || '_')
UNION ALL SELECT seq, paper_id, 'authors_glued', 'authors', 'info' FROM papers WHERE author_kind = 'glued' AND p_brand IS NOT NULL AND NOT regexp_matches('Anna' || p_brand, '\\s') AND regexp_matches('Anna' || p_brand, '[a-z][A-Z]')
UNION ALL SELECT seq, paper_id, 'authors_affiliation', 'authors', 'high' FROM papers WHERE (author_kind = 'glued' AND regexp_matches('Anna' || p_brand, '[0-9]')) OR author_kind = 'place' OR author_kind = 'full'
UNION ALL SELECT seq, paper_id, 'year_implausible', 'year', 'medium' FROM papers WHERE year IS NULL OR year NOT BETWEEN 1900 AND 2026
UNION ALL SELECT seq, paper_id, 'doi_malformed', 'doi', 'high' FROM papers WHERE trim(coalesce(doi, '')) <> '' AND NOT regexp_matches(trim(doi), '^10\\.\\d{{4,9}}/\\S+$'))"""


@query(f"""WITH {PAPERS_SQL}, {ISSUES_SQL} SELECT seq, string_agg(code, ',' ORDER BY code) AS codes FROM issues
WHERE NOT (field = 'authors' AND seq % 2 = 0) GROUP BY seq HAVING bool_or(severity IN ('medium', 'high'))""")
def validate_papers(spark, d):
    rows = papers(spark, d)
    dismissed = rows.where("seq % 2 = 0").select("paper_id", F.lit("authors").alias("field"))
    return validation.validate(rows, 2025, dismissed).select("seq", F.array_join(F.array_sort("issues.code"), ",").alias("codes"))


@query(f"WITH {PAPERS_SQL}, {ISSUES_SQL}, weighty AS (SELECT seq FROM issues WHERE severity IN ('medium', 'high')) SELECT code, count(*) AS n FROM issues WHERE seq IN (SELECT seq FROM weighty) GROUP BY code")
def validation_counts(spark, d):
    return validation.issue_counts(validation.validate(papers(spark, d), 2025))


@query(
    f"""WITH {PAPERS_SQL}, p AS (SELECT *, lower(trim(doi)) AS k FROM papers WHERE regexp_matches(trim(coalesce(doi, '')), '^10\\.\\d{{4,9}}/\\S+$')),
l AS (SELECT k, 'Work ' || min(title) AS title, min(nullif(journal, '')) AS journal, min(nullif(year, 1700)) + 1 AS year FROM p WHERE seq % 5 <> 0 GROUP BY k),
j AS (SELECT p.*, l.k IS NOT NULL AS known, l.title AS l_title, l.journal AS l_journal, l.year AS l_year, TRY_CAST(nullif(regexp_extract(paper_id, '(19\\d{{2}}|20[0-3]\\d)', 1), '') AS INT) AS id_year FROM p LEFT JOIN l USING (k)),
f AS (SELECT seq, 'crossref_miss' AS code FROM j WHERE NOT known
UNION ALL SELECT seq, 'title_recover' FROM j WHERE known AND (({T} <> '' AND {T} = {J}) OR (length({J}) >= 8 AND {T} <> {J} AND starts_with({T}, {J} || '_')))
UNION ALL SELECT seq, 'title_mismatch' FROM j WHERE known AND NOT (({T} <> '' AND {T} = {J}) OR (length({J}) >= 8 AND {T} <> {J} AND starts_with({T}, {J} || '_'))) AND {T} <> {STEM_SQL.format(c="l_title")}
UNION ALL SELECT seq, 'journal_fill' FROM j WHERE known AND trim(coalesce(journal, '')) = '' AND l_journal IS NOT NULL
UNION ALL SELECT seq, 'journal_mismatch' FROM j WHERE known AND trim(coalesce(journal, '')) <> '' AND l_journal IS NOT NULL AND {J} <> {STEM_SQL.format(c="l_journal")}
UNION ALL SELECT seq, 'year_mismatch' FROM j WHERE known AND l_year IS NOT NULL AND year IS DISTINCT FROM l_year
UNION ALL SELECT seq, 'year_mismatch' FROM j WHERE l_year IS NULL AND id_year IS NOT NULL AND year IS DISTINCT FROM id_year)
SELECT seq, string_agg(code, ',' ORDER BY code) AS codes FROM f GROUP BY seq"""
)
def compare_lookup(spark, d):
    rows = papers(spark, d)
    valid = rows.where(ids.doi_valid("doi")).where("seq % 5 <> 0").groupBy(F.lower(F.trim("doi")).alias("doi"))
    lookup = valid.agg(F.concat(F.lit("Work "), F.min("title")).alias("title"), F.min(F.nullif("journal", F.lit(""))).alias("journal"), (F.min(F.nullif("year", F.lit(1700))) + 1).alias("year"))
    lookup = lookup.withColumns({"journal_short": F.lit(None).cast("string"), "authors": F.expr("cast(null as array<struct<family:string,given:string>>)")})
    found = validation.compare(rows, lookup, by_ratio=False).select("seq", F.array_join(F.array_sort("found.code"), ",").alias("codes"))
    return found.where("codes <> ''")


LACKS = [("missing_title", 0.25, "trim(coalesce(title, '')) = ''"), ("missing_doi", 0.20, "trim(coalesce(doi, '')) = ''"), ("missing_abstract", 0.15, "trim(coalesce(abstract, '')) = ''"), ("missing_year", 0.10, "coalesce(year, 0) = 0"), ("missing_authors", 0.10, "author_kind = 'none'"), ("no_references_extracted", 0.10, "n_references < 5")]
QUALITY_SQL = f"""scored AS (SELECT *, round_even(greatest(0, round(1 - ({" + ".join(f"CASE WHEN {c} THEN {p} ELSE 0 END" for _, p, c in LACKS)}), 6))::DOUBLE, 2) AS quality_score,
list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, _, c in LACKS)}], lambda x: x IS NOT NULL) AS warnings FROM papers)"""


@query(f"WITH {PAPERS_SQL}, {QUALITY_SQL} SELECT seq, quality_score, array_to_string(warnings, ',') AS warnings FROM scored")
def quality_score(spark, d):
    return metadata.with_quality(papers(spark, d)).select("seq", "quality_score", F.array_join("warnings", ",").alias("warnings"))


HAS_DOI = "trim(coalesce(doi, '')) <> ''"
PERCENT = "round_even(100 * count(*) FILTER ({c}) / count(*), 0)"


@query(f"""WITH {PAPERS_SQL}, {QUALITY_SQL} SELECT category, count(*) AS n, count(quality_score) AS n_scored, round_even(round(avg(quality_score), 9), 2) AS mean_score, {PERCENT.format(c="trim(coalesce(doi, '')) <> ''")} AS pct_doi,
{PERCENT.format(c="trim(coalesce(title, '')) <> ''")} AS pct_title, {PERCENT.format(c="coalesce(year, 0) <> 0")} AS pct_year, {PERCENT.format(c="trim(coalesce(abstract, '')) <> ''")} AS pct_abstract, {PERCENT.format(c="n_references >= 5")} AS pct_references FROM scored GROUP BY category""")
def category_quality(spark, d):
    return rollups.category_quality(metadata.with_quality(papers(spark, d)))


@query(f"""WITH {PAPERS_SQL}, {QUALITY_SQL}, w AS (SELECT category, unnest(warnings) AS warning FROM scored)
SELECT category, warning, count(*) AS n, row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, warning) AS rank FROM w GROUP BY category, warning QUALIFY rank <= 5""")
def top_warnings(spark, d):
    return rollups.top_warnings(metadata.with_quality(papers(spark, d)))


@query(
    f"""WITH {PAPERS_SQL} SELECT count(*) FILTER (trim(coalesce(doi, '')) = '') AS no_doi, count(*) FILTER (coalesce(year, 0) = 0) AS no_year, count(*) FILTER (author_kind = 'none') AS no_authors,
count(*) FILTER (trim(coalesce(journal, '')) = '') AS no_journal, count(*) FILTER (paper_id <> lower(paper_id) OR regexp_matches(paper_id, '_10_\\d')) AS id_not_canonical,
count(*) FILTER (author_kind IN ('none', 'glued', 'place')) AS authors_incomplete FROM papers"""
)
def editor_worklist(spark, d):
    asks = metadata.incomplete(papers(spark, d).columns)
    return papers(spark, d).agg(*(F.count_if(asks[n]).alias(n) for n in ("no_doi", "no_year", "no_authors", "no_journal", "id_not_canonical", "authors_incomplete")))


# --- roll-ups ------------------------------------------------------------------------

USAGE_SQL = "usage AS (SELECT ts, strftime(ts, '%Y-%m') AS month, event_type AS provider, 'model-' || (user_id % 5) AS model, coalesce(value, 0) AS cost, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS input_tokens FROM events)"


def usage(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "ts", F.col("event_type").alias("provider"), F.concat(F.lit("model-"), F.col("user_id") % 5).alias("model"), F.coalesce("value", F.lit(0.0)).alias("cost"), F.get_json_object("props", "$.k").try_cast("bigint").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))


@query(f"""WITH {USAGE_SQL} SELECT month, CASE WHEN grouping(provider) + grouping(model) = 2 THEN 'total' WHEN grouping(model) = 1 THEN 'provider' ELSE 'model' END AS level, provider, model, count(*) AS n, round(sum(cost), 6) AS cost
FROM usage GROUP BY GROUPING SETS ((month), (month, provider), (month, model))""")
def usage_rollup(spark, d):
    return rollups.monthly_usage(usage(spark, d))


@query(f"WITH {USAGE_SQL} SELECT model, count(*) AS n, sum(input_tokens)::BIGINT AS input_tokens, count(*) AS output_tokens, round(sum(cost), 6) AS cost FROM usage GROUP BY model HAVING round(sum(cost), 6) > 0")
def model_usage(spark, d):
    return rollups.model_usage(usage(spark, d))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def last_queries(spark, d):
    return rollups.last_queries(table(spark, d, "events")).select("event_id", "ts")


@query(f"""WITH {PAPERS_SQL} SELECT category, count(*) FILTER (source_type = 'scopus') AS scopus, count(*) FILTER (source_type = 'manual') AS manual, count(*) FILTER (source_type = 'adhoc') AS adhoc,
count(*) FILTER (source_type IS NULL) AS unknown, count(*) AS total FROM papers GROUP BY category""")
def source_pivot(spark, d):
    return rollups.source_pivot(papers(spark, d), ["scopus", "manual", "adhoc"])


GAPS_SQL = """c AS (SELECT DISTINCT source AS category FROM documents), t AS (SELECT source AS category, count(*) AS n FROM documents GROUP BY ALL),
l AS (SELECT source AS category, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), v AS (SELECT source AS category, count(*) AS n FROM documents JOIN embeddings ON doc_id = vec_id GROUP BY ALL)"""


@query(f"""WITH {GAPS_SQL} SELECT category, coalesce(t.n, 0) AS n_texts, coalesce(l.n, 0) AS n_labels, coalesce(v.n, 0) AS n_vectors, greatest(0, coalesce(t.n, 0) - coalesce(l.n, 0)) AS missing_labels,
greatest(0, coalesce(t.n, 0) - coalesce(v.n, 0)) AS missing_vectors FROM c LEFT JOIN t USING (category) LEFT JOIN l USING (category) LEFT JOIN v USING (category)""")
def category_gaps(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("category"))
    labels = docs.join(table(spark, d, "labels"), "doc_id")
    vectors = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")
    return rollups.artefact_gaps(docs.select("category").distinct(), "texts", texts=docs, labels=labels, vectors=vectors)


@query(
    f"""WITH {PAPERS_SQL}, {QUALITY_SQL}, f AS (SELECT c_mktsegment AS category, CASE WHEN o_orderkey % 2 = 0 THEN 'pdf' ELSE 'index' END AS kind, o_orderdate AS modified FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT category, max(modified) FILTER (kind = 'pdf') AS p, max(modified) FILTER (kind = 'index') AS i FROM f GROUP BY ALL),
n AS (SELECT category, count(*) AS n_papers, round_even(round(avg(quality_score), 9), 3) AS mean_quality, sum(n_references)::BIGINT AS n_chunks FROM scored GROUP BY ALL)
SELECT category, n_papers, n_chunks, mean_quality, coalesce(p > i, false) AS stale FROM n LEFT JOIN m USING (category)"""
)
def corpus_manifest(spark, d):
    rows = metadata.with_quality(papers(spark, d))
    chunks = rows.where("n_references > 0").select("category", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_references"))).alias("n"))
    files = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("category"), F.when(F.col("o_orderkey") % 2 == 0, "pdf").otherwise("index").alias("kind"), F.col("o_orderdate").alias("modified"))
    return rollups.corpus_manifest(rows, chunks, files)


@query(f"WITH {PAPERS_SQL}, {QUALITY_SQL} SELECT count(*) AS n, {PERCENT.format(c=HAS_DOI)} AS pct_doi, min(year) AS first_year, max(year) AS last_year, round_even(round(avg(quality_score), 9), 2) AS mean_score FROM scored")
def catalogue_metrics(spark, d):
    return rollups.catalogue_metrics(metadata.with_quality(papers(spark, d)))


# --- registry and lifecycle --------------------------------------------------------

REGISTRY_SQL = """reg AS (SELECT doi, title, coalesce(year::VARCHAR, '') AS year, category, 'https://doi.org/' || doi AS landing_url, CASE seq % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'downloaded' ELSE 'blocked' END AS status,
 'old' AS reason, '2025-01-01' AS last_checked, 'note' AS notes, CASE WHEN seq % 4 = 0 THEN '2030-01-01' ELSE '' END AS snooze_until FROM loose WHERE doi <> '' AND seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY doi ORDER BY seq) = 1)"""


def registry_parts(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = loose_papers(spark, d).where("doi <> ''")
    old = dedup.first_by(rows.where("seq % 2 = 0"), ["doi"], [F.col("seq")])
    status = F.when(F.col("seq") % 3 == 0, "pending").when(F.col("seq") % 3 == 1, "downloaded").otherwise("blocked")
    table_ = old.select("doi", "title", F.coalesce(F.col("year").cast("string"), F.lit("")).alias("year"), "category", F.concat(F.lit("https://doi.org/"), F.col("doi")).alias("landing_url"), status.alias("status"), F.lit("old").alias("reason"), F.lit("2025-01-01").alias("last_checked"), F.lit("note").alias("notes"), F.when(F.col("seq") % 4 == 0, "2030-01-01").otherwise("").alias("snooze_until"))
    return registry.shaped(table_), rows


@query(
    f"""WITH {PAPERS_SQL}, {LOOSE}, {REGISTRY_SQL}, new AS (SELECT doi, left(title, 300) AS title, coalesce(year::VARCHAR, '') AS year, category, 'https://doi.org/' || doi AS landing_url FROM loose WHERE doi <> '' QUALIFY row_number() OVER (PARTITION BY doi ORDER BY seq DESC) = 1),
j AS (SELECT r.doi AS r_doi, n.doi AS n_doi, r.status = 'pending' AS fresh, r.*, n.title AS n_title, n.year AS n_year, n.category AS n_category, n.landing_url AS n_url FROM reg r FULL JOIN new n ON r.doi = n.doi)
SELECT coalesce(r_doi, n_doi) AS doi, CASE WHEN r_doi IS NULL OR fresh THEN n_title ELSE title END AS title, CASE WHEN r_doi IS NULL OR fresh THEN n_year ELSE year END AS year, CASE WHEN r_doi IS NULL OR fresh THEN n_category ELSE category END AS category,
CASE WHEN r_doi IS NULL OR fresh THEN n_url ELSE landing_url END AS landing_url, CASE WHEN r_doi IS NULL THEN 'pending' ELSE status END AS status, CASE WHEN r_doi IS NULL OR fresh THEN '' ELSE reason END AS reason,
CASE WHEN r_doi IS NULL OR fresh THEN '2026-01-01' ELSE last_checked END AS last_checked, CASE WHEN r_doi IS NULL THEN '' ELSE notes END AS notes, CASE WHEN r_doi IS NULL THEN '' ELSE snooze_until END AS snooze_until FROM j"""
)
def registry_upsert(spark, d):
    old, rows = registry_parts(spark, d)
    return registry.upsert(old, rows.select("seq", "doi", "title", "year", "category", F.lit("").alias("reason")), "2026-01-01")


@query(f"""WITH {PAPERS_SQL}, {LOOSE}, {REGISTRY_SQL}, corpus AS (SELECT DISTINCT doi FROM loose WHERE doi <> '' AND seq % 5 = 0)
SELECT doi, CASE WHEN status = 'pending' AND doi IN (SELECT doi FROM corpus) THEN 'downloaded' ELSE status END AS status, CASE WHEN status = 'pending' AND doi IN (SELECT doi FROM corpus) THEN '2026-01-01' ELSE last_checked END AS last_checked FROM reg""")
def registry_reconcile(spark, d):
    old, rows = registry_parts(spark, d)
    return registry.reconcile(old, rows.where("seq % 5 = 0"), "2026-01-01").select("doi", "status", "last_checked")


@query(f"WITH {PAPERS_SQL}, {LOOSE}, {REGISTRY_SQL} SELECT doi, category FROM reg WHERE status = 'pending' AND (trim(snooze_until) = '' OR trim(snooze_until) <= '2026-01-01')")
def registry_active(spark, d):
    return registry.active(registry_parts(spark, d)[0], "2026-01-01").select("doi", "category")


@query("""SELECT vec_id AS id, 'keep' AS outcome FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'embed' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def index_incremental(spark, d):
    index = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    kept, new = dense.incremental(index, table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id")
    return kept.withColumn("outcome", F.lit("keep")).unionByName(new.withColumn("outcome", F.lit("embed")))


@query("""SELECT vec_id AS id, 'phantom' AS status FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'unindexed' FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)""")
def index_coherence(spark, d):
    return dense.coherence(table(spark, d, "embeddings").select(F.col("vec_id").alias("id")), table(spark, d, "labels").select(F.col("doc_id").alias("id")), "id")


@query("SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def index_prune(spark, d):
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return dense.prune(table(spark, d, "embeddings"), gone, "vec_id").select("vec_id", "label", F.round(norm("embedding"), 5).alias("norm"))


@query("SELECT source AS category, doc_id::VARCHAR AS paper_id FROM documents WHERE NOT (doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AND doc_id % 3 <> 0)")
def quarantine_restore(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("category"), F.col("doc_id").cast("string").alias("paper_id"))
    bad = rows.join(table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("paper_id")), "paper_id", "left_semi")
    empty = spark.createDataFrame([], "category string, paper_id string, reason string, deleted_at string")
    stones = lifecycle.quarantine(empty, bad, "quality", "2026-01-01")
    return lifecycle.visible(rows, lifecycle.restore(stones, bad.where("cast(paper_id as bigint) % 3 = 0")))


@query(f"""WITH {PAPERS_SQL} SELECT category, CASE WHEN seq % 4 = 0 THEN 'new_' || paper_id ELSE paper_id END AS paper_id, CASE WHEN seq % 4 = 0 AND seq % 3 <> 0 THEN 'new_' || paper_id WHEN seq % 3 = 0 THEN 'other' ELSE paper_id END AS stable_id FROM papers""")
def rename_ids(spark, d):
    rows = papers(spark, d).select("category", "paper_id", F.when(F.col("seq") % 3 == 0, "other").otherwise(F.col("paper_id")).alias("stable_id"), "seq")
    renames = rows.where("seq % 4 = 0").select("category", F.col("paper_id").alias("old_id"), F.concat(F.lit("new_"), "paper_id").alias("new_id"))
    return lifecycle.rename({"papers": rows}, renames, "papers")["papers"].select("category", "paper_id", "stable_id")


@query(f"""WITH {PAPERS_SQL}, old AS (SELECT category, paper_id FROM papers WHERE seq % 3 = 0),
packed AS (SELECT category, paper_id, ceil(row_number() OVER (PARTITION BY category ORDER BY paper_id) / 45)::INT AS package FROM old), last AS (SELECT category, max(package) AS last FROM packed GROUP BY ALL)
SELECT category, paper_id, (coalesce(last, 0) + ceil(row_number() OVER (PARTITION BY category ORDER BY paper_id) / 45))::INT AS package FROM papers LEFT JOIN last USING (category) WHERE seq % 3 <> 0""")
def package_batches(spark, d):
    rows = papers(spark, d)
    packed = exports.packages(rows.where("seq % 3 = 0"))
    return exports.packages(rows, packed)


@query(f"""WITH {PAPERS_SQL}, packed AS (SELECT category, paper_id, ceil(row_number() OVER (PARTITION BY category ORDER BY paper_id) / 45)::INT AS package FROM papers),
m AS (SELECT category, package, count(*) AS n FROM packed GROUP BY ALL)
SELECT category, count(*) AS n_packages, sum(n)::BIGINT AS n_papers, string_agg(format('{{:03d}}', package), ',' ORDER BY package) AS packages FROM m GROUP BY category""")
def master_index(spark, d):
    rows = papers(spark, d)
    return exports.master_index(exports.package_manifest(exports.packages(rows), rows))


# --- citations and exports -----------------------------------------------------------

SURNAME_SQL = "CASE WHEN author_kind = 'full' THEN 'Customer' || o_custkey WHEN author_kind = 'glued' AND p_brand IS NOT NULL THEN 'Brand' WHEN author_kind = 'place' THEN 'Tests' ELSE upper(left(split_part(paper_id, '_', 2), 1)) || lower(substr(split_part(paper_id, '_', 2), 2)) END"


@query(f"""WITH {PAPERS_SQL}, {LOOSE} SELECT seq, '(' || {SURNAME_SQL} || ', ' || coalesce(year::VARCHAR, nullif(regexp_extract(paper_id, '(19\\d{{2}}|20[0-3]\\d)', 1), ''), 's.f.') || CASE WHEN doi <> '' THEN '; ' || doi ELSE '' END || ')' AS cite
FROM loose""")
def cite_keys(spark, d):
    return loose_papers(spark, d).select("seq", citations.article_key().alias("cite"))


ANSWER = "coalesce(text, '') || ' [' || (conv_id % 12) || '] [3][' || turn || ']' || chr(10) || 'Referencias:' || chr(10) || '[99]'"


@query(f"""WITH a AS (SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all(regexp_replace({ANSWER}, '(?is)\\n+\\s*(#+\\s*)?(referencias|bibliograf[íi]a|references)\\s*:?\\s*\\n.*$', ''), '\\[(\\d{{1,9}})\\]', 1), lambda x: x::INT))) AS n FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(n, lambda x: x NOT IN (1, 2, 3, 4, 5, 6, 7, 8)), ',') AS orphans FROM a""")
def orphan_citations(spark, d):
    answer = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), F.col("conv_id") % 12, F.lit("] [3]["), F.col("turn"), F.lit("]\nReferencias:\n[99]"))
    known = F.array(*map(F.lit, range(1, 9)))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(citations.orphans(answer, known), ",").alias("orphans"))


@query("""WITH b AS (SELECT conv_id, string_agg('[' || (turn + 1) || '] ' || coalesce(role, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id)
SELECT conv_id, length(context) AS chars, greatest(1, length(context) // 4) AS tokens, md5(context) AS context_md5 FROM b""")
def context_prompt(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("n"), F.col("role").alias("label"), "text")
    return citations.contexts(turns, "conv_id").select("conv_id", "chars", "tokens", F.md5("context").alias("context_md5"))


@query("SELECT conv_id, md5(string_agg(upper(coalesce(role, '')) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS prompt_md5 FROM conversations GROUP BY conv_id")
def chat_prompts(spark, d):
    return citations.chat_prompt(table(spark, d, "conversations")).select("conv_id", F.md5("prompt").alias("prompt_md5"))


BIB_SQL = f"""base AS (SELECT *, CASE author_kind WHEN 'full' THEN 'customer' WHEN 'glued' THEN coalesce(regexp_replace('Anna' || p_brand, '[^a-zA-Z]', '', 'g'), '') WHEN 'place' THEN 'Tests' ELSE '' END || coalesce(year::VARCHAR, 'XXXX') AS base,
 CASE author_kind WHEN 'full' THEN 'Maria Customer' || o_custkey WHEN 'glued' THEN coalesce('Anna' || p_brand, 'Unknown') WHEN 'place' THEN 'University of Tests' ELSE 'Unknown' END AS names FROM loose),
k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY seq) - 2 AS n FROM base),
b AS (SELECT *, base || CASE WHEN n < 0 THEN '' WHEN n < 26 THEN chr((n + 97)::INT) ELSE '_' || (n + 2) END AS bib_key FROM k)"""


@query(f"""WITH {PAPERS_SQL}, {LOOSE}, {BIB_SQL} SELECT paper_id, bib_key, md5('@article{{' || bib_key || ',' || chr(10) || '  author   = {{' || names || '}},' || chr(10) || '  title    = {{' || title || '}},' || chr(10)
|| CASE WHEN journal <> '' THEN '  journal  = {{' || journal || '}},' || chr(10) ELSE '' END || CASE WHEN year IS NOT NULL THEN '  year     = {{' || year || '}},' || chr(10) ELSE '' END
|| CASE WHEN doi <> '' THEN '  doi      = {{' || doi || '}},' || chr(10) ELSE '' END || CASE WHEN coalesce(abstract, '') <> '' THEN '  abstract = {{' || abstract || '}},' || chr(10) ELSE '' END || '}}') AS entry_md5 FROM b""")
def bibtex_export(spark, d):
    return exports.bibtex(loose_papers(spark, d)).select("paper_id", "bib_key", F.md5("entry").alias("entry_md5"))


@query(f"WITH {PAPERS_SQL}, {LOOSE} SELECT seq, paper_id FROM loose WHERE doi <> '' AND (year IS NULL OR year BETWEEN 1995 AND 2000)")
def export_filter(spark, d):
    return loose_papers(spark, d).where(fusion.export_condition(1995, 2000, with_doi=True)).select("seq", "paper_id")


@query(f"WITH {PAPERS_SQL} SELECT category, count(*) AS n FROM papers WHERE year BETWEEN 1995 AND 2000 AND contains(lower(title), 'study') GROUP BY category")
def catalogue_filter(spark, d):
    rows = papers(spark, d).withColumn("authors", F.array_join(validation.author_names(), "; "))
    return rows.where(fusion.catalogue_condition("study", year_start=1995, year_end=2000)).groupBy("category").agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lexloom.plans import catalog_files, catalog_more, catalog_stores  # noqa: F401  # register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from lexloom.plans import catalog_files, catalog_more, catalog_stores  # noqa: F401

    return dict(ORACLES)
