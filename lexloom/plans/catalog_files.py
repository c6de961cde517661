"""Registered queries that write files to the shared folder and read them back, and operators that read what is kept beside tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import ids
from lexloom.functions.vectors import normalize
from lexloom.operators import citations, dedup, dense, exports, lifecycle, metadata, pages
from lexloom.operators.ranking import checkpointed, numbered
from lexloom.plans import flows, retrieval
from lexloom.plans.catalog import CORPUS_DOI, DISTANCE_SQL, ORACLES, UNIT_SQL, chunk_collection, dedup_records, loose_papers, query, query_vector
from lexloom.plans.catalog_stores import fresh_folder
from lexloom.plans.tables import PAPERS_SQL, papers, table
from lexloom.sources import lines, providers, readers, writers
from lexloom.sources.store import Store

#: Rows of a file that is written and read back, so that files grow in number and not in size.
FILE_ROWS = 3000

# --- round trips -------------------------------------------------------------------


@query("""SELECT doc_id, lang AS phase, md5(coalesce(text, '')) AS text_md5, false AS bad, true AS numbered FROM documents
UNION ALL SELECT doc_id, lang, NULL, true, true FROM documents WHERE doc_id % 7 = 0""")
def jsonl_round_trip(spark, d):
    """Whole documents as lines of JSON, some followed by a broken one, in a folder for each language, read again by line.

    ``numbered`` says that the numbers found for the lines of a file are 1, 2, ... up to how many it has.
    """
    folder = fresh_folder(spark, "jsonl")
    whole = F.to_json(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    broken = F.concat(F.lit('{"doc_id":'), F.col("doc_id"), F.lit(',"text":'))
    rows = table(spark, d, "documents").select("lang", F.explode(F.when(F.col("doc_id") % 7 == 0, F.array(whole, broken)).otherwise(F.array(whole))).alias("value"))
    rows.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("lang").text(folder)
    found = lines.numbered(spark, folder)
    files = found.groupBy("path").agg(((F.max("line_no") == F.count("*")) & (F.sum("line_no") == F.count("*") * (F.count("*") + 1) / 2)).alias("numbered"))
    read = found.join(files, "path").select("numbered", F.regexp_extract("path", "/lang=([^/]+)/", 1).alias("phase"), "line", F.from_json("line", "doc_id long, text string").alias("r"))
    bad = F.col("r.text").isNull()
    own = F.coalesce("r.doc_id", F.nullif(F.regexp_extract("line", r'^\{"doc_id":(\d+)', 1), F.lit("")).cast("long"))
    return read.select(own.alias("doc_id"), "phase", F.md5("r.text").alias("text_md5"), bad.alias("bad"), "numbered")


@query("""SELECT doc_id, md5(text) AS text_md5, lang AS journal, true AS at_its_line FROM documents""")
def csv_round_trip(spark, d):
    """Whole documents as CSV with quotes and line ends in their fields, under other names of columns, read again in blocks.

    A record's number has to be that of the line where its file has it: the lines of all records before it lie between.
    """
    folder = fresh_folder(spark, "csv")
    docs = table(spark, d, "documents").select(F.concat(F.lit('"'), "text").alias("Título"), F.col("lang").alias("Revista"), F.col("doc_id").alias("DOI"))
    docs.write.options(header="true", encoding="UTF-8", sep=";", escape='"', maxRecordsPerFile=FILE_ROWS).csv(folder)
    found = readers.read_csv(spark, folder)
    numbered_ = lines.records(spark, folder).select(F.col("line_no").alias("seq"), "record", "path")
    size = F.size(F.split("record", "\n")).cast("long")
    before = Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # a check of few files
    placed = numbered_.withColumn("ok", F.col("seq") == F.coalesce(F.sum(size).over(before), F.lit(0)) + 1).groupBy("path").agg(F.bool_and("ok").alias("ok")).agg(F.bool_and("ok").alias("at_its_line"))
    return found.crossJoin(F.broadcast(placed)).select(F.col("doi").cast("long").alias("doc_id"), F.md5(F.expr("substr(title, 2)")).alias("text_md5"), "journal", "at_its_line")  # one row


@query("""SELECT 'now' AS version, doc_id, quality FROM labels UNION ALL SELECT 'before', doc_id, 1 - quality FROM labels WHERE doc_id % 2 = 0""")
def table_versions(spark, d):
    """A table in two versions: what the pointer shows, and what it showed before."""
    folder, labels = fresh_folder(spark, "versions"), table(spark, d, "labels").select("doc_id", "quality")
    writers.write_version(labels.where("doc_id % 2 = 0").withColumn("quality", 1 - F.col("quality")), folder)
    writers.write_version(labels, folder)
    both = [writers.read_version(spark, folder, back).withColumn("version", F.lit(name)) for back, name in ((0, "now"), (1, "before"))]
    return both[0].unionByName(both[1]).select("version", "doc_id", "quality")


@query("""WITH f AS (SELECT source || '/' || doc_id AS path, text FROM documents), v AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN text || ' as it was' ELSE text END AS old FROM (SELECT doc_id, source || '/' || doc_id AS path, text FROM documents))
SELECT 'second' AS taken_at, path, md5(coalesce(old, '')) AS content_md5 FROM v UNION ALL SELECT 'third', path, md5(coalesce(text, '')) FROM v
UNION ALL SELECT 'contents', count(*)::VARCHAR, NULL FROM (SELECT coalesce(old, '') FROM v UNION SELECT coalesce(text, '') FROM v)""")
def snapshot_history(spark, d):
    """Documents as files in three snapshots of which two are kept; and how many contents are stored for them."""
    folder = fresh_folder(spark, "snapshots")
    files = table(spark, d, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")
    old = F.when(F.col("doc_id") % 5 == 0, F.concat("content", F.lit(" as it was"))).otherwise(F.col("content")).cast("binary")
    now = files.select("path", F.col("content").cast("binary").alias("content"))
    writers.write_snapshot(files.where("doc_id % 3 = 0").select("path", F.lit(b"gone").alias("content")), folder, "first", keep=2)
    writers.write_snapshot(files.select("path", old.alias("content")), folder, "second", keep=2)
    writers.write_snapshot(now, folder, "third", keep=2)
    writers.write_snapshot(now, folder, "no change", keep=2)
    out = [writers.read_snapshot(spark, folder, n).select(F.lit(n).alias("taken_at"), "path", F.md5("content").alias("content_md5")) for n in writers.snapshots(spark, folder)]
    contents = Store(spark, folder).read("contents").agg(F.count("*").cast("string").alias("path")).select(F.lit("contents").alias("taken_at"), "path", F.lit(None).cast("string").alias("content_md5"))
    return reduce(DataFrame.unionByName, [*out, contents])


@query("SELECT 'regions' AS sheet, r_name AS name, count(*)::VARCHAR AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL UNION ALL SELECT 'languages', lang, count(*)::VARCHAR FROM documents GROUP BY ALL")
def report_sheets(spark, d):
    """A report of two sheets, written as CSV with the mark of spreadsheet programs and read as tables."""
    folder = fresh_folder(spark, "report")
    regions = table(spark, d, "region").join(table(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("r_name").alias("name")).agg(F.count("*").alias("n"))
    sheets = {"regions": regions, "languages": table(spark, d, "documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n"))}
    writers.write_report(sheets, folder)
    read = [readers.read_csv(spark, f"{folder}/{n}", {"name": ["name"], "n": ["n"]}, ("name", "n")).select(F.lit(n).alias("sheet"), "name", "n") for n in sheets]
    return read[0].unionByName(read[1])


# --- what is kept beside tables ------------------------------------------------------


@query("""WITH h AS (SELECT doc_id, source, sha256(coalesce(text, '') || 'v2') AS now, CASE WHEN doc_id % 3 = 0 THEN sha256('older') ELSE sha256(coalesce(text, '') || 'v2') END AS was FROM documents)
SELECT doc_id, 'stays' AS outcome FROM h WHERE now = was AND doc_id % 5 <> 0 UNION ALL SELECT doc_id, 'embed' FROM h WHERE now <> was OR doc_id % 5 = 0""")
def embedded_by_hash(spark, d):
    """Which vectors stay and which documents are embedded anew, by the hash of text and settings; some are new, some went."""
    now = table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), ids.content_hash("text", "v2").alias("sha256"))
    was = now.where("book_id % 5 <> 0").withColumn("sha256", F.when(F.col("book_id") % 3 == 0, F.sha2(F.lit("older"), 256)).otherwise(F.col("sha256")))
    gone = was.select((F.col("book_id") + 1_000_000_000).alias("book_id"), "sha256")
    keep, new = dense.incremental_by_hash(was.unionByName(gone), now)
    return keep.select(F.col("book_id").alias("doc_id"), F.lit("stays").alias("outcome")).unionByName(new.select(F.col("book_id").alias("doc_id"), F.lit("embed").alias("outcome")))


@query(f"WITH intra AS ({ORACLES['dedup_keep_intra']}), {PAPERS_SQL}, loose_ids AS (SELECT paper_id, seq, category FROM papers) SELECT seq, category FROM loose_ids l WHERE NOT EXISTS (SELECT 1 FROM intra i WHERE i.category = l.category AND i.remove_stem = l.paper_id AND i.remove_line = l.seq)")
def applied_decisions(spark, d):
    """Papers after the decisions on duplicates within categories."""
    rows = papers(spark, d).select("seq", "category", F.col("paper_id").alias("stem"), F.col("seq").alias("line_no"))
    return dedup.apply_decisions(rows, dedup.decide(dedup_records(spark, d))).select("seq", "category")


@query("SELECT 'deleted' AS reason, source AS category, count(*) AS n, '2026-01-0' || (1 + doc_id % 3) AS deleted_at FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY ALL")
def quarantine_entries(spark, d):
    """What lies in quarantine, by day and category."""
    rows = table(spark, d, "documents").select(F.col("source").alias("category"), F.col("doc_id").cast("string").alias("paper_id"), "doc_id")
    toxic = rows.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    stones = spark.createDataFrame([], "category string, paper_id string, reason string, deleted_at string")
    for day in range(3):
        stones = lifecycle.quarantine(stones, toxic.where(F.col("doc_id") % 3 == day), "deleted", f"2026-01-0{1 + day}")
    return lifecycle.quarantine_list(stones).groupBy("reason", "category", "deleted_at").agg(F.count("*").alias("n"))


@query(f"WITH {PAPERS_SQL} SELECT seq, CASE WHEN seq % 3 = 0 THEN '10.1000/info.' || seq WHEN seq % 3 = 1 THEN '10.1000/page' || seq ELSE '' END AS doi FROM papers")
def doi_of_files(spark, d):
    """DOIs of papers from their document information, else from their first pages."""
    rows = papers(spark, d).select("seq", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("doi:10.1000/info."), "seq")).alias("info"), F.when(F.col("seq") % 3 < 2, F.concat("title", F.lit("\nhttps://doi.org/10.1000/page"), "seq", F.lit(" and more"))).otherwise(F.col("title")).alias("first_pages"))
    return flows.paper_doi(rows).select("seq", F.coalesce("doi", F.lit("")).alias("doi"))


@query("SELECT page_id, length(html) AS chars, page_id % 40 AS n_pages, page_id % 40 > 0 AND length(html) / greatest(1, page_id % 40) >= 100 AS is_text FROM pages")
def text_books(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.length("html").alias("chars"), (F.col("page_id") % 40).alias("n_pages"))
    return rows.withColumn("is_text", F.coalesce(pages.is_text("chars", F.nullif(F.col("n_pages"), F.lit(0))), F.lit(False)))


SKIPPED = "15, 181,190-195,40-45"


@query(f"WITH {PAPERS_SQL} SELECT seq, category FROM papers WHERE seq NOT IN (15, 181, 190, 191, 192, 193, 194, 195, 40, 41, 42, 43, 44, 45)")
def rows_without_skipped(spark, d):
    return papers(spark, d).where(~F.col("seq").isin(sorted(metadata.skip_rows(SKIPPED)))).select("seq", "category")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def loaded_index(spark, d):
    """Vectors by label, after the guard that vectors and rows belong together."""
    rows = table(spark, d, "embeddings").withColumn("embedding", normalize("embedding"))
    dense.assert_integrity(rows, rows.select("vec_id"), True)
    return rows.groupBy("label").agg(F.count("*").alias("n"))


# --- folders and services --------------------------------------------------------------


@query(f"WITH {PAPERS_SQL} SELECT category, paper_id AS stem, {CORPUS_DOI} <> '' AS listed, CASE WHEN seq % 4 = 0 THEN 'draft' ELSE category END AS phase FROM papers")
def corpus_scan(spark, d):
    """Papers as JSON lines in a folder for each category, scanned as records with their stem and phase; those without DOI aren't listed."""
    folder = fresh_folder(spark, "corpus")
    rows = papers(spark, d).select("category", "doi", F.concat(F.lit("tei/"), "paper_id", F.lit(".tei.xml")).alias("source_file"), F.when(F.col("seq") % 4 == 0, "draft").otherwise(" ").alias("phase"), "seq")
    rows = checkpointed(rows)  # each folder is written from them
    for (category,) in rows.select("category").distinct().orderBy("category").collect():  # folders of a few categories
        writers.write_jsonl(rows.where(F.col("category") == category), f"{folder}/{category}")
    schema = "category string, doi string, source_file string, phase string, seq long"
    listed = readers.read_metadata(spark, folder, schema).select("seq", "stem")
    chunks = readers.read_chunks(spark, folder, schema).select("seq", "category", "phase", F.regexp_extract("source_file", "^tei/(.*)[.]tei[.]xml$", 1).alias("own"))
    return chunks.join(listed, "seq", "left").select("category", "own", "stem", "phase").select("category", F.coalesce("stem", "own").alias("stem"), F.col("stem").isNotNull().alias("listed"), "phase")


@query("SELECT source AS name, count(DISTINCT lang) AS n_files, sum(CASE WHEN length(text) > 0 THEN 1 ELSE 0 END)::BIGINT AS n_texts FROM documents GROUP BY source")
def listed_files(spark, d):
    """A text file for each source and language, listed by name and read whole: a line in it for each document."""
    folder = fresh_folder(spark, "files")
    rows = table(spark, d, "documents").select("source", "lang", F.when(F.length("text") > 0, F.concat(F.lit("text of "), "doc_id")).otherwise("none").alias("value"))
    rows.repartition("source", "lang").write.partitionBy("source", "lang").text(folder)
    found = readers.list_files(spark, folder, "*.txt").select("name", F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source"), "length")
    texts = readers.read_texts(spark, folder).select(F.col("file").alias("name"), F.regexp_count("text", F.lit("(?m)^text of [0-9]+$")).alias("n"))
    every = texts.agg(F.sum("n").alias("all")).withColumn("same", F.col("all") == rows.where("value != 'none'").count())
    own = rows.groupBy(F.col("source").alias("name")).agg(F.count_if(F.col("value") != "none").alias("n_texts"))
    listed = found.where("length > 0").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n_files"))
    return listed.join(own, "name").crossJoin(F.broadcast(every)).where("same").select("name", "n_files", "n_texts")  # one row


class Works:
    """A lookup for tests: it knows the DOIs that end in an even number."""

    def __call__(self, doi: str) -> str | None:
        return f'{{"DOI": "{doi}"}}' if doi[-1:].isdigit() and int(doi[-1]) % 2 == 0 else None


@query(f"WITH {PAPERS_SQL} SELECT DISTINCT lower(trim(doi)) AS doi, CASE WHEN regexp_matches(trim(doi), '[02468]$') THEN '{{\"DOI\": \"' || lower(trim(doi)) || '\"}}' END AS message FROM papers WHERE trim(doi) <> ''")
def looked_up(spark, d):
    """What a service of works knows of each different DOI, asked once."""
    return providers.look_up(papers(spark, d), Works)


@query(
    f"""WITH a AS (SELECT vec_id AS id, {UNIT_SQL.replace("v,", "embedding,")} AS u FROM embeddings), q AS (SELECT u FROM a ORDER BY id LIMIT 1)
SELECT id, {DISTANCE_SQL} AS score, row_number() OVER (ORDER BY {DISTANCE_SQL}, id) - 1 AS rank FROM a, q, documents WHERE doc_id = id AND ('doc_' || id) IN (SELECT 'doc_' || doc_id FROM labels WHERE quality = 1 ORDER BY doc_id LIMIT 60) QUALIFY rank < 15"""
)
def deepened(spark, d):
    """A question asked again within sixty papers of good quality that a reader has chosen."""
    good = [f"doc_{r.doc_id}" for r in table(spark, d, "labels").where("quality = 1").select("doc_id").orderBy("doc_id").limit(60).collect()]
    spec = retrieval.SearchSpec("", query_vector(spark, d), 15, scaled=False)
    return retrieval.deepen(chunk_collection(spark, d), spec, good).select("id", "score", "rank")


@query(f"WITH c AS ({ORACLES['cite_keys']}), {PAPERS_SQL} SELECT p.seq, row_number() OVER (ORDER BY p.seq) AS n, cite FROM papers p JOIN c USING (seq)")
def cited_results(spark, d):
    """Every paper as a result, in the order of its number, with its own number and citation key."""
    known = loose_papers(spark, d)
    results = numbered(known.select("seq", "paper_id"), [F.col("seq")], "rank")
    return citations.cited(results, known).select("seq", F.col("n").cast("long").alias("n"), "cite")


@query("""WITH r AS (SELECT doc_id, source AS category, 'p' || doc_id AS paper_id, text, row_number() OVER (PARTITION BY source ORDER BY 'p' || doc_id) AS n FROM documents), p AS (SELECT *, ceil(n / 45)::INT AS package FROM r)
SELECT category, package, 'md_clean/' || paper_id || '.clean.md' AS name, md5(coalesce(text, '')) AS content_md5 FROM p UNION ALL SELECT category, package, 'pdfs/s' || doc_id || '.pdf', md5('pdf ' || doc_id) FROM p WHERE doc_id % 3 = 0""")
def paper_archives(spark, d):
    """Packages of papers as ZIP archives with whole texts and the PDFs that there are, opened again."""
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("category"), F.concat(F.lit("p"), "doc_id").alias("paper_id"), F.concat(F.lit("s"), "doc_id").alias("stable_id"), F.coalesce("text", F.lit("")).alias("content"))
    packed = exports.packages(docs)
    papers_ = docs.select("category", "paper_id", "stable_id").join(packed, ["category", "paper_id"]).withColumn("of", F.struct("category", "package"))
    pdfs = docs.where("doc_id % 3 = 0").select(F.concat("stable_id", F.lit(".pdf")).alias("name"), F.concat(F.lit("pdf "), "doc_id").alias("content"))
    files = exports.paper_files(papers_, pdfs, docs.select("paper_id", "content"), "of").select("of.category", "of.package", "name", "content")
    by = ["category", "package"]
    return exports.unzipped(exports.zipped(files, by), by).select(*by, "name", F.md5("content").alias("content_md5"))
