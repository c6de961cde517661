"""More registered queries: records, texts, books, TEI, registries, exports and citations over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import ids, text
from lexloom.operators import chunking, citations, dedup, evaluation, exports, lifecycle, metadata, pages, registry, rollups, screening, tei, validation
from lexloom.plans import flows
from lexloom.plans.catalog import CORPUS_DOI, KEY_SQL, LOOSE, REGISTRY_SQL, WORDS_SQL, loose_papers, query, registry_parts, usage
from lexloom.plans.tables import PAPERS_SQL, papers, table
from lexloom.sources import readers


def key_sql(x: str) -> str:
    return KEY_SQL.replace("lower(x)", f"lower(coalesce({x}, ''))")


STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
NAMES_SQL = "CASE author_kind WHEN 'full' THEN 'Maria customer' || o_custkey WHEN 'glued' THEN coalesce('Anna' || p_brand, '') WHEN 'place' THEN 'University of Tests' ELSE '' END"
FULL_SQL = NAMES_SQL.replace("Maria customer", "Maria Customer")
LAST_SQL = "CASE author_kind WHEN 'full' THEN 'customer' || o_custkey WHEN 'glued' THEN coalesce('Anna' || p_brand, '') WHEN 'place' THEN 'Tests' ELSE '' END"
CLEAN_SQL = "(paper_id = lower(paper_id) AND NOT regexp_matches(paper_id, '_10_\\d{4,5}_'))"

# --- duplicates and names ---------------------------------------------------------


@query(f"""WITH {PAPERS_SQL}, {LOOSE}, r AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY (seq % 3 = 0) DESC, NOT {CLEAN_SQL}, seq) AS n FROM loose)
SELECT title, max(paper_id) FILTER (n = 1) AS keep, count(*) FILTER (seq % 3 = 0) >= 2 OR count(DISTINCT nullif(doi, '')) >= 2 AS risky FROM r GROUP BY title""")
def default_keep(spark, d):
    members = loose_papers(spark, d).select("title", F.col("paper_id").alias("stem"), (F.col("seq") % 3 == 0).alias("has_pdf"), "doi", "seq")
    return dedup.default_keep(members, "title")


@query(f"WITH {PAPERS_SQL}, t AS (SELECT seq, regexp_replace(title, '_[0-9_]+$', '') AS name FROM papers) SELECT seq, name, name || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || row_number() OVER w END AS unique_name FROM t WINDOW w AS (PARTITION BY name ORDER BY seq)")
def unique_titles(spark, d):
    rows = papers(spark, d).select("seq", F.regexp_replace("title", "_[0-9_]+$", "").alias("name"))
    return dedup.unique_names(rows, "name", "seq")


@query(f"""WITH {PAPERS_SQL}, c AS (SELECT paper_id AS id, sha256(title) AS h, {CORPUS_DOI} AS d FROM papers), o AS (SELECT id AS other_id, h, d FROM c),
m AS (SELECT a.id, (SELECT min(o.other_id) FROM o WHERE o.h = a.h AND o.other_id <> a.id) AS by_hash, (SELECT min(o.other_id) FROM o WHERE o.d = a.d AND a.d <> '' AND o.other_id <> a.id) AS by_doi FROM c a)
SELECT id, coalesce(by_hash, by_doi) AS other_id, CASE WHEN by_hash IS NOT NULL THEN 'hash' ELSE 'doi' END AS by FROM m WHERE coalesce(by_hash, by_doi) IS NOT NULL""")
def same_paper(spark, d):
    rows = papers(spark, d).select(F.col("paper_id").alias("id"), F.sha2("title", 256).alias("sha256"), "doi")
    return dedup.same_paper(rows, rows)


# --- records ------------------------------------------------------------------------

BEFORE = "source_type IS NOT NULL"


@query(f"""WITH {PAPERS_SQL} SELECT seq, CASE WHEN {BEFORE} AND trim(title) <> '' THEN title ELSE 'new ' || title END AS title, CASE WHEN {BEFORE} AND trim(coalesce(doi, '')) <> '' THEN doi ELSE '10.1/new' END AS doi,
CASE WHEN {BEFORE} AND journal <> '' THEN journal ELSE 'New Journal' END AS journal, CASE WHEN {BEFORE} AND coalesce(year, 0) <> 0 THEN year ELSE 2001 END AS year FROM papers""")
def keep_filled(spark, d):
    rows = papers(spark, d)
    new = rows.select("seq", "paper_id", F.concat(F.lit("new "), "title").alias("title"), F.lit("10.1/new").alias("doi"), F.lit("New Journal").alias("journal"), F.lit(2001).alias("year"), "authors")
    return metadata.keep_filled(new, rows.where(BEFORE), ["paper_id"]).select("seq", "title", "doi", "journal", "year")


@query(f"WITH {PAPERS_SQL} SELECT journal, max(seq) AS seq, arg_max(paper_id, seq) AS paper_id FROM papers GROUP BY journal")
def last_records(spark, d):
    return metadata.last_record(papers(spark, d), "journal", "seq").select("journal", "seq", "paper_id")


ID_YEAR = "TRY_CAST(nullif(regexp_extract(c.chunk_id, '(19\\d{2}|20[0-3]\\d)', 1), '') AS INT)"


@query(f"""WITH {PAPERS_SQL}, c AS (SELECT seq, year, CASE WHEN seq % 2 = 0 THEN paper_id ELSE 'stable_' || seq END AS chunk_id FROM papers)
SELECT c.chunk_id AS paper_id, coalesce(nullif(year, 0), {ID_YEAR}) AS year FROM c""")
def year_by_paper(spark, d):
    rows = papers(spark, d).withColumn("stable_id", F.concat(F.lit("stable_"), "seq"))
    chunks = rows.select(F.when(F.col("seq") % 2 == 0, F.col("paper_id")).otherwise(F.col("stable_id")).alias("paper_id"))
    return metadata.year_by_paper(chunks, rows.select("paper_id", "stable_id", "year", F.col("seq").alias("line_no")))


@query(f"""WITH {PAPERS_SQL}, p AS (SELECT * FROM papers WHERE n_references > 2), b AS (SELECT paper_id, 'Book ' || seq AS title, 1999 AS year FROM papers WHERE n_references < 4)
SELECT coalesce(p.paper_id, b.paper_id) AS paper_id, coalesce(p.title, b.title) AS title, coalesce(nullif(p.year, 0), b.year) AS year FROM p FULL JOIN b ON p.paper_id = b.paper_id""")
def overlay_books(spark, d):
    rows = papers(spark, d)
    books = rows.where("n_references < 4").select("paper_id", F.concat(F.lit("Book "), "seq").alias("title"), "authors", F.lit(1999).alias("year"))
    return metadata.overlay_books(rows.where("n_references > 2").select("paper_id", "title", "authors", "year"), books).select("paper_id", "title", "year")


PROVENANCE_DOI = "regexp_replace(regexp_replace(lower(trim(coalesce(doi, ''))), 'https?://(dx\\.)?doi\\.org/', '', 'g'), '/+$', '')"
METHOD_SQL = "CASE seq % 4 WHEN 0 THEN 'unpaywall' WHEN 1 THEN 'elsevier_specific' WHEN 2 THEN 'landing_page_pdf' ELSE 'other' END"


@query(f"""WITH {PAPERS_SQL}, g AS (SELECT {PROVENANCE_DOI} AS d, {METHOD_SQL} AS method, '2026-01-' || lpad((seq % 28 + 1)::VARCHAR, 2, '0') AS date FROM papers WHERE source_type = 'scopus'),
k AS (SELECT * FROM g WHERE d <> '' QUALIFY row_number() OVER (PARTITION BY d ORDER BY date DESC, method) = 1)
SELECT seq, CASE method WHEN 'unpaywall' THEN 'unpaywall' WHEN 'elsevier_specific' THEN 'elsevier_scraping' WHEN 'landing_page_pdf' THEN 'publisher_scraping' ELSE 'manual' END AS download_source,
CASE method WHEN 'unpaywall' THEN 'open_access' WHEN 'elsevier_specific' THEN 'institutional' ELSE 'unknown' END AS access_type, date AS download_date FROM papers LEFT JOIN k ON {PROVENANCE_DOI} = k.d""")
def download_provenance(spark, d):
    rows = papers(spark, d)
    method = F.expr("CASE seq % 4 WHEN 0 THEN 'unpaywall' WHEN 1 THEN 'elsevier_specific' WHEN 2 THEN 'landing_page_pdf' ELSE 'other' END")
    got = rows.where("source_type = 'scopus'").select("doi", method.alias("method"), F.expr("concat('2026-01-', lpad(cast(seq % 28 + 1 as string), 2, '0'))").alias("date"))
    return metadata.provenance(rows, got).select("seq", "download_source", "access_type", "download_date")


PLAIN_DOI = "regexp_replace(regexp_replace(trim(coalesce(doi, '')), '(?i)^https?://(dx\\.)?doi\\.org/', ''), '/+$', '')"
ASCII_TITLE = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH {PAPERS_SQL}, k AS (SELECT seq, {ASCII_TITLE} AS title_key, {PLAIN_DOI} AS doi FROM papers)
SELECT title_key, arg_min(doi, seq) AS doi, count(DISTINCT lower(doi)) > 1 AS conflicting FROM k WHERE title_key <> '' AND doi <> '' GROUP BY title_key""")
def title_table(spark, d):
    return metadata.title_table(papers(spark, d))


NAME_DOI = "nullif(regexp_replace(regexp_extract(pdf, '^(10\\.\\d{4,9}_\\S+)\\.pdf$', 1), '^([^_]*)_', '\\1/'), '')"


@query(f"""WITH {PAPERS_SQL}, f AS (SELECT *, CASE seq % 4 WHEN 0 THEN '10.1000_n' || seq || '.pdf' ELSE 'file ' || seq || '.pdf' END AS pdf FROM papers),
m AS (SELECT seq, lower(pdf) AS name, '10.5/m' || seq AS m_doi FROM f WHERE seq % 5 = 0),
t AS (SELECT {ASCII_TITLE} AS k, arg_min({PLAIN_DOI}, seq) AS t_doi FROM papers WHERE {PLAIN_DOI} <> '' AND source_type = 'manual' GROUP BY 1)
SELECT f.seq, coalesce(m_doi, t_doi, {NAME_DOI}) AS doi, CASE WHEN m_doi IS NOT NULL THEN 'manual_name' WHEN t_doi IS NOT NULL THEN 'csv_title' WHEN {NAME_DOI} IS NOT NULL THEN 'filename' END AS doi_source
FROM f LEFT JOIN m ON lower(pdf) = m.name LEFT JOIN t ON {ASCII_TITLE} = t.k""")
def doi_by_priority(spark, d):
    rows = papers(spark, d).withColumn("name", F.when(F.col("seq") % 4 == 0, F.concat(F.lit("10.1000_n"), "seq", F.lit(".pdf"))).otherwise(F.concat(F.lit("file "), "seq", F.lit(".pdf"))))
    manual = rows.where("seq % 5 = 0").select("name", F.lit("").alias("title"), F.concat(F.lit("10.5/m"), "seq").alias("doi"), "seq")
    titles = rows.where("source_type = 'manual'").select("title", "doi", "seq")
    return metadata.doi_by_priority(rows.select("seq", "name", "title", F.lit("no number here").alias("text")), manual, titles).select("seq", "doi", "doi_source")


@query("""WITH w AS (SELECT o_orderkey, '10.7/w' || o_orderkey AS doi, o_orderkey % 3 AS m, year(o_orderdate) AS y FROM orders)
SELECT doi, 'Work ' || o_orderkey AS title, 'Journal ' || m AS journal, CASE m WHEN 0 THEN y WHEN 1 THEN y + 1 END AS year, 'Family' || o_orderkey AS family FROM w""")
def read_works(spark, d):
    o, y = F.col("o_orderkey"), F.year("o_orderdate")
    when = lambda n: F.struct(F.array(F.array(n, F.lit(5))).alias("date-parts"))
    # Print comes before online, and a work may have neither.
    message = F.to_json(F.struct(F.array(F.concat(F.lit("Work "), o)).alias("title"), F.array(F.concat(F.lit("Journal "), o % 3)).alias("container-title"), F.when(o % 3 == 0, when(y)).alias("published-print"), F.when(o % 3 != 2, when(y + 1)).alias("published-online"), F.array(F.struct(F.concat(F.lit("Family"), o).alias("family"), F.lit("Given").alias("given"))).alias("author")))
    works = table(spark, d, "orders").select(F.concat(F.lit("10.7/w"), o).alias("doi"), message.alias("message"))
    return metadata.read_work(works).select("doi", "title", "journal", "year", F.get("authors", F.lit(0))["family"].alias("family"))


@query(f"""WITH {PAPERS_SQL} SELECT seq, title, {NAMES_SQL} AS authors, upper(left({LAST_SQL}, 1)) || lower(substr({LAST_SQL}, 2)) AS first_surname, journal, year,
CASE WHEN trim(coalesce(doi, '')) <> '' THEN 'https://doi.org/' || trim(doi) END AS doi_url FROM papers""")
def catalogue_rows(spark, d):
    rows = papers(spark, d)
    return metadata.catalogue(rows).join(rows.select("paper_id", "seq"), "paper_id").drop("paper_id")


@query(f"""WITH w AS (SELECT doc_id, len({WORDS_SQL}) AS n_words, 1 + length(coalesce(text, '')) // 1500 AS n_pages, coalesce(n_chars, 0) AS body_words FROM documents)
SELECT doc_id, CASE WHEN n_words < 1000 THEN 'short_text' WHEN n_words < 0.2 * body_words THEN 'low_ratio' WHEN n_words / greatest(1, n_pages) < 100 THEN 'low_density' END AS doubt,
CASE WHEN n_pages < 2 THEN 'few_pages' WHEN n_words < 500 THEN 'few_words' END AS rejection FROM w""")
def text_layer_doubts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.size(text.words("text")).alias("n_words"), (F.lit(1) + F.floor(F.length(F.coalesce("text", F.lit(""))) / 1500)).alias("n_pages"), F.coalesce("n_chars", F.lit(0)).alias("body_words"))
    return rows.select("doc_id", metadata.text_adequacy(rows.columns).alias("doubt"), metadata.pdf_rejection().alias("rejection"))


@query("SELECT event_id, event_id % 5 = 0 OR coalesce(date_diff('day', ts::DATE, DATE '2024-02-01') < 14, true) AS counts FROM events")
def cached_rows(spark, d):
    rows = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "no time").otherwise(F.col("ts").cast("string")).alias("ts"))
    return rows.select("event_id", metadata.cached("2024-02-01", 14).alias("counts"))


@query(f"""WITH {PAPERS_SQL}, s AS (SELECT seq, CASE WHEN seq % 10 = 0 THEN 'DUPLICATE' WHEN seq % 10 = 1 THEN 'error' ELSE 'ok' END AS status, CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 7 = 1 THEN 'irrelevant' ELSE category END AS category, CASE WHEN seq % 11 < 10 THEN (seq % 11) / 10.0 END AS confidence FROM papers)
SELECT seq, CASE WHEN status = 'DUPLICATE' THEN 'duplicates' WHEN status = 'error' OR category IS NULL OR category = 'irrelevant' OR coalesce(confidence, 0) < 0.6 THEN 'failed' ELSE category END AS route FROM s""")
def screening_routes(spark, d):
    s = F.col("seq")
    rows = papers(spark, d).select("seq", F.when(s % 10 == 0, "DUPLICATE").when(s % 10 == 1, "error").otherwise("ok").alias("status"), F.when(s % 7 == 0, None).when(s % 7 == 1, "irrelevant").otherwise(F.col("category")).alias("category"), F.when(s % 11 < 10, (s % 11) / 10.0).alias("confidence"))
    return rows.select("seq", metadata.screening_route().alias("route"))


# --- identifiers and texts ------------------------------------------------------------

SITES = ["https://www.ScienceDirect.com/science/article/pii/S", "https://link.springer.com/article/", "https://onlinelibrary.wiley.com/doi/", "https://www.tandfonline.com/doi/", "https://www.mdpi.com/", "https://example.org/"]


@query(f"""WITH u AS (SELECT page_id, {SITES}[page_id % 6 + 1] || lpad(page_id::VARCHAR, 16, '0') AS u FROM pages)
SELECT page_id, ['elsevier', 'springer', 'wiley', 'taylor_francis', 'mdpi', 'unknown'][page_id % 6 + 1] AS publisher, CASE WHEN page_id % 6 = 0 THEN 'S' || lpad(page_id::VARCHAR, 16, '0') END AS pii FROM u""")
def publishers(spark, d):
    url = F.concat(F.element_at(F.array(*map(F.lit, SITES)), (F.col("page_id") % 6 + 1).cast("int")), F.lpad(F.col("page_id").cast("string"), 16, "0"))
    rows = table(spark, d, "pages").select("page_id", url.alias("u"))
    return rows.select("page_id", ids.publisher("u").alias("publisher"), ids.pii("u").alias("pii"))


@query(f"""WITH {PAPERS_SQL} SELECT seq, {PROVENANCE_DOI} AS provenance, {PLAIN_DOI} AS extract_, CASE WHEN seq % 2 = 0 THEN '10.1000/f_' || seq END AS filename,
regexp_replace(regexp_replace(replace(coalesce(doi, ''), '/', '_'), '[\\x00-\\x1f\\x7f\\\\*?:"<>|]', '', 'g'), '^[ .]+|[ .]+$', '', 'g') AS file FROM papers""")
def doi_other_modes(spark, d):
    rows = papers(spark, d).withColumn("name", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("Title [10.1000_f_"), "seq", F.lit("].pdf"))).otherwise("plain.pdf"))
    return rows.select("seq", ids.doi("doi", "provenance").alias("provenance"), ids.doi("doi", "extract").alias("extract_"), ids.doi("name", "filename").alias("filename"), ids.doi_file(F.coalesce("doi", F.lit(""))).alias("file"))


NAME = "p_name || ' & ' || p_type || ', n. ' || p_brand || ' -- Étude/' || p_partkey"


@query(f"""WITH t AS (SELECT p_partkey, {NAME} AS x FROM part)
SELECT p_partkey, {key_sql("x")} AS key, regexp_replace(regexp_replace(lower(regexp_replace(x, '[\\s.,-]+', '_', 'g')), '_+', '_', 'g'), '^_+|_+$', '', 'g') AS stem,
regexp_replace(regexp_replace(trim(regexp_replace(replace(strip_accents(lower(x)), '&', ' and '), '[^a-z0-9\\s-]', ' ', 'g')), '[\\s-]+', '_', 'g'), '_+', '_', 'g') AS slug,
trim(regexp_replace(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS title_words, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS title_ascii, trim(regexp_replace(strip_accents(lower(x)), '\\s+', ' ', 'g')) AS title_fold,
trim(regexp_replace(regexp_replace(regexp_replace(x, '[<>:"/\\\\|?*]', '_', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '._ ') AS file_name, regexp_replace(regexp_replace(x, '[\\x00-\\x1f\\x7f\\\\/*?:"<>|]', '', 'g'), '[ .]+$', '') AS clean_name FROM t""")
def name_forms(spark, d):
    x = F.concat("p_name", F.lit(" & "), "p_type", F.lit(", n. "), "p_brand", F.lit(" -- Étude/"), "p_partkey")
    forms = {"key": text.key(x), "stem": text.stem(x), "slug": text.slug(x), "title_words": text.title_key(x), "title_ascii": text.title_key(x, "ascii"), "title_fold": text.title_key(x, "fold"), "file_name": text.file_name(x), "clean_name": text.clean_name(x)}
    return table(spark, d, "part").select("p_partkey", *(c.alias(n) for n, c in forms.items()))


NORM_SQL = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
ODD = "' ' || coalesce(text, '') || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || chr(9) || '  end' || chr(13)"


@query(f"SELECT doc_id, md5({NORM_SQL.format(x=ODD)}) AS space_md5, md5(trim(regexp_replace({ODD}, '\\s+', ' ', 'g'))) AS blank_md5 FROM documents")
def norm_spaces(spark, d):
    x = F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit("\r\n\n\n\n\t  end\r"))
    return table(spark, d, "documents").select("doc_id", F.md5(text.norm_space(x)).alias("space_md5"), F.md5(text.norm_blank(x)).alias("blank_md5"))


STOPWORDS = "[" + ", ".join(f"'{w}'" for w in text.TITLE_STOPWORDS) + "]"
TITLE_WORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"
SHORT = f"array_to_string(list_slice(list_filter({TITLE_WORDS}, lambda w: NOT list_contains({STOPWORDS}, w)), 1, 8), '_')"


@query(f"WITH {PAPERS_SQL} SELECT seq, coalesce(year::VARCHAR, '0000') || '_' || coalesce(nullif(trim(regexp_replace(lower({LAST_SQL}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknownauthor') || '_' || {SHORT} AS new_id FROM papers")
def made_ids(spark, d):
    return papers(spark, d).select("seq", ids.paper_id(F.col("year"), F.col("authors"), F.col("title")).alias("new_id"))


@query(f"WITH {PAPERS_SQL} SELECT seq, paper_id AS stem, lower(paper_id) = paper_id AND NOT regexp_matches(paper_id, '_10_\\d{{4,5}}_') AS clean, regexp_matches(paper_id, '^\\d{{4}}_[a-z0-9]+_.+') AS canonical FROM papers")
def stems(spark, d):
    rows = papers(spark, d).select("seq", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("/a/b/"), "paper_id", F.lit(".tei.xml"))).alias("tei_file"), F.concat("paper_id", F.lit(".pdf")).alias("source_pdf"))
    stem = ids.infer_stem(rows.columns)
    return rows.select("seq", stem.alias("stem"), ids.clean_stem(stem).alias("clean"), ids.canonical_name(stem).alias("canonical"))


# --- books and pages --------------------------------------------------------------------

TOC_SQL = """toc AS (SELECT conv_id, turn + 1 AS page, CASE WHEN (turn // 2) % 2 = 0 THEN 1 ELSE 2 END AS level, 'Part ' || turn AS title FROM conversations WHERE turn % 2 = conv_id % 2),
n AS (SELECT conv_id, max(turn) + 1 AS n_pages FROM conversations GROUP BY conv_id),
e AS (SELECT *, lead(page) OVER w AS next, min(page) OVER (PARTITION BY conv_id) AS first, max(CASE WHEN level = 1 THEN page END) OVER w AS top FROM toc JOIN n USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY page)),
s AS (SELECT e.conv_id, e.title, CASE WHEN e.level = 2 AND e.top IS NOT NULL THEN 'Part ' || (e.top - 1) || ' > ' ELSE '' END || e.title AS heading_path, e.page AS page_start, greatest(e.page, coalesce(e.next - 1, e.n_pages)) AS page_end FROM e
UNION ALL SELECT conv_id, 'Front matter', 'Front matter', 1, min(first) - 1 FROM e GROUP BY conv_id HAVING min(first) > 1
UNION ALL SELECT conv_id, conv_id::VARCHAR, conv_id::VARCHAR, 1, n_pages FROM n WHERE conv_id NOT IN (SELECT conv_id FROM toc))"""


@query(f"""WITH {TOC_SQL}, x AS (SELECT s.conv_id, s.title, heading_path, page_start, page_end, regexp_replace(regexp_replace(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t
FROM s JOIN conversations c ON c.conv_id = s.conv_id AND c.turn + 1 BETWEEN page_start AND page_end GROUP BY ALL) SELECT conv_id AS book_id, title, heading_path, page_start, page_end, md5(t) AS text_md5 FROM x WHERE t <> ''""")
def book_sections(spark, d):
    turns = table(spark, d, "conversations")
    book = turns.select(F.col("conv_id").alias("book_id"), (F.col("turn") + 1).cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    level = F.when(F.floor(F.col("turn") / 2) % 2 == 0, 1).otherwise(2)
    toc = turns.where("turn % 2 = conv_id % 2").select(F.col("conv_id").alias("book_id"), level.alias("level"), F.concat(F.lit("Part "), "turn").alias("title"), (F.col("turn") + 1).cast("int").alias("page"), F.col("turn").cast("int").alias("seq"))
    return pages.chapters(toc, book).select("book_id", "title", "heading_path", "page_start", "page_end", F.md5("text").alias("text_md5"))


@query(f"""WITH {PAPERS_SQL}, n AS (SELECT category, seq, count(*) OVER (PARTITION BY category) AS total FROM papers)
SELECT seq, CASE WHEN total >= 4 THEN '' ELSE 'Running Head ' || seq || ' ' END || 'The pump was operated at ' || seq || ' bar and stopped.' || chr(10) || chr(10) || 'Then it went on.' || CASE WHEN total >= 4 THEN '' ELSE chr(10) || chr(10) || '- Foot line -' END AS text FROM n""")
def clean_book_pages(spark, d):
    x = F.concat(F.lit("Running Head "), "seq", F.lit("\nThe pump was oper-\nated at "), "seq", F.lit(" bar\nand stopped.\nThen it went on.\n- Foot line -\n"), F.col("seq") % 1000)
    book = papers(spark, d).select(F.col("category").alias("book_id"), F.col("seq").alias("page"), x.alias("text"))
    return pages.clean_pages(book).select(F.col("page").alias("seq"), "text")


TITLES = ["Contents", "Index of names", "Appendix B", "Prefacio", "Chapter on ", "Anexos", "indices", "Appendicitis"]


@query(f"""WITH t AS (SELECT p_partkey, p_type AS book, CASE WHEN p_partkey % 8 = 4 THEN 'Chapter on ' || p_name ELSE {TITLES}[p_partkey % 8 + 1] END AS title FROM part)
SELECT book, count(*) FILTER (p_partkey % 8 IN (4, 7)) AS n_chapters, count(*) FILTER (p_partkey % 8 IN (0, 1, 3, 6)) AS n_front, count(*) FILTER (p_partkey % 8 IN (2, 5)) AS n_supplementary FROM t GROUP BY book""")
def chapter_counts(spark, d):
    k = (F.col("p_partkey") % 8).cast("int")
    title = F.concat(F.element_at(F.array(*map(F.lit, TITLES)), k + 1), F.when(k == 4, F.col("p_name")).otherwise(""))
    rows = table(spark, d, "part").select(F.col("p_type").alias("book"), pages.toc_title(F.concat(title, F.when(k == 0, ".PDF").otherwise(""))).alias("title"))
    marks = rows.groupBy("book").agg(F.count_if(pages.front_or_back("title")).alias("n_front"), F.count_if(pages.supplementary("title")).alias("n_supplementary"))
    return pages.count_chapters(rows, "book").join(marks, "book")


@query("""SELECT p_partkey, '97801234' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') || 'X' AS isbn, CASE WHEN 1850 + p_partkey % 300 BETWEEN 1900 AND 2100 THEN 1850 + p_partkey % 300 END AS copyright_year,
CASE WHEN p_partkey % 2 = 0 THEN 1990 + p_partkey % 30 END AS year, CASE WHEN p_partkey % 2 = 0 THEN 'Sur' || p_partkey END AS surname, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' Two' ELSE 'Sur' || p_partkey || ' ' || p_name || ' Two' END AS title FROM part""")
def book_names(spark, d):
    k = F.col("p_partkey")
    page = F.concat(F.lit("Copyright "), (F.lit(1850) + k % 300).cast("string"), F.lit(" by the press\nISBN-13: 978-0-1234-"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("-x"))
    name = F.concat(F.when(k % 2 == 0, F.concat((F.lit(1990) + k % 30).cast("string"), F.lit("-"))).otherwise(""), F.lit("Sur"), k.cast("string"), F.lit("_"), F.regexp_replace("p_name", " ", "_"), F.lit("_Two"))
    rows = table(spark, d, "part").select("p_partkey", page.alias("page"), pages.file_meta(name).alias("m"))
    return rows.select("p_partkey", pages.isbn("page").alias("isbn"), pages.copyright_year("page").alias("copyright_year"), "m.year", "m.surname", "m.title")


@query("""SELECT c_custkey, 'Anna Ruiz' || c_custkey || '; Bo de Vries' AS full_names, 'Ruiz' || c_custkey || ';Vries' AS surnames, 'Anna;Bo de' AS forenames FROM customer""")
def person_names(spark, d):
    raw = F.concat(F.lit(" Ruiz"), "c_custkey", F.lit(", Anna ; Bo de Vries"))
    rows = table(spark, d, "customer").select("c_custkey", pages.person_names(raw).alias("p"))
    joined = lambda f, sep: F.array_join(F.transform("p", lambda x: x[f]), sep)
    return rows.select("c_custkey", joined("full", "; ").alias("full_names"), joined("surname", ";").alias("surnames"), joined("forename", ";").alias("forenames"))


@query("""WITH b AS (SELECT l_returnflag || l_linestatus AS book, l_orderkey, l_linenumber, CASE WHEN l_quantity >= 49 THEN 20.0 WHEN l_quantity >= 47 THEN 16.0 WHEN l_quantity >= 45 THEN 14.0 WHEN l_quantity >= 43 THEN 13.0 WHEN l_quantity >= 40 THEN 11.0 ELSE 10.0 END AS size FROM lineitem)
SELECT book, CASE size WHEN 20.0 THEN 1 WHEN 16.0 THEN 2 ELSE 3 END AS level, count(*) AS n FROM b WHERE size >= 14 GROUP BY ALL""")
def font_headings(spark, d):
    size = F.expr("CASE WHEN l_quantity >= 49 THEN 20.0D WHEN l_quantity >= 47 THEN 16.04D WHEN l_quantity >= 45 THEN 13.96D WHEN l_quantity >= 43 THEN 13.0D WHEN l_quantity >= 40 THEN 11.0D ELSE 10.0D END")
    spans = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("book_id"), F.col("l_orderkey").alias("page"), F.lit(" a line of text ").alias("text"), size.alias("size"))
    return pages.headings_by_font(spans).groupBy(F.col("book_id").alias("book"), "level").agg(F.count("*").alias("n"))


# --- TEI and chunks -----------------------------------------------------------------------


def tei_papers(spark, d) -> DataFrame:
    """Papers as TEI: a header, an abstract, two sections, a table and a reference."""
    esc = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;")
    doi = F.coalesce(F.trim("doi"), F.lit(""))
    xml = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>'), esc(F.col("title")),
        F.lit('</title></titleStmt><sourceDesc><biblStruct><analytic><author><persName><forename>Maria</forename><surname>C  u s</surname></persName></author><author><persName><forename>Maria</forename><surname>Cus</surname></persName></author><idno type="DOI">'), esc(doi),
        F.lit('</idno></analytic><monogr><title level="j">'), esc(F.col("journal")), F.lit('</title><imprint><date when="'), F.coalesce(F.col("year").cast("string"), F.lit("")), F.lit('"/></imprint></monogr></biblStruct></sourceDesc></fileDesc><profileDesc><abstract><p>'),
        esc(F.col("abstract")), F.lit("</p></abstract></profileDesc></teiHeader><text><body><div><head>Materials</head><p>Made with \n  "), esc(F.col("category")), F.lit(".</p></div><div><head>References</head><p>none</p></div>"),
        F.lit('<figure type="table" xml:id="t'), F.col("seq"), F.lit('"><head>Counts</head><figDesc>By row</figDesc><table><row><cell>Exp.</cell><cell>n</cell></row><row><cell>a</cell><cell>'), F.col("n_references"), F.lit('</cell></row><row><cell></cell><cell>2</cell></row></table></figure>'),
        F.lit('</body><back><div><listBibl><biblStruct><analytic><title level="a">Cited '), F.col("seq"), F.lit('</title><author><persName><forename>Bo</forename><surname>Li</surname></persName></author><idno type="DOI">10.1/C'), F.col("seq"), F.lit('</idno></analytic><monogr><title level="j">Old Journal</title><imprint><date when="1987-05"/></imprint></monogr></biblStruct></listBibl></div></back></text></TEI>'),
    )
    return papers(spark, d).select(F.col("seq").cast("string").alias("paper_id"), xml.alias("tei_xml"))


TEI_YEAR = "CASE WHEN year >= 1900 THEN year ELSE 1987 END"


@query(f"""WITH {PAPERS_SQL} SELECT seq::VARCHAR AS paper_id, title, trim(coalesce(doi, '')) AS doi, journal, {TEI_YEAR.replace("1987", "NULL")} AS year, 'Maria Cus' AS authors, coalesce(abstract, '') AS abstract, 1 AS n_references FROM papers""")
def tei_metadata(spark, d):
    found = tei.read_tei(tei_papers(spark, d), ["title", "doi", "journal", "year", "authors", "abstract", "references"])
    return found.select("paper_id", "title", "doi", "journal", "year", F.array_join(F.transform("authors", lambda a: a["full"]), "; ").alias("authors"), "abstract", F.size("references").alias("n_references"))


@query(f"WITH {PAPERS_SQL} SELECT seq::VARCHAR AS paper_id, left(sha1('10.1/c' || seq), 12) AS ref_key, '10.1/C' || seq AS doi, 'Cited ' || seq AS title, 'Old Journal' AS container, 1987 AS year, 'Bo Li' AS authors FROM papers")
def tei_references(spark, d):
    r = tei.read_tei(tei_papers(spark, d), ["references"]).select("paper_id", F.explode("references").alias("r"))
    return r.select("paper_id", "r.ref_key", "r.doi", "r.title", "r.container", "r.year", F.array_join("r.authors", "; ").alias("authors"))


COVER_SQL = "'**Authors:** Maria Cus' || CASE WHEN year >= 1900 THEN chr(10) || chr(10) || '**Year:** ' || year ELSE '' END || CASE WHEN trim(coalesce(doi, '')) <> '' THEN chr(10) || chr(10) || '**DOI:** ' || trim(doi) ELSE '' END || chr(10) || chr(10)"


@query(f"""WITH {PAPERS_SQL}, c AS (SELECT seq, 'Abstract' AS section, 'abstract' AS canonical, {COVER_SQL} || abstract AS t, 1 AS k FROM papers WHERE abstract IS NOT NULL
UNION ALL SELECT seq, 'Materials', 'methods', CASE WHEN abstract IS NULL THEN {COVER_SQL} ELSE '' END || 'Made with ' || category || '.', 2 FROM papers
UNION ALL SELECT seq, 'Counts', 'table', '## Counts' || chr(10) || chr(10) || 'By row' || chr(10) || chr(10) || '| Exp. | n |' || chr(10) || '| a | ' || n_references || ' |' || chr(10) || '|  | 2 |', 3 FROM papers)
SELECT seq::VARCHAR AS paper_id, section, canonical AS section_canonical, row_number() OVER (PARTITION BY seq ORDER BY k) AS chunk_index, md5(t) AS text_md5 FROM c""")
def tei_chunks(spark, d):
    return chunking.chunk_articles(tei.read_tei(tei_papers(spark, d), ["markdown", "tables"])).select("paper_id", "section", "section_canonical", "chunk_index", F.md5("text").alias("text_md5"))


@query(f"""WITH t AS (SELECT doc_id, {STRIP.format(x="coalesce(text, '')")} AS t FROM documents) SELECT doc_id AS file, '__attachment__' AS paper_id, 1 AS chunk_index, md5(t) AS text_md5 FROM t WHERE length(t) >= 30""")
def attachment_chunks(spark, d):
    files = table(spark, d, "documents").select(F.col("doc_id").alias("file"), "text")
    return chunking.chunk_attachments(files).select("file", "paper_id", "chunk_index", F.md5("text").alias("text_md5"))


# --- lifecycle ------------------------------------------------------------------------------


@query(f"WITH {PAPERS_SQL} SELECT category, paper_id, CASE WHEN n_references > 3 THEN 'target' ELSE 'source' END AS origin FROM papers")
def merged_trees(spark, d):
    rows = papers(spark, d).select("category", "paper_id", "n_references")
    target, source = rows.where("n_references > 3").withColumn("origin", F.lit("target")), rows.withColumn("origin", F.lit("source"))
    return lifecycle.merge_tree(target.select("category", "paper_id", "origin"), source.select("category", "paper_id", "origin"), ["category", "paper_id"])


@query(f"""WITH {PAPERS_SQL} SELECT seq, CASE WHEN seq % 4 = 1 THEN 'Title ' || seq ELSE title END AS title, CASE WHEN seq % 4 = 2 THEN '' ELSE journal END AS journal, CASE WHEN seq % 4 < 2 THEN 2001 ELSE year END AS year, CASE WHEN seq % 4 = 3 THEN '' ELSE doi END AS doi FROM papers""")
def updated_fields(spark, d):
    rows, k = papers(spark, d), F.col("seq") % 4
    patches = rows.select("category", "paper_id", F.when(k == 1, F.concat(F.lit("Title "), "seq")).when(k == 2, "").alias("title"), F.when(k == 2, "").alias("journal"), F.when(k < 2, 2001).alias("year"), F.when(k == 3, "").alias("doi"))
    return lifecycle.update_fields(rows, patches).select("seq", "title", "journal", "year", "doi")


HAS = "n_references > 2", "abstract IS NOT NULL"


@query(f"WITH {PAPERS_SQL} SELECT category, paper_id, {HAS[0]} AS has_pdf, {HAS[1]} AS has_text, {HAS[0]} AND {HAS[1]} AS complete FROM papers")
def artefact_status(spark, d):
    rows = papers(spark, d)
    made = [rows.where(c).select("category", F.upper(F.replace("paper_id", F.lit("_"), F.lit(" - "))).alias("name")) for c in HAS]
    return lifecycle.status(rows, pdf=made[0], text=made[1])


@query(f"WITH {PAPERS_SQL} SELECT paper_id AS name, CASE WHEN {HAS[1]} THEN 'pdf' ELSE 'text' END AS missing FROM papers WHERE ({HAS[0]}) <> ({HAS[1]})")
def artefact_mismatches(spark, d):
    rows = papers(spark, d).withColumnRenamed("paper_id", "name")
    return lifecycle.mismatches(rows.where(HAS[0]).select("name"), rows.where(HAS[1]).select("name"))


@query(f"WITH {PAPERS_SQL} SELECT paper_id AS name FROM papers WHERE {HAS[0]} AND {HAS[1]} AND source_type IS NOT NULL")
def processable_tei(spark, d):
    rows = papers(spark, d).withColumnRenamed("paper_id", "name")
    return lifecycle.processable(rows.where("source_type IS NOT NULL").select("name"), rows.where(HAS[1]).select("name"), rows.where(HAS[0]).select("name"))


@query(f"""WITH {PAPERS_SQL}, w AS (SELECT DISTINCT {CORPUS_DOI} AS doi FROM papers WHERE source_type = 'scopus'), h AS (SELECT {CORPUS_DOI} AS doi, min(paper_id) AS name FROM papers WHERE n_references > 2 GROUP BY 1),
t AS (SELECT paper_id FROM papers WHERE seq % 3 = 0)
SELECT w.doi, h.name, CASE WHEN h.name IS NULL THEN 'not_found' WHEN h.name IN (SELECT paper_id FROM t) THEN 'existing' ELSE 'copied' END AS outcome FROM w LEFT JOIN h ON w.doi = h.doi WHERE w.doi <> ''""")
def copied_papers(spark, d):
    rows = papers(spark, d).withColumnRenamed("paper_id", "name")
    return lifecycle.copy_selected(rows.where("source_type = 'scopus'"), rows.where("n_references > 2"), rows.where("seq % 3 = 0"))


@query(f"""WITH {PAPERS_SQL}, g AS (SELECT {CORPUS_DOI} AS d FROM papers WHERE source_type = 'adhoc'), k AS (SELECT *, {CORPUS_DOI} AS d FROM papers),
f AS (SELECT d, min(category) AS category FROM k WHERE d <> '' AND d IN (SELECT d FROM g) GROUP BY d) SELECT seq FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.d = k.d AND f.category = k.category)""")
def purged_by_doi(spark, d):
    rows = papers(spark, d)
    return lifecycle.purge_by_doi(rows, rows.where("source_type = 'adhoc'")).select("seq")


@query(f"""WITH {PAPERS_SQL}, s AS (SELECT paper_id, {key_sql("paper_id")} AS k FROM papers), g AS (SELECT {key_sql("paper_id")} AS k FROM papers WHERE source_type = 'manual')
SELECT paper_id, CASE WHEN k IN (SELECT k FROM g) THEN 'moves' ELSE 'stays' END AS outcome FROM s""")
def split_sidecar(spark, d):
    rows = papers(spark, d)
    stays, moves = lifecycle.split_rows(rows.select("paper_id"), rows.where("source_type = 'manual'"), "paper_id")
    return stays.withColumn("outcome", F.lit("stays")).unionByName(moves.withColumn("outcome", F.lit("moves")))


@query("SELECT source || '/' || doc_id AS path, sha256(text) AS digest FROM documents WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 1)")
def changed_files(spark, d):
    files = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("text").alias("content"))
    same = files.join(table(spark, d, "labels"), "doc_id").select("path", F.when(F.col("quality") == 1, F.sha2("content", 256)).otherwise("older").alias("digest"))
    return lifecycle.changed_files(files, same)


# --- registry -------------------------------------------------------------------------------

GIVEN = "given AS (SELECT DISTINCT lower(trim(doi)) AS d FROM loose WHERE source_type IS NOT NULL AND doi <> '')"


@query(f"""WITH {PAPERS_SQL}, {LOOSE}, {REGISTRY_SQL}, {GIVEN} SELECT doi, CASE WHEN hit THEN 'downloaded' ELSE status END AS downloaded, CASE WHEN hit THEN '2028-01-02' ELSE snooze_until END AS snoozed, CASE WHEN hit THEN '' ELSE snooze_until END AS unsnoozed,
CASE WHEN hit AND status = 'blocked' THEN 'pending' ELSE status END AS unblocked FROM (SELECT *, doi IN (SELECT d FROM given) AS hit FROM reg)""")
def registry_changes(spark, d):
    old, rows = registry_parts(spark, d)
    given = rows.where("source_type IS NOT NULL").select(F.upper("doi").alias("doi"))
    out = old.select("doi")
    for name, changed, column in (("downloaded", registry.mark_downloaded(old, given, "2026-01-01"), "status"), ("snoozed", registry.snooze(old, given, "2026-01-02", 2), "snooze_until"), ("unsnoozed", registry.unsnooze(old, given), "snooze_until"), ("unblocked", registry.unblock(old, given, "2026-01-01"), "status")):
        out = out.join(changed.select("doi", F.col(column).alias(name)), "doi")
    return out


@query(f"""WITH {PAPERS_SQL}, {LOOSE}, {REGISTRY_SQL}, {GIVEN} SELECT doi, CASE WHEN doi IN (SELECT d FROM given) THEN 'blocked' ELSE status END AS status, CASE WHEN doi IN (SELECT d FROM given) THEN 'why' ELSE reason END AS reason, notes, snooze_until FROM reg
UNION ALL SELECT d, 'blocked', 'why', '{registry.BLOCKED}', '' FROM given WHERE d NOT IN (SELECT doi FROM reg)""")
def registry_block(spark, d):
    old, rows = registry_parts(spark, d)
    return registry.block(old, rows.where("source_type IS NOT NULL"), "2026-01-01", "why").select("doi", "status", "reason", "notes", "snooze_until")


@query(f"""WITH {PAPERS_SQL}, {LOOSE}, {REGISTRY_SQL}, b AS (SELECT doi FROM reg WHERE status = 'blocked'), c AS (SELECT doi FROM loose WHERE source_type = 'manual' AND doi <> '')
SELECT seq, CASE WHEN doi IN (SELECT doi FROM b) THEN 'blocked' WHEN doi IN (SELECT doi FROM c) THEN 'known' ELSE 'download' END AS plan FROM loose WHERE doi <> ''""")
def download_plan(spark, d):
    old, rows = registry_parts(spark, d)
    return registry.download_plan(rows, registry.blocked_dois(old), rows.where("source_type = 'manual'").select("doi")).select("seq", "plan")


@query(f"""WITH {PAPERS_SQL}, a AS (SELECT {CORPUS_DOI} AS doi, paper_id AS origin, 0 AS turn FROM papers WHERE source_type IS NOT NULL UNION ALL SELECT '10.1000/x' || (seq // 2), '10.1000_X' || (seq // 2) || '.pdf', 1 FROM papers)
SELECT doi, origin FROM a WHERE doi <> '' QUALIFY row_number() OVER (PARTITION BY doi ORDER BY turn, origin) = 1""")
def doi_origins(spark, d):
    rows = papers(spark, d)
    names = rows.select(F.concat(F.lit("10.1000_X"), F.floor(F.col("seq") / 2), F.lit(".pdf")).alias("name"))
    return registry.doi_origins(rows.where("source_type IS NOT NULL").select("doi", F.col("paper_id").alias("origin")), names)


@query(f"WITH {PAPERS_SQL} SELECT DISTINCT doi FROM (SELECT {CORPUS_DOI} AS doi FROM papers WHERE source_type IS NOT NULL UNION ALL SELECT '10.1000/x' || (seq // 2) FROM papers) WHERE doi <> ''")
def known_dois(spark, d):
    rows = papers(spark, d)
    names = rows.select(F.concat(F.lit("10.1000_X"), F.floor(F.col("seq") / 2), F.lit(".pdf")).alias("name"))
    return registry.known_dois(rows.where("source_type IS NOT NULL"), names)


@query(f"""WITH {PAPERS_SQL}, {LOOSE}, {REGISTRY_SQL}, o AS (SELECT *, CASE seq % 3 WHEN 0 THEN 'downloaded' WHEN 1 THEN 'no_pdf' ELSE 'pending' END AS outcome FROM loose WHERE doi <> ''),
done AS (SELECT DISTINCT doi FROM o WHERE outcome = 'downloaded'), failed AS (SELECT doi, arg_max(outcome, seq) AS reason FROM o WHERE outcome <> 'downloaded' GROUP BY doi)
SELECT coalesce(reg.doi, failed.doi) AS doi, CASE WHEN coalesce(reg.doi, failed.doi) IN (SELECT doi FROM done) THEN 'downloaded' ELSE coalesce(status, 'pending') END AS status,
CASE WHEN failed.doi IS NOT NULL AND (reg.doi IS NULL OR status = 'pending') THEN failed.reason ELSE reg.reason END AS reason FROM reg FULL JOIN failed ON reg.doi = failed.doi""")
def download_feedback(spark, d):
    old, rows = registry_parts(spark, d)
    rows = rows.withColumn("row_id", F.col("seq"))
    outcomes = rows.where("seq % 3 < 2").select("row_id", F.when(F.col("seq") % 3 == 0, "downloaded").otherwise("no_pdf").alias("status"), F.lit("unpaywall").alias("method"))
    return registry.feed_back(old, registry.with_outcome(rows, outcomes), "2026-01-01").select("doi", "status", "reason")


@query(f"""WITH {PAPERS_SQL}, p AS (SELECT category, count(*) AS n_papers FROM papers WHERE n_references > 0 GROUP BY 1), c AS (SELECT source AS category, count(*) AS n_chunks FROM documents GROUP BY 1),
i AS (SELECT 'label ' || label AS category, count(*) AS n_vectors, array_to_string(list_sort(list_distinct(list('m' || vec_id % 3))), ',') AS models FROM embeddings GROUP BY 1)
SELECT category, coalesce(n_papers, 0) AS n_papers, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_vectors, 0) AS n_vectors, coalesce(models, '') AS models FROM p FULL JOIN c USING (category) FULL JOIN i USING (category)""")
def category_listing(spark, d):
    index = table(spark, d, "embeddings").select(F.concat(F.lit("label "), "label").alias("category"), F.concat(F.lit("m"), F.col("vec_id") % 3).alias("model"))
    return rollups.listing(papers(spark, d).where("n_references > 0"), table(spark, d, "documents").select(F.col("source").alias("category")), index)


@query("SELECT 'documents' AS origin, doc_id AS id, n_chars, NULL AS turn FROM documents UNION ALL SELECT 'conversations', conv_id, NULL, turn FROM conversations UNION ALL SELECT 'benchmark', item_id, NULL, NULL FROM benchmark")
def concat_with_lineage(spark, d):
    docs, turns, items = table(spark, d, "documents"), table(spark, d, "conversations"), table(spark, d, "benchmark")
    frames = {"documents": docs.select(F.col("doc_id").alias("id"), "n_chars"), "conversations": turns.select(F.col("conv_id").alias("id"), "turn"), "benchmark": items.select(F.col("item_id").alias("id"))}
    return metadata.concat_with_lineage(frames)


# --- validation -----------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey, c_custkey % 4 AS n, c_custkey % 3 = 0 AS series FROM customer) SELECT c_custkey, n >= 3 OR (series AND n >= 2) AS editors FROM c""")
def editors_as_authors(spark, d):
    k = F.col("c_custkey")
    one = lambda i, name: F.struct(F.concat(F.lit("A. "), F.when(k % 4 > i, name).otherwise(F.concat(F.lit("Else"), F.lit(i)))).alias("full"), F.lit("").alias("forename"), F.lit("").alias("surname"))
    authors = F.array(*(one(i, n) for i, n in enumerate(("Varbanov", "Lam", "Tan"))))
    rows = table(spark, d, "customer").select("c_custkey", authors.alias("authors"), F.when(k % 3 == 0, "10.3303/CET1").otherwise("10.1/x").alias("doi"), F.lit("A title").alias("title"), F.lit("").alias("journal"), F.lit(2000).alias("year"))
    return rows.select("c_custkey", F.exists(validation.issues(2025), lambda x: x["code"] == "authors_editors").alias("editors"))


RATIO_SQL = "CASE c_custkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'none' WHEN 2 THEN 'title_mismatch' ELSE 'authors_mismatch' END"


@query(f"SELECT c_custkey, {RATIO_SQL} AS code FROM customer")
def compare_by_blocks(spark, d):
    k = F.col("c_custkey")
    title = F.concat(F.lit("Effects of pressure on the yield of reactors with number "), k)
    who = F.array(F.struct(F.lit("Eva Marín").alias("full"), F.lit("Eva").alias("forename"), F.lit("Marín").alias("surname")))
    rows = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("p"), k).alias("paper_id"), title.alias("title"), F.lit("A Journal").alias("journal"), F.lit(2000).alias("year"), who.alias("authors"), F.concat(F.lit("10.1000/c"), k).alias("doi"))
    their = F.when(k % 4 == 1, F.concat(title, F.lit("s"))).when(k % 4 == 2, "Another work on something else").otherwise(title)
    names = F.when(k % 4 == 3, F.array(F.struct(F.lit("Okafor").alias("family"), F.lit("I").alias("given")))).otherwise(F.array(F.struct(F.lit("Marín").alias("family"), F.lit("E").alias("given"))))
    lookup = rows.select(F.lower("doi").alias("doi"), their.alias("title"), "journal", F.lit(None).cast("string").alias("journal_short"), "year", names.alias("authors"))
    found = validation.compare(rows, lookup)
    return found.select("c_custkey", F.coalesce(F.nullif(F.array_join("found.code", ","), F.lit("")), F.lit("none")).alias("code"))


FIELD = "CASE seq % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'year' ELSE 'doi' END"


@query(f"""WITH {PAPERS_SQL}, o AS (SELECT category, paper_id, {FIELD} AS field FROM papers WHERE n_references > 2), n AS (SELECT category, paper_id, {FIELD} AS field FROM papers WHERE n_references < 5)
SELECT category, paper_id, field, '2026-01-01' AS date, 'new' AS note FROM n UNION ALL SELECT *, '2025-01-01', 'old' FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.paper_id = o.paper_id AND n.category = o.category AND n.field = o.field)""")
def dismissed_marks(spark, d):
    rows = papers(spark, d).withColumn("field", F.expr(FIELD))
    old = rows.where("n_references > 2").select("category", "paper_id", "field", F.lit("2025-01-01").alias("date"), F.lit("old").alias("note"))
    return validation.dismiss(old, rows.where("n_references < 5").withColumn("note", F.lit("new")), "2026-01-01")


@query(f"""WITH {PAPERS_SQL}, o AS (SELECT category, seq, paper_id, {FIELD} AS field FROM papers WHERE n_references > 2)
SELECT category, CASE WHEN seq % 4 = 0 THEN 'new_' || seq ELSE paper_id END AS paper_id, field FROM o WHERE seq % 5 <> 0""")
def renamed_marks(spark, d):
    rows = papers(spark, d).withColumn("field", F.expr(FIELD))
    old = rows.where("n_references > 2").select("category", "paper_id", "field", F.lit("").alias("date"), F.lit("").alias("note"))
    left = validation.undismiss(old, rows.where("seq % 5 = 0"))
    renames = rows.where("seq % 4 = 0").select(F.col("paper_id").alias("old_id"), F.concat(F.lit("new_"), "seq").alias("new_id"))
    return validation.rename_overrides(left, renames).select("category", "paper_id", "field")


@query(f"""WITH {PAPERS_SQL} SELECT seq, CASE WHEN field NOT IN ('title', 'year') THEN false WHEN seq % 2 = 0 THEN field = 'title' ELSE field = 'year' END AS stale FROM (SELECT seq, {FIELD} AS field FROM papers)""")
def stale_issues(spark, d):
    # With a suggestion: taken for titles only. Without: years have changed, titles not.
    even, field = F.col("seq") % 2 == 0, F.expr(FIELD)
    suggested = F.when(even, F.when(field == "title", "Kept").otherwise("1990"))
    current = F.when(field == "title", "Kept").otherwise("2001")
    snapshot = F.when(field == "title", " Kept ").otherwise("2000")
    return papers(spark, d).select("seq", validation.stale(field, suggested, current, snapshot).alias("stale"))


# --- exports and citations ------------------------------------------------------------------

RIS_SQL = f"""'TY  - JOUR' || chr(10) || 'TI  - ' || title || chr(10) || CASE WHEN {FULL_SQL} <> '' THEN 'AU  - ' || {FULL_SQL} || chr(10) ELSE '' END || CASE WHEN journal <> '' THEN 'JO  - ' || journal || chr(10) ELSE '' END || CASE WHEN year IS NOT NULL THEN 'PY  - ' || year || chr(10) ELSE '' END
|| CASE WHEN doi <> '' THEN 'DO  - ' || doi || chr(10) || 'UR  - https://doi.org/' || doi || chr(10) ELSE '' END || CASE WHEN coalesce(abstract, '') <> '' THEN 'AB  - ' || abstract || chr(10) ELSE '' END || 'ER  -' || chr(10)"""


@query(f"WITH {PAPERS_SQL}, {LOOSE} SELECT paper_id, md5({RIS_SQL}) AS entry_md5 FROM loose")
def ris_export(spark, d):
    return exports.ris(loose_papers(spark, d)).select("paper_id", F.md5("entry").alias("entry_md5"))


@query(f"""WITH {PAPERS_SQL} SELECT paper_id, '' AS stable_id, title, {FULL_SQL} AS authors, journal, coalesce(year::VARCHAR, '') AS year, coalesce(doi, '') AS doi, n_references::VARCHAR AS n_references, '' AS quality_score, coalesce(abstract, '') AS abstract FROM papers""")
def csv_export(spark, d):
    return exports.csv_rows(papers(spark, d))


DASH = "coalesce(nullif(trim({x}), ''), '—')"


@query(f"""WITH {PAPERS_SQL}, {LOOSE} SELECT seq AS n, md5('## [' || seq || '] `' || paper_id || '`' || chr(10) || chr(10) || '- **Título:** ' || title || chr(10) || '- **Autores:** ' || {DASH.format(x=NAMES_SQL)} || chr(10) || '- **Año:** ' || coalesce(year::VARCHAR, regexp_extract(paper_id, '(19\\d{{2}}|20[0-3]\\d)', 1)) || chr(10)
|| '- **Revista:** ' || {DASH.format(x="journal")} || chr(10) || '- **DOI:** ' || CASE WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE '—' END || chr(10) || '- **paper_id:** `' || paper_id || '`' || chr(10) || '- **Sección:** ? (canónica: results)' || chr(10) || '- **Tipo:** text' || chr(10)
|| '- **score:** ' || format('{{:.4f}}', n_references / 8.0) || chr(10) || chr(10) || '**Texto:**' || chr(10) || CASE WHEN seq % 2 = 0 THEN '~~~~~' ELSE '~~~' END || chr(10) || CASE WHEN seq % 2 = 0 THEN 'a ~~~~ b' ELSE 'plain' END || chr(10) || CASE WHEN seq % 2 = 0 THEN '~~~~~' ELSE '~~~' END || chr(10) || chr(10) || '---' || chr(10)) AS markdown_md5 FROM loose""")
def markdown_bundle(spark, d):
    rows = loose_papers(spark, d)
    found = rows.select(F.col("seq").alias("n"), "paper_id", F.lit(None).cast("string").alias("section"), F.lit("results").alias("section_canonical"), F.lit("text").alias("type"), (F.col("n_references") / 8.0).alias("score"), F.when(F.col("seq") % 2 == 0, " a ~~~~ b ").otherwise("plain").alias("text"))
    return exports.bundle(found, rows).select("n", F.md5("markdown").alias("markdown_md5"))


@query(f"""WITH {PAPERS_SQL}, f AS (SELECT CASE seq % 3 WHEN 0 THEN upper(paper_id) || '.PDF' WHEN 1 THEN 'stable-' || seq || '.pdf' ELSE left(paper_id, 20) || '-' || seq || '.pdf' END AS file FROM papers),
s AS (SELECT file, lower(regexp_replace(file, '(?i)\\.pdf$', '')) AS s FROM f), b AS (SELECT left(s, 20) AS c, min(file) AS file FROM s GROUP BY 1)
SELECT p.paper_id, coalesce(s1.file, s2.file, b.file) AS file FROM papers p LEFT JOIN s s1 ON s1.s = lower(p.paper_id) LEFT JOIN s s2 ON s2.s = 'stable-' || p.seq LEFT JOIN b ON b.c = left(lower(p.paper_id), 20) WHERE coalesce(s1.file, s2.file, b.file) IS NOT NULL""")
def found_pdfs(spark, d):
    rows = papers(spark, d).withColumn("stable_id", F.concat(F.lit("Stable-"), "seq"))
    name = F.when(F.col("seq") % 3 == 0, F.concat(F.upper("paper_id"), F.lit(".PDF"))).when(F.col("seq") % 3 == 1, F.concat(F.lit("stable-"), "seq", F.lit(".pdf"))).otherwise(F.concat(F.substring("paper_id", 1, 20), F.lit("-"), "seq", F.lit(".pdf")))
    return exports.find_pdf(rows, rows.select(name.alias("name")))


@query(f"WITH {PAPERS_SQL} SELECT paper_id, CASE WHEN source_type = 'manual' THEN 'not found' ELSE title END AS title FROM papers")
def resolved_ids(spark, d):
    rows = papers(spark, d)
    return exports.resolved(rows.select("paper_id"), rows.where("NOT (source_type <=> 'manual')"))


CITED = lambda n: f"CASE {n} WHEN 1 THEN 'A' || conv_id WHEN 3 THEN 'B' END"


@query(f"""WITH k AS (SELECT *, list_filter([{CITED("turn % 4")}, {CITED("conv_id % 7")}], lambda x: x IS NOT NULL) AS k FROM conversations)
SELECT conv_id, turn, coalesce(text, '') || ' ' || CASE WHEN len(k) > 0 THEN '(' || array_to_string(k, '; ') || ')' ELSE '[' || (turn % 4) || '] [' || (conv_id % 7) || ']' END || ', (B).' AS answer FROM k""")
def applied_citations(spark, d):
    """Whole turns with numbers of their own: two that share a bracket, some of them unknown, and one by itself."""
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" ["), F.col("turn") % 4, F.lit("] ["), F.col("conv_id") % 7, F.lit("], [3].\n\nReferences:\n[1] a list"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", said.alias("answer"))
    who = turns.select("conv_id").distinct()
    context = who.select("conv_id", F.lit(1).alias("n"), F.concat(F.lit("(A"), "conv_id", F.lit(")")).alias("cite")).unionByName(who.select("conv_id", F.lit(3).alias("n"), F.lit("(B)").alias("cite")))
    return citations.apply_citations(turns, context, "conv_id").select("conv_id", "turn", "answer")


@query(f"""WITH {PAPERS_SQL}, y AS (SELECT *, coalesce(year::VARCHAR, regexp_extract(paper_id, '(19\\d{{2}}|20[0-3]\\d)', 1)) AS y FROM papers)
SELECT seq, CASE seq % 3 WHEN 0 THEN '(' || coalesce(nullif('Note ' || seq % 2, 'Note 0'), 'Doc' || seq) || '; adjunto)' WHEN 1 THEN '(Vega, 1998; adjunto)' ELSE '(file' || seq || '; adjunto)' END AS attachment,
'Vega (' || y || '), ' || title || ', cap. ' || (seq % 9) || ', p. 3-' || (seq % 5 + 4) AS book FROM y""")
def other_cite_keys(spark, d):
    s = F.col("seq")
    name = F.when(s % 3 == 0, F.concat(F.lit("Doc"), s, F.lit(".pdf"))).when(s % 3 == 1, "1998_vega_notes.pdf").otherwise(F.concat(F.lit("a/file"), s, F.lit(".docx")))
    label = F.when((s % 3 == 0) & (s % 2 == 1), F.concat(F.lit(" Note "), s % 2))
    people = F.array(F.struct(F.lit("Eva Vega").alias("full"), F.lit("Eva").alias("forename"), F.lit("vega").alias("surname")))
    rows = papers(spark, d).withColumns({"name": name, "label": label, "people": people, "heading": F.concat((s % 9).cast("string"), F.lit(" Flow > Part")), "a": F.lit(3), "b": (s % 5 + 4).cast("int")})
    book = citations.book_key(F.col("paper_id"), F.col("people"), F.col("year"), F.col("title"), F.col("heading"), F.lit(None).cast("string"), F.col("a"), F.col("b"))
    return rows.select("seq", citations.attachment_key(F.col("name"), F.col("label")).alias("attachment"), book.alias("book"))


@query("""WITH u AS (SELECT event_id, user_id % 3 AS m, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), c AS (SELECT event_id, (coalesce(k, 0) * CASE m WHEN 0 THEN 300.0 WHEN 1 THEN 2.5 ELSE 0 END + 1000 * CASE m WHEN 0 THEN 16.0 ELSE 0 END) / 1e6 AS usd FROM u)
SELECT event_id, round(usd, 9) AS usd, CASE WHEN usd = 0 THEN 'gratis' WHEN usd < 0.01 THEN '< $0.01' ELSE '$' || format('{:.2f}', usd) END AS shown FROM c""")
def model_costs(spark, d):
    m, tokens = F.col("user_id") % 3, F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(0))
    usd = citations.cost(tokens, F.lit(1000), F.when(m == 0, 300.0).when(m == 1, 2.5), F.when(m == 0, 16.0))
    return table(spark, d, "events").select("event_id", F.round(usd, 9).alias("usd"), citations.shown_cost(usd).alias("shown"))


# --- evaluation, screening, roll-ups ----------------------------------------------------------


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'q' || turn END AS q, 'p' || (turn % 5) AS item, ['x', ' SI ', 'no', '', 'yes'][(conv_id + turn) % 5 + 1] AS mark FROM conversations),
c AS (SELECT *, last_value(q IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS qid FROM l)
SELECT conv_id || '/' || qid AS qid, array_to_string(list_sort(list_distinct(list(item))), ',') AS relevant FROM c WHERE lower(trim(mark)) IN ('x', 'si', 'yes') AND qid IS NOT NULL GROUP BY 1""")
def golden_sets(spark, d):
    mark = F.element_at(F.array(*map(F.lit, ["x", " SI ", "no", "", "yes"])), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    lines = table(spark, d, "conversations").select(F.col("conv_id").alias("review"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", F.concat("conv_id", F.lit("/q"), "turn")).alias("qid"), F.concat(F.lit("p"), F.col("turn") % 5).alias("item"), mark.alias("mark"))
    marked = evaluation.reviewed(lines).where("qid IS NOT NULL")
    known = lines.select("item").distinct()
    return evaluation.golden(marked, known).select("qid", F.array_join("relevant", ",").alias("relevant"))


@query(f"""WITH {PAPERS_SQL}, s AS (SELECT paper_id AS name, CASE WHEN seq % 2 = 0 THEN '10.1/s' || seq ELSE '' END AS doi, '2025-01-01' AS added, seq FROM papers WHERE n_references > 2)
SELECT CASE WHEN seq % 3 = 0 THEN 'new_' || seq ELSE name END AS name, CASE WHEN seq % 3 = 0 AND doi = '' THEN '10.1/r' || seq ELSE doi END AS doi, added FROM s
UNION ALL SELECT CASE WHEN seq % 3 = 0 THEN 'new_' || seq ELSE paper_id END, CASE WHEN seq % 3 = 0 THEN '10.1/r' || seq ELSE '' END, CASE WHEN source_type IS NOT NULL THEN '2026-01-01' ELSE '2026-02-02' END FROM papers WHERE n_references <= 2 AND (source_type IS NOT NULL OR seq % 3 = 0)""")
def doi_sheet(spark, d):
    rows = papers(spark, d).withColumnRenamed("paper_id", "name")
    sheet = rows.where("n_references > 2").select("name", F.when(F.col("seq") % 2 == 0, F.concat(F.lit("10.1/s"), "seq")).otherwise("").alias("doi"), F.lit("2025-01-01").alias("added"))
    grown = screening.append_missing(sheet, rows.where("source_type IS NOT NULL"), "2026-01-01")
    renamed = rows.where("seq % 3 = 0").select(F.col("name").alias("original"), F.concat(F.lit("new_"), "seq").alias("new"), F.concat(F.lit("10.1/r"), "seq").alias("doi"))
    return screening.update_renamed(grown, renamed, "2026-02-02")


@query(f"""WITH {PAPERS_SQL} SELECT seq, CASE WHEN seq % 4 = 0 THEN 'one' WHEN seq % 3 = 0 THEN 'two' WHEN abstract IS NOT NULL THEN abstract END AS value, CASE WHEN seq % 4 = 0 THEN 'first' WHEN seq % 3 = 0 THEN 'second' WHEN abstract IS NOT NULL THEN 'third' END AS method FROM papers""")
def download_cascade(spark, d):
    rows = papers(spark, d).withColumns({"a": F.when(F.col("seq") % 4 == 0, "one").otherwise(" "), "b": F.when(F.col("seq") % 3 == 0, " two")})
    value, method = screening.first_success([("first", "a"), ("second", "b"), ("third", "abstract")])
    return rows.select("seq", value.alias("value"), method.alias("method"))


@query("""WITH m AS (SELECT DISTINCT 'gemini-' || (p_size % 3 + 1) || CASE WHEN p_size % 2 = 0 THEN '.5' ELSE '' END || '-flash' || CASE WHEN p_size % 5 = 0 THEN '-lite' WHEN p_size % 5 = 1 THEN '-image' ELSE '' END AS name, p_size % 3 + 1 + CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 0 END AS v FROM part WHERE p_size % 5 <> 1)
SELECT name, row_number() OVER (ORDER BY v DESC, length(name), name) AS rank FROM m""")
def chat_models(spark, d):
    s = F.col("p_size")
    name = F.concat(F.lit("models/gemini-"), (s % 3 + 1).cast("string"), F.when(s % 2 == 0, ".5").otherwise(""), F.lit("-flash"), F.when(s % 5 == 0, "-lite").when(s % 5 == 1, "-image").otherwise(""))
    return screening.chat_models(table(spark, d, "part").select(name.alias("id")))


PAGES = """CASE doc_id % 4 WHEN 0 THEN 'A study of ' || lang || chr(10) || 'x' || chr(10) || 'by some people' || chr(10) || ' ABSTRACT ' || chr(10) || t || chr(10) || chr(10) || 'Keywords: none'
WHEN 1 THEN '2020 Elsevier' || chr(10) || 'short' || chr(10) || t || chr(10) || 'Introduction' || chr(10) || t WHEN 2 THEN t || chr(10) || 'Resumen' || chr(10) || 'Too little.' || chr(10) || chr(10) || 'Keywords' ELSE '' END"""
# The rules of ``screening`` in RE2, which knows white space, letters and digits beyond ASCII by their classes only.
SPACE, WORD = "[\\t-\\r\\x{85}\\p{Z}]", "\\p{L}\\p{M}\\p{Nd}\\p{Pc}"
TRIMMED = f"regexp_replace({{x}}, '^{SPACE}+|{SPACE}+$', '', 'g')"
TITLE_END = f"(?i)^{SPACE}*(abstract|resumen|keywords?|palabras{SPACE}+clave|introduction|introducción|doi([^{WORD}]|$))"
SECTION = f"(?i)^{SPACE}*(keywords?|palabras{SPACE}+clave|introduction|introducción|highlights?|graphical{SPACE}+abstract|1(\\.|{SPACE}){SPACE}*[{WORD}])"
ABSTRACT_END = f"(?im)\\n{SPACE}*\\n|^{SPACE}*(keywords?|introduction|1(\\.|{SPACE}){SPACE}*[{WORD}]|©|highlights?)"
HEADER = f"(?i)^{SPACE}*(\\p{{Nd}}{{4}}|vol\\.?{SPACE}*\\p{{Nd}}+|doi{SPACE}*:|https?://|received{SPACE}*:|accepted{SPACE}*:|available{SPACE}+online|©|issn([^{WORD}]|$)|elsevier|springer|wiley|mdpi|taylor{SPACE}*&|[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,4}})"
JOINED = lambda xs, most: f"coalesce(list_reduce({xs}, lambda a, x: CASE WHEN length(a) > {most} THEN a WHEN a = '' THEN x ELSE a || ' ' || x END, ''), '')"
FIRST = lambda xs, test: f"coalesce(list_position(list_transform({xs}, lambda x: {test}), true), 0)"


@query(f"""WITH d AS (SELECT doc_id, lang, replace(trim(coalesce(text, '')), '. ', '.' || chr(10)) AS t FROM documents), p AS (SELECT doc_id, coalesce({PAGES}, '') AS page FROM d),
l AS (SELECT doc_id, page, list_filter(list_transform(string_split(page, chr(10)), lambda x: {TRIMMED.replace("{x}", "x")}), lambda x: x <> '') AS l, regexp_split_to_array(page, '(?im)^[ \\t]*(abstract|resumen)[ \\t]*$') AS parts FROM p),
c AS (SELECT *, l[1:12] AS f, substr(page, length(parts[1]) + length(regexp_extract(page, '(?im)^[ \\t]*(abstract|resumen)[ \\t]*$')) + 1) AS body, {FIRST("l[1:12]", f"regexp_matches(x, '{TITLE_END}')")} AS ti, {FIRST("l", f"regexp_matches(x, '{SECTION}')")} AS si FROM l),
e AS (SELECT *, list_filter(CASE WHEN ti = 0 THEN f ELSE f[1:ti - 1] END, lambda x: length(x) >= 4)[1:4] AS title_lines, CASE WHEN si = 0 THEN l ELSE l[1:si - 1] END AS before FROM c),
g AS (SELECT *, {FIRST("before", f"NOT regexp_matches(x, '{HEADER}') AND length(x) >= 45")} AS di,
 CASE WHEN len(parts) > 1 THEN {TRIMMED.replace("{x}", f"regexp_split_to_array(substr(body, 1, 2000), '{ABSTRACT_END}')[1]")} END AS cut, CASE WHEN len(parts) > 1 THEN regexp_matches(substr(body, 1, 2000), '{ABSTRACT_END}') END AS ended FROM e),
h AS (SELECT *, CASE WHEN ended THEN cut ELSE {TRIMMED.replace("{x}", "substr(body, 1, 1500)")} END AS found FROM g)
SELECT doc_id AS name, {JOINED("title_lines", 350)} AS title, CASE WHEN len(parts) > 1 AND length(found) > 80 THEN substr(found, 1, 1500)
 ELSE coalesce(nullif(substr({JOINED("CASE WHEN di = 0 THEN [] ELSE before[di:] END", 1400)}, 1, 1500), ''), {TRIMMED.replace("{x}", "substr(page, 1, 500)")}) END AS abstract FROM h""")
def first_pages(spark, d):
    """Titles and abstracts of pages made of whole documents: with a heading, after a journal's header, with too little under a heading, and empty."""
    rows = table(spark, d, "documents").withColumn("t", F.replace(F.trim(F.coalesce("text", F.lit(""))), F.lit(". "), F.lit(".\n"))).withColumn("page", F.expr(PAGES.replace("chr(", "char(")))
    return screening.title_and_abstract(rows.select(F.col("doc_id").alias("name"), F.col("page").alias("first_page"), F.col("page").alias("pages")))


@query("SELECT event_type AS status, CASE WHEN user_id % 3 = 0 THEN 'none' ELSE 'm' || (user_id % 3) END AS method, count(*) AS n FROM events GROUP BY ALL")
def download_stats(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("status"), F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("m"), F.col("user_id") % 3)).alias("method"))
    return rollups.download_stats(rows)


@query(f"""WITH {PAPERS_SQL}, k AS (SELECT category, array_to_string(list_slice(list(paper_id ORDER BY seq), 1, 6), ', ') AS keywords FROM papers GROUP BY category)
SELECT category, count(*) AS n_papers, min(year) || '-' || max(year) AS period, keywords FROM papers JOIN k USING (category) GROUP BY category, keywords""")
def corpus_headers(spark, d):
    rows = papers(spark, d)
    return rollups.corpus_header(rows, rows.select("category", "seq", F.col("paper_id").alias("keyword")))


@query(f"SELECT doc_id AS paper_id, len({WORDS_SQL}) AS n_words FROM documents ORDER BY n_words, doc_id LIMIT 5")
def shortest_texts(spark, d):
    return rollups.shortest(table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.size(text.words("text")).alias("n_words")))


@query(f"WITH {PAPERS_SQL} SELECT seq, trim(coalesce(doi, '')) AS doi, trim(title) AS title, coalesce(CAST(year AS VARCHAR), '') AS year, journal, cited_by, '' AS volume FROM papers")
def literature_entries(spark, d):
    entry = F.to_json(F.struct(F.col("doi").alias("prism:doi"), F.concat(F.lit(" "), "title").alias("dc:title"), F.concat(F.col("year").cast("string"), F.lit("-05-01")).alias("prism:coverDate"), F.col("journal").alias("prism:publicationName"), F.col("cited_by").alias("citedby-count")))
    return readers.parse_entries(papers(spark, d).select("seq", entry.alias("entry"))).select("seq", "doi", "title", "year", "journal", "cited_by", "volume")


@query(f"""WITH {PAPERS_SQL}, {LOOSE}, f AS (SELECT seq, doi FROM loose WHERE doi <> '' QUALIFY row_number() OVER (PARTITION BY doi ORDER BY seq) = 1)
SELECT seq, doi, CASE WHEN doi IN (SELECT doi FROM loose WHERE n_references = 1) THEN 'blocked' WHEN doi IN (SELECT doi FROM loose WHERE source_type = 'manual') THEN 'known' ELSE 'download' END AS plan FROM f""")
def project_plan(spark, d):
    rows = loose_papers(spark, d)
    names = rows.withColumnRenamed("paper_id", "name")
    made = flows.project_from_table("project", rows.select("doi", "title", "seq"), names.where("source_type = 'manual'").select("doi", "name"), names.where("seq % 3 = 0").select("name"), rows.where("n_references = 1").select("doi"))
    return made["rows"].select("seq", "doi", "plan")
