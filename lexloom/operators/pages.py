"""Pages of books: running lines, cleaning, tables of contents and chapters; and links in web pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import col
from lexloom.functions.text import fold, trim_space

EDGE, LEAST_PAGES, SHARE, MOST_LINE, LEAST_LINE = 2, 4, 100, 80, 3
# Fixed value: what a line with a page number looks like.
PAGE_NUMBER = r"^\s*[-–—]?\s*(?:\d{1,4}|[ivxlcdmIVXLCDM]{1,7})\s*[-–—]?\s*$"


def lines(text) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(col(text), F.lit("")), "\r\n|\r|\n"), trim_space), lambda x: x != "")


def running_key(line: Column) -> Column:
    """Lower case without digits, blanks as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", ""), r"(?U)\s+", " "))


def running_lines(pages: DataFrame, book: str, text: str = "text") -> DataFrame:
    """(book, line, n_pages): lines at the edges of at least max(4, pages // 100) pages, by their key.

    A page counts a line once. Partial counts leave each task, so one line on every page is no burden.
    """
    shown = F.get(F.transform(F.array(lines(text)), lambda x: F.concat(F.slice(x, 1, EDGE), F.slice(x, F.greatest(F.lit(1), F.size(x) - EDGE + 1), EDGE))), F.lit(0))
    keys = pages.select(book, F.explode(F.array_distinct(F.transform(shown, running_key))).alias("line"))
    counts = keys.where(F.length("line").between(LEAST_LINE, MOST_LINE)).groupBy(book, "line").agg(F.count("*").alias("n_pages"))
    total = pages.groupBy(book).agg(F.count("*").alias("total"))
    return counts.join(total, book).where(F.col("n_pages") >= F.greatest(F.lit(LEAST_PAGES), F.floor(F.col("total") / SHARE))).select(book, "line", "n_pages")


def join_hyphens(text) -> Column:
    return F.regexp_replace(F.coalesce(col(text), F.lit("")), r"([A-Za-zÁÉÍÓÚÑÜáéíóúñü])-\n([a-záéíóúñü])", "$1$2")


def clean_page(text, running) -> Column:
    """Hyphens joined, running lines and page numbers dropped, lines joined to paragraphs.

    A paragraph ends at a blank line or after a line that ends in a closing sign.
    """

    def kept(all_lines: Column) -> Column:
        return F.filter(all_lines, lambda x: (x == "") | ~(F.coalesce(F.array_contains(running, running_key(x)), F.lit(False)) | x.rlike(PAGE_NUMBER)))

    every = F.transform(F.split(join_hyphens(text), "\r\n|\r|\n"), trim_space)
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))

    def step(a: Column, x: Column) -> Column:
        close = F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.when(a["done"] == "", "").otherwise("\n\n"), a["open"]))
        goes_on = (a["open"] != "") & ~a["open"].rlike(r"[.!?:;…]\s*$")
        return F.when(x == "", F.struct(close.alias("done"), F.lit("").alias("open"))).when(goes_on, F.struct(a["done"].alias("done"), F.concat_ws(" ", a["open"], x).alias("open"))).otherwise(F.struct(close.alias("done"), x.alias("open")))

    whole = F.aggregate(kept(every), start, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.when(a["done"] == "", "").otherwise("\n\n"), a["open"])))
    return F.regexp_replace(whole, "[ \t]+", " ")


def clean_pages(pages: DataFrame, book: str = "book_id", page: str = "page", text: str = "text") -> DataFrame:
    """(book, page, text) cleaned with each book's own running lines."""
    found = running_lines(pages, book, text).groupBy(book).agg(F.collect_set("line").alias("running"))
    return pages.join(found, book, "left").select(book, page, clean_page(text, F.coalesce("running", F.array().cast("array<string>"))).alias("text"))


# Titles of what isn't a chapter, and of what is kept without being one.
FRONT_BACK = [
    "table of contents", "contents", "index", "indices", "preface", "foreword", "front matter", "acknowledgements", "acknowledgments", "acknowledgement",
    "list of figures", "list of tables", "prelims", "preliminaries",
    "indice", "indice general", "contenidos", "tabla de contenidos", "prefacio", "prologo", "agradecimientos", "preliminares",
]
SUPPLEMENTARY = ["appendix", "appendices", "apendice", "apendices", "anexo", "anexos"]


def _one_of(title, group: list[str]) -> Column:
    t = F.trim(F.regexp_replace(fold(title), r"(?U)\s+", " "))
    out = t.isin(group)
    for g in group:
        out = out | t.startswith(g + " ")
    return out


def front_or_back(title) -> Column:
    return _one_of(title, FRONT_BACK)


def supplementary(title) -> Column:
    return _one_of(title, SUPPLEMENTARY)


def count_chapters(sections: DataFrame, book: str = "book_id") -> DataFrame:
    return sections.groupBy(book).agg(F.count_if(~front_or_back("title") & ~supplementary("title")).alias("n_chapters"))


def toc_title(title) -> Column:
    """A label of a table of contents without the ending of a file name."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(col(title), F.lit(""))), r"(?i)\.pdf$", ""))


def headings_by_font(spans: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, page, text, level) of lines at least a quarter larger than the body, by the three largest sizes.

    ``spans`` has page, text and size; the body is the size with most characters.
    """
    sized = spans.withColumn("size", F.round("size", 1)).where(F.trim("text") != "")
    counts = sized.groupBy(book, "size").agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    body = counts.groupBy(book).agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body"))
    tiers = counts.join(body, book).where(F.col("size") >= F.col("body") * 1.25).withColumn("level", F.dense_rank().over(Window.partitionBy(book).orderBy(F.desc("size")))).where("level <= 3").select(book, "size", "level")
    return sized.where(F.length("text") <= 120).join(tiers, [book, "size"]).select(book, "page", F.trim("text").alias("text"), "level")


def chapters(toc: DataFrame, pages: DataFrame, book: str = "book_id") -> DataFrame:
    """(book, title, heading_path, page_start, page_end, text) by the table of contents, in order of pages.

    ``toc`` has level, title, page and seq. Entries of one page share its text. Pages before the first
    entry are front matter; a book without entries is one section named by its id. Sections without
    text are left out.
    """
    last = pages.groupBy(book).agg(F.max("page").alias("n_pages"))
    entry = F.sort_array(F.collect_list(F.struct("page", "seq", "level", "title")))
    listed = last.join(toc.where("page >= 1").groupBy(book).agg(entry.alias("entries")), book, "left").withColumn("entries", F.coalesce("entries", F.expr("array()").cast("array<struct<page:int,seq:int,level:int,title:string>>")))

    def path(i: Column, e: Column, entries: Column) -> Column:
        # An ancestor is an entry before, above every one between it and this.
        before = F.slice(entries, 1, i)
        up = F.filter(before, lambda x, j: (x["level"] < e["level"]) & F.forall(F.slice(before, j + 2, F.greatest(F.lit(0), i - j - 1)), lambda y: y["level"] > x["level"]))
        return F.array_join(F.concat(F.transform(up, lambda x: x["title"]), F.array(e["title"])), " > ")

    entries = F.col("entries")
    made = F.transform(entries, lambda e, i: F.struct(e["title"].alias("title"), path(i, e, entries).alias("heading_path"), e["page"].alias("page_start"), F.greatest(e["page"], F.coalesce(F.get(entries, i + 1)["page"] - 1, F.col("n_pages"))).alias("page_end"), i.alias("seq")))
    first = F.get(entries, F.lit(0))["page"]
    front = F.when(first > 1, F.array(F.struct(F.lit("Front matter").alias("title"), F.lit("Front matter").alias("heading_path"), F.lit(1).alias("page_start"), (first - 1).alias("page_end"), F.lit(-1).alias("seq"))))
    whole = F.array(F.struct(F.col(book).cast("string").alias("title"), F.col(book).cast("string").alias("heading_path"), F.lit(1).alias("page_start"), F.col("n_pages").cast("int").alias("page_end"), F.lit(0).alias("seq")))
    none = F.expr("array()").cast("array<struct<title:string,heading_path:string,page_start:int,page_end:int,seq:int>>")
    parts = listed.select(book, F.explode(F.when(F.size(entries) == 0, whole).otherwise(F.concat(F.coalesce(front, none), made))).alias("s")).select(book, "s.*")
    held = parts.join(pages.select(book, F.col("page"), F.col("text").alias("page_text")), (parts[book] == pages[book]) & F.col("page").between(F.col("page_start"), F.col("page_end"))).select(parts[book], "title", "heading_path", "page_start", "page_end", "seq", "page", "page_text")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "page_text"))), lambda x: x["page_text"]), "\n\n")
    out = held.groupBy(book, "title", "heading_path", "page_start", "page_end", "seq").agg(trim_space(F.regexp_replace(text, "\n{3,}", "\n\n")).alias("text"))
    return out.where(F.col("text") != "").select(book, "title", "heading_path", "page_start", "page_end", "text")


def isbn(text) -> Column:
    found = F.regexp_extract(F.coalesce(col(text), F.lit("")), r"(?i)ISBN(?:-1[03])?\s*:?\s*((?:97[89][-\s]?)?(?:\d[-\s]?){9}[\dXx])", 1)
    return F.upper(F.regexp_replace(found, r"[-\s]", ""))


def copyright_year(text) -> Column:
    year = F.nullif(F.regexp_extract(F.coalesce(col(text), F.lit("")), r"(?i)(?:©|\(c\)|copyright)\s*(\d{4})", 1), F.lit("")).cast("int")
    return F.when(year.between(1900, 2100), year)


def file_meta(stem) -> Column:
    """year, surname and title from a name like ``2007-Surname_Some_Title``; without a year all is title."""
    s = F.trim(F.coalesce(col(stem), F.lit("")))
    digits = F.nullif(F.regexp_extract(s, r"^(\d{4})", 1), F.lit("")).cast("int")
    year = F.when(digits.between(1900, 2100), digits)
    rest = F.when(year.isNotNull(), F.regexp_replace(s, r"^\d{4}[-_\s]*", "")).otherwise(s)
    surname, tail = F.trim(F.substring_index(rest, "_", 1)), F.regexp_replace(rest, "^[^_]*_", "")
    has = year.isNotNull() & rest.contains("_") & (surname != "") & (F.trim(tail) != "")
    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[_-]+", " "), r"\s+", " "))
    return F.struct(year.alias("year"), F.when(has, surname).alias("surname"), tidy(F.when(has, tail).otherwise(rest)).alias("title"))


def person_names(raw) -> Column:
    """[{full, surname, forename}] of names parted by ; or & or and, either ``Surname, Name`` or ``Name Surname``."""
    parts = F.filter(F.transform(F.split(F.trim(F.coalesce(col(raw), F.lit(""))), r"\s*[;&]\s*|\s+and\s+"), lambda x: F.trim(x)), lambda x: x != "")

    def one(p: Column) -> Column:
        comma = p.contains(",")
        sur = F.when(comma, F.trim(F.substring_index(p, ",", 1))).otherwise(F.regexp_extract(p, r"(\S+)$", 1))
        fore = F.when(comma, F.trim(F.regexp_replace(p, "^[^,]*,", ""))).otherwise(F.trim(F.regexp_replace(p, r"\S+$", "")))
        return F.struct(F.when(comma, F.trim(F.concat_ws(" ", fore, sur))).otherwise(p).alias("full"), sur.alias("surname"), fore.alias("forename"))

    return F.transform(parts, one)


def is_text(chars, n_pages, least: int = 100) -> Column:
    """Whether a book has text: at least ``least`` characters a page."""
    return (col(n_pages) > 0) & (col(chars) / col(n_pages) >= least)


# What the address of a PDF looks like.
PDF_ADDRESS = r"/pdf|\.pdf($|\?)|/pdfdirect|/articlepdf|/content/pdf/|/fullpdf|/download/pdf|/pdfft|isDTMRedir"


def link_score(href, text) -> Column:
    h, t = F.lower(F.coalesce(col(href), F.lit(""))), F.lower(F.coalesce(col(text), F.lit("")))
    score = F.lit(0)
    for hit, points in ((h.rlike(PDF_ADDRESS), 10), (h.contains("pdfft") | h.contains("istdmredir"), 8), (t.contains("pdf"), 5), (t.contains("download"), 2), (t.contains("full text pdf"), 4), (h.startswith("javascript:"), -5)):
        score = score + F.when(hit, points).otherwise(0)
    return score


def links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, n, href, text) of the anchors with an address, in order."""
    anchors = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    found = pages.select(id_col, F.posexplode(anchors).alias("n", "a"))
    text = F.trim(F.regexp_replace(F.regexp_replace("a", "<[^>]*>", " "), r"\s+", " "))
    return found.select(id_col, "n", F.trim(F.regexp_extract("a", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1)).alias("href"), text.alias("text"))


def pdf_links(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, href, source) of each page's PDF: a citation meta tag, else a frame, else the best-scored anchor."""
    body = F.coalesce(F.col(html), F.lit(""))
    meta = F.regexp_extract(body, r"(?is)<meta[^>]*?(?:name|property)\s*=\s*[\"'](?:citation_pdf_url|dc\.identifier)[\"'][^>]*?content\s*=\s*[\"']([^\"']*)[\"']", 1)
    frame = F.regexp_extract(body, r"(?is)<(?:iframe|embed)[^>]*?src\s*=\s*[\"']([^\"']*pdf[^\"']*)[\"']", 1)
    scored = links(pages, id_col, html).withColumn("score", link_score("href", "text")).where("score > 0")
    best = scored.groupBy(id_col).agg(F.max_by("href", F.struct("score", -F.col("n"))).alias("anchor"))
    fixed = pages.select(id_col, F.when(F.lower(meta).rlike(r"\.pdf|/pdf"), F.trim(meta)).alias("meta"), F.nullif(F.trim(frame), F.lit("")).alias("frame"))
    all_ = fixed.join(best, id_col, "left")
    return all_.select(id_col, F.coalesce("meta", "frame", "anchor").alias("href"), F.when(F.col("meta").isNotNull(), "meta").when(F.col("frame").isNotNull(), "frame").when(F.col("anchor").isNotNull(), "anchor").alias("source")).where("href is not null")


def visible_text(html) -> Column:
    """A page's text without scripts, styles and tags, blanks as one."""
    x = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))
