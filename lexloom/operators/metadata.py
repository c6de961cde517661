"""Metadata of papers: quality, merging with what was known, provenance, DOIs by several ways, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import ids
from lexloom.functions.text import fold, key, title_key
from lexloom.operators.dedup import first_by, least_by

# What a missing field costs.
PENALTIES = (("missing_title", 0.25), ("missing_doi", 0.20), ("missing_abstract", 0.15), ("missing_year", 0.10), ("missing_authors", 0.10), ("no_references_extracted", 0.10), ("short_md_clean", 0.10))
LEAST_REFERENCES, LEAST_BYTES = 5, 3000


#: Rows of a configuration of keywords.
MOST_KEYWORDS = 10_000


def blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


def quality(columns: list[str], references: str = "n_references", size: str | None = None) -> tuple[Column, Column]:
    """(quality_score, warnings): 1 less a penalty for each lack, 0 at least, two decimals by half-even."""
    authors = (F.col("authors").isNull() | (F.size("authors") == 0)) if "authors" in columns else F.lit(False)
    year = F.coalesce(ids.year_number("year"), F.lit(0)) == 0
    lacks = [blank("title"), blank("doi"), blank("abstract") if "abstract" in columns else F.lit(False), year, authors, F.coalesce(F.col(references), F.lit(0)) < LEAST_REFERENCES, (F.coalesce(F.col(size), F.lit(0)) < LEAST_BYTES) if size else F.lit(False)]
    cost = sum((F.when(lack, p).otherwise(0.0) for lack, (_, p) in zip(lacks, PENALTIES, strict=True)), F.lit(0.0))
    warnings = F.filter(F.array(*(F.when(lack, name) for lack, (name, _) in zip(lacks, PENALTIES, strict=True))), lambda x: x.isNotNull())
    # Penalties are multiples of 0.05, so rounding first to six places removes the binary remainder.
    return F.bround(F.greatest(F.lit(0.0), F.round(1 - cost, 6)), 2), warnings


def with_quality(papers: DataFrame, **how) -> DataFrame:
    score, warnings = quality(papers.columns, **how)
    return papers.withColumns({"quality_score": score, "warnings": warnings})


def keep_filled(new: DataFrame, before: DataFrame, on: list[str], fields: tuple[str, ...] = ("title", "doi", "journal", "year", "authors")) -> DataFrame:
    """What was filled before stays; the rest is new."""
    old = before.select(*on, *(F.col(f).alias(f"_{f}") for f in fields))
    joined = new.join(old, on, "left")
    kinds = dict(new.dtypes)

    def value(f: str) -> Column:
        was = (F.size(f"_{f}") > 0) if kinds[f].startswith("array") else ~blank(f"_{f}") & (F.col(f"_{f}").cast("string") != "0")
        return F.when(F.coalesce(was, F.lit(False)), F.col(f"_{f}")).otherwise(F.col(f))

    return joined.select(*(value(c).alias(c) if c in fields else F.col(c) for c in new.columns))


def last_record(papers: DataFrame, on: str = "paper_id", line: str = "line_no") -> DataFrame:
    """One record of each id: the last."""
    return least_by(papers, [on], [-F.col(line)])


def overlay_books(papers: DataFrame, books: DataFrame) -> DataFrame:
    """Papers and books by id: a book adds what is missing, fills empty authors and year, and a title only where there is none."""
    b = books.select("paper_id", F.col("title").alias("_title"), F.col("authors").alias("_authors"), F.col("year").alias("_year"), F.lit(True).alias("_book"))
    p = papers.withColumn("_paper", F.lit(True)).join(b, "paper_id", "full")
    no_authors, no_year = F.col("authors").isNull() | (F.size("authors") == 0), F.coalesce(F.col("year"), F.lit(0)) == 0
    new = {"title": F.when(F.col("_paper").isNull() | F.col("title").isNull(), F.col("_title")).otherwise(F.col("title")), "authors": F.when(no_authors, F.col("_authors")).otherwise(F.col("authors")), "year": F.when(no_year, F.col("_year")).otherwise(F.col("year"))}
    return p.select(*(new[c].alias(c) if c in new else F.col(c) for c in papers.columns))


def year_by_paper(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """``chunks`` with year by paper_id or stable_id, else from the id."""
    names = papers.select(F.explode(F.array_distinct(F.array_compact(F.array("paper_id", "stable_id")))).alias("paper_id"), F.col("year").alias("_year"), "line_no")
    known = least_by(names.where("coalesce(_year, 0) != 0"), ["paper_id"], [-F.col("line_no")]).drop("line_no")
    return chunks.join(known, "paper_id", "left").withColumn("year", F.coalesce("_year", ids.year_in_id("paper_id"))).drop("_year")


# Where a download method gets a paper and by what right.
METHODS = {
    "semantic_scholar": ("semantic_scholar", "open_access"),
    "unpaywall": ("unpaywall", "open_access"),
    "elsevier_api": ("elsevier_api", "institutional"),
    "elsevier_specific": ("elsevier_scraping", "institutional"),
    "wiley_specific": ("wiley_scraping", "institutional"),
    "mdpi_specific": ("mdpi_scraping", "open_access"),
    "landing_page_pdf": ("publisher_scraping", "unknown"),
    "doi_accept_pdf": ("doi_direct", "open_access"),
}


def provenance(papers: DataFrame, downloads: DataFrame) -> DataFrame:
    """``papers`` with download_source and access_type by DOI; papers not downloaded are manual."""
    got = first_by(downloads.select(ids.doi("doi", "provenance").alias("_d"), F.col("method"), F.col("date").alias("download_date")).where("_d != ''"), ["_d"], [F.desc("download_date"), F.col("method")])
    source = F.create_map(*(F.lit(x) for k, v in METHODS.items() for x in (k, v[0])))
    access = F.create_map(*(F.lit(x) for k, v in METHODS.items() for x in (k, v[1])))
    joined = papers.withColumn("_d", ids.doi("doi", "provenance")).join(got, "_d", "left")
    return joined.withColumns({"download_source": F.coalesce(source[F.coalesce("method", F.lit(""))], F.lit("manual")), "access_type": F.coalesce(access[F.coalesce("method", F.lit(""))], F.lit("unknown"))}).drop("_d", "method")


def doi_by_priority(files: DataFrame, manual: DataFrame, titles: DataFrame) -> DataFrame:
    """``files`` (name, title, text) with doi and doi_source: by hand for the name, the stem or the title, from the table of titles, the name, the text.

    ``manual`` has name or title and doi; ``titles`` has title and doi.
    """
    stemmed = F.regexp_replace("name", r"(?i)\.pdf$", "")
    by = lambda k, name: least_by(manual.where(k.isNotNull() & (k != "")).select(k.alias("_k"), F.col("doi").alias(name), "seq"), ["_k"], [F.col("seq")]).drop("seq")
    out = files.withColumns({"_n": F.lower("name"), "_s": key(stemmed), "_t": title_key("title", "ascii")})
    out = out.join(by(F.lower("name"), "_d1").withColumnRenamed("_k", "_n"), "_n", "left")
    out = out.join(by(key(F.regexp_replace("name", r"(?i)\.pdf$", "")), "_d2").withColumnRenamed("_k", "_s"), "_s", "left")
    out = out.join(by(title_key("title", "ascii"), "_d3").withColumnRenamed("_k", "_t"), "_t", "left")
    out = out.join(title_table(titles).select(F.col("title_key").alias("_t"), F.col("doi").alias("_d4")), "_t", "left")
    ways = [("manual_name", F.col("_d1")), ("manual_stem", F.col("_d2")), ("manual_title", F.col("_d3")), ("csv_title", F.col("_d4")), ("filename", ids.doi("name", "filename")), ("text", ids.doi("text", "text"))]
    source = None
    for label, value in ways:
        hit = F.coalesce(F.trim(value), F.lit("")) != ""
        source = F.when(hit, label) if source is None else source.when(hit, label)
    return out.withColumns({"doi": F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for _, v in ways)), "doi_source": source}).drop("_n", "_s", "_t", "_d1", "_d2", "_d3", "_d4")


def title_table(rows: DataFrame) -> DataFrame:
    """(title_key, doi, conflicting): the first DOI of a title, and whether another was given for it."""
    keyed = rows.select(title_key("title", "ascii").alias("title_key"), ids.doi("doi", "plain").alias("doi"), "seq").where("title_key != '' and doi != ''")
    conflict = keyed.groupBy("title_key").agg((F.count_distinct(F.lower("doi")) > 1).alias("conflicting"))
    return least_by(keyed, ["title_key"], [F.col("seq")]).drop("seq").join(conflict, "title_key")


def lookup_year(message: Column, mode: str = "lookup") -> Column:
    """The year of a work's record: print before online when looked up, issued first when renaming."""
    order = {"lookup": ("published-print", "published-online", "issued", "published"), "rename": ("issued", "published-print", "published-online", "created")}[mode]
    return F.coalesce(*(F.get_json_object(message, f"$['{p}']['date-parts'][0][0]").try_cast("int") for p in order))


def read_work(works: DataFrame, message: str = "message") -> DataFrame:
    """doi, title, journal, journal_short, year and authors of works as JSON; what isn't JSON gives nulls."""
    m = F.col(message)
    people = F.from_json(F.get_json_object(m, "$.author"), "array<struct<family: string, given: string>>")
    return works.select("doi", F.get_json_object(m, "$.title[0]").alias("title"), F.get_json_object(m, "$['container-title'][0]").alias("journal"), F.get_json_object(m, "$['short-container-title'][0]").alias("journal_short"), lookup_year(m).alias("year"), people.alias("authors"))


def incomplete(columns: list[str]) -> dict[str, Column]:
    """A condition for each way in which a record wants editing."""
    from lexloom.operators.validation import author_names, authors_incomplete

    names = author_names()
    own = {
        "no_doi": blank("doi"),
        "no_year": F.coalesce(ids.year_number("year"), F.lit(0)) == 0,
        "no_authors": F.col("authors").isNull() | (F.size("authors") == 0),
        "no_journal": blank("journal"),
        "no_title": blank("title"),
        "authors_incomplete": authors_incomplete(),
        "authors_glued": F.exists(names, lambda n: ~n.rlike(r"(?U)\s") & n.rlike("[a-z][A-Z]")),
        "id_not_canonical": (F.col("paper_id") != F.lower("paper_id")) | F.col("paper_id").rlike(r"_10_\d"),
    }
    return own | {"incomplete": own["no_doi"] | own["no_year"] | own["no_authors"] | own["no_journal"] | own["no_title"]}


def catalogue(papers: DataFrame) -> DataFrame:
    """Rows of the catalogue: link of the DOI, authors as shown, first surname."""
    from lexloom.operators.validation import author_names

    link = F.when(~blank("doi"), F.concat(F.lit("https://doi.org/"), F.trim("doi")))
    return papers.select("paper_id", "title", F.array_join(author_names(), "; ").alias("authors"), F.initcap(ids.surname_of(F.col("authors"))).alias("first_surname"), F.coalesce("journal", F.lit("")).alias("journal"), "year", link.alias("doi_url"))


def text_adequacy(columns: list[str]) -> Column:
    """Why a text layer is doubtful: short_text, low_ratio or low_density; null where it isn't.

    Asks for n_words, n_pages and body_words.
    """
    return F.when(F.col("n_words") < 1000, "short_text").when(F.col("n_words") < 0.2 * F.col("body_words"), "low_ratio").when(F.col("n_words") / F.greatest(F.lit(1), F.col("n_pages")) < 100, "low_density")


def pdf_rejection(least_pages: int = 2, least_words: int = 500) -> Column:
    return F.when(F.col("n_pages") < least_pages, "few_pages").when(F.col("n_words") < least_words, "few_words")


def cached(now: str, most_days: int) -> Column:
    """Whether a cache row of time ``ts`` counts: 0 days never expires, and neither does a missing or bad time."""
    age = F.datediff(F.lit(now).cast("date"), F.col("ts").try_cast("timestamp").cast("date"))
    return F.lit(most_days == 0) | F.coalesce(age < most_days, F.lit(True))


def skip_rows(spec: str) -> set[int]:
    """Row numbers of a list like ``15,181,190-195``."""
    out: set[int] = set()
    for part in filter(None, map(str.strip, spec.split(","))):
        a, _, b = part.partition("-")
        out |= set(range(int(a), int(b or a) + 1))
    return out


def keyword_category(docs: DataFrame, keywords: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, category, confidence): the only category with a keyword in the text (anywhere, also within words); else null and 0.

    ``keywords`` (category, keyword) is configuration: its rows, MOST_KEYWORDS at most, become one expression.
    """
    groups: dict[str, list[str]] = {}
    rows = keywords.orderBy("category", "keyword").limit(MOST_KEYWORDS + 1).collect()
    if len(rows) > MOST_KEYWORDS:
        raise ValueError(f"more than {MOST_KEYWORDS} keywords")
    for r in rows:
        groups.setdefault(r.category, []).append(r.keyword.lower())
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s ]+", " "))

    def chosen(t: Column) -> Column:
        hits = [F.when(F.exists(F.array(*map(F.lit, ws)), lambda w: t.contains(w)), F.lit(c)) for c, ws in groups.items()]
        return F.filter(F.array(*hits), lambda x: x.isNotNull())

    found = F.get(F.transform(F.array(low), chosen), F.lit(0)) if groups else F.array().cast("array<string>")
    one = F.when(F.size("_c") == 1, F.get("_c", F.lit(0)))
    return docs.select(id_col, found.alias("_c")).select(id_col, one.alias("category"), F.when(F.size("_c") == 1, 1.0).otherwise(0.0).alias("confidence"))


def screening_route(status: str = "status", category: str = "category", confidence: str = "confidence") -> Column:
    """Where a screened paper goes."""
    c = F.coalesce(F.col(confidence), F.lit(0.0))
    return F.when(F.col(status) == "DUPLICATE", "duplicates").when(F.col(status) == "error", "failed").when(F.col(category).isNull() | F.col(category).isin("irrelevant", "irrelevante") | (c < 0.6), "failed").otherwise(F.col(category))


def folded_search(text, needle: str) -> Column:
    return fold(text).contains(needle.lower())


def concat_with_lineage(frames: dict[str, DataFrame], column: str = "origin") -> DataFrame:
    """All rows of the frames with the name of theirs; columns that a frame lacks are null."""
    out = None
    for name, frame in frames.items():
        own = frame.withColumn(column, F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
