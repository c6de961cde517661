"""Exports: BibTeX, RIS, CSV rows, Markdown bundles, packages and their index."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import col, ids
from lexloom.functions.text import filled, key
from lexloom.operators.dedup import least_by
from lexloom.operators.ranking import numbered
from lexloom.operators.validation import author_names

PACKAGE = 45
ABSTRACT = 500


def bib_base(authors="authors", year="year", paper_id="paper_id") -> Column:
    surname = F.regexp_replace(ids.surname_of(col(authors)), "[^a-zA-Z]", "")
    return F.coalesce(F.nullif(F.concat(surname, F.coalesce(F.nullif(col(year), F.lit(0)).cast("string"), F.lit("XXXX"))), F.lit("")), col(paper_id))


def bib_keys(papers: DataFrame, order: str = "seq") -> DataFrame:
    """``papers`` with bib_key: the second of a base gets a, the third b, in order; 27 and more get a number.

    Bases end in a year or XXXX, so none is another's key.
    """
    n = F.row_number().over(Window.partitionBy("_base").orderBy(order)) - 2
    letter = F.when(F.col("_n") < 0, "").when(F.col("_n") < 26, F.chr(F.col("_n") + 97)).otherwise(F.concat(F.lit("_"), F.col("_n") + 2))
    return papers.withColumn("_base", bib_base()).withColumn("_n", n).withColumn("bib_key", F.concat("_base", letter)).drop("_base", "_n")


def _full_names() -> Column:
    return F.filter(F.transform(F.coalesce("authors", F.expr("array()").cast("array<struct<full: string, forename: string, surname: string>>")), lambda a: F.coalesce(a["full"], F.lit(""))), lambda x: x != "")


def _line(template: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.format_string(template, value))


def bibtex(papers: DataFrame, order: str = "seq") -> DataFrame:
    """(paper_id, bib_key, entry)."""
    names = F.coalesce(F.nullif(F.array_join(_full_names(), " and "), F.lit("")), F.lit("Unknown"))
    year = F.nullif(F.col("year"), F.lit(0)).cast("string")
    entry = F.concat_ws(
        "\n",
        F.format_string("@article{%s,", F.col("bib_key")),
        F.format_string("  author   = {%s},", names),
        F.format_string("  title    = {%s},", F.translate(F.coalesce("title", F.lit("")), "{}", "")),
        _line("  journal  = {%s},", F.col("journal")),
        _line("  year     = {%s},", year),
        _line("  doi      = {%s},", F.col("doi")),
        _line("  abstract = {%s},", F.substring(F.col("abstract"), 1, ABSTRACT)),
        F.lit("}"),
    )
    return bib_keys(papers, order).select("paper_id", "bib_key", entry.alias("entry"))


def ris(papers: DataFrame) -> DataFrame:
    """(paper_id, entry)."""
    people = F.array_join(F.transform(_full_names(), lambda x: F.concat(F.lit("AU  - "), x)), "\n")
    doi = F.col("doi")
    entry = F.concat_ws("\n", F.lit("TY  - JOUR"), _line("TI  - %s", F.col("title")), F.nullif(people, F.lit("")), _line("JO  - %s", F.col("journal")), _line("PY  - %s", F.nullif(F.col("year"), F.lit(0)).cast("string")), _line("DO  - %s", doi), _line("UR  - https://doi.org/%s", doi), _line("AB  - %s", F.substring(F.col("abstract"), 1, ABSTRACT)), F.lit("ER  -"), F.lit(""))
    return papers.select("paper_id", entry.alias("entry"))


# The columns of the CSV export.
CSV_FIELDS = ("paper_id", "stable_id", "title", "authors", "journal", "year", "doi", "n_references", "quality_score", "abstract")


def csv_rows(papers: DataFrame) -> DataFrame:
    own = {"authors": F.array_join(_full_names(), "; ")}
    return papers.select(*(own.get(c, F.coalesce(F.col(c).cast("string"), F.lit("")) if c in papers.columns else F.lit("")).alias(c) for c in CSV_FIELDS))


def fence(text) -> Column:
    """Tildes, three at least, and more than any run of them in the text."""
    longest = F.array_max(F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit("~+"), F.lit(0)), lambda x: F.length(x)))
    return F.repeat(F.lit("~"), F.greatest(F.lit(3), F.coalesce(longest, F.lit(0)) + 1))


def bundle(results: DataFrame, papers: DataFrame) -> DataFrame:
    """(n, markdown) of retrieved chunks with their full reference. ``results`` has n, paper_id, section, section_canonical, type, score and text."""
    meta = papers.select("paper_id", F.col("title").alias("_title"), F.array_join(author_names(), "; ").alias("_authors"), F.col("year").alias("_year"), F.col("journal").alias("_journal"), F.col("doi").alias("_doi"))
    r = results.join(meta, "paper_id", "left")
    dash = lambda x: F.coalesce(filled(x.cast("string")), F.lit("—"))
    year = F.coalesce(F.nullif(F.col("_year").cast("int"), F.lit(0)), ids.year_in_id("paper_id"))
    text, mark = F.trim(F.coalesce("text", F.lit(""))), fence("text")
    body = F.concat_ws(
        "\n",
        F.format_string("## [%d] `%s`", F.col("n"), F.col("paper_id")),
        F.lit(""),
        F.format_string("- **Título:** %s", dash(F.col("_title"))),
        F.format_string("- **Autores:** %s", dash(F.col("_authors"))),
        F.format_string("- **Año:** %s", dash(year)),
        F.format_string("- **Revista:** %s", dash(F.col("_journal"))),
        F.format_string("- **DOI:** %s", F.coalesce(F.concat(F.lit("https://doi.org/"), filled("_doi")), F.lit("—"))),
        F.format_string("- **paper_id:** `%s`", F.col("paper_id")),
        F.format_string("- **Sección:** %s (canónica: %s)", F.coalesce("section", F.lit("?")), F.coalesce("section_canonical", F.lit("?"))),
        F.format_string("- **Tipo:** %s", F.coalesce("type", F.lit("?"))),
        F.format_string("- **score:** %.4f", F.col("score").cast("double")),
        F.lit(""),
        F.lit("**Texto:**"),
        mark,
        text,
        mark,
        F.lit(""),
        F.lit("---"),
        F.lit(""),
    )
    return r.select("n", body.alias("markdown"))


def find_pdf(papers: DataFrame, files: DataFrame) -> DataFrame:
    """(paper_id, file): by id, by stable id, else the first file that begins with the id's first 20 characters."""
    f = files.select(F.col("name").alias("file"), F.lower(F.regexp_replace("name", r"(?i)\.pdf$", "")).alias("_s"))
    p = papers.select("paper_id", F.lower("paper_id").alias("_a"), F.lower(F.coalesce("stable_id", F.lit(""))).alias("_b"), F.substring(F.lower("paper_id"), 1, 20).alias("_c"))
    one = p.join(f, F.col("_a") == F.col("_s")).select("paper_id", "file", F.lit(0).alias("turn"))
    two = p.join(f, F.col("_b") == F.col("_s")).select("paper_id", "file", F.lit(1).alias("turn"))
    begun = f.groupBy(F.substring("_s", 1, 20).alias("_c2")).agg(F.min("file").alias("file"))  # one file of all that begin alike
    three = p.join(begun, F.col("_c") == F.col("_c2")).select("paper_id", "file", F.lit(2).alias("turn"))
    return least_by(one.unionByName(two).unionByName(three), ["paper_id"], [F.col("turn"), F.col("file")]).select("paper_id", "file")


def packages(papers: DataFrame, packed: DataFrame | None = None, group: str = "category", order: str = "paper_id", size: int = PACKAGE, first: int = 0) -> DataFrame:
    """(category, paper_id, package): papers not packed yet, ``size`` to a package, numbered on after those there are."""
    new = papers.select(group, order)
    start = F.lit(first)
    if packed is not None:
        new = new.join(packed.select(group, order), [group, order], "left_anti")
        new = new.join(packed.groupBy(group).agg(F.max("package").alias("_last")), group, "left")
        start = F.coalesce("_last", F.lit(first))
    ranked = numbered(new, [F.col(order)], "_n", [group])  # a category may be most of all papers
    return ranked.select(group, order, (start + F.floor(F.col("_n") / size) + 1).cast("int").alias("package"))


def package_manifest(packed: DataFrame, papers: DataFrame, group: str = "category", order: str = "paper_id") -> DataFrame:
    """(category, package, n_papers, first, last, ids) of the packages."""
    known = packed.join(papers.select(group, order), [group, order], "left_semi")
    return known.groupBy(group, "package").agg(F.count("*").alias("n_papers"), F.min(order).alias("first"), F.max(order).alias("last"), F.array_join(F.sort_array(F.collect_list(order)), ",").alias("ids"))


def master_index(manifests: DataFrame, group: str = "category") -> DataFrame:
    """(category, n_packages, n_papers, packages) over all manifests."""
    shown = F.array_join(F.transform(F.sort_array(F.collect_list("package")), lambda p: F.format_string("%03d", p)), ",")  # by number: 1000 comes after 999
    return manifests.groupBy(group).agg(F.count("*").alias("n_packages"), F.sum("n_papers").alias("n_papers"), shown.alias("packages"))


def resolved(ids_: DataFrame, papers: DataFrame) -> DataFrame:
    """Ids with their papers' titles, ``not found`` where there is none."""
    return ids_.withColumn("_k", key("paper_id")).join(papers.select(key("paper_id").alias("_k"), "title"), "_k", "left").select("paper_id", F.coalesce("title", F.lit("not found")).alias("title"))


def zipped(files: DataFrame, by: list[str]) -> DataFrame:
    """(by…, n_files, archive): the files (by…, name, content) of each package as a ZIP, by name; the same files give the same bytes.

    A package is made in one task and must fit in memory, as ``packages`` sees to. Of several
    files of one name in a package the first by content stays. A null content is an empty file.
    """
    kinds = dict(files.dtypes)

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("name", "ascending"), ("content", "ascending")])
        out, seen = io.BytesIO(), set()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in zip(rows.column("name").to_pylist(), rows.column("content").to_pylist(), strict=True):
                if name not in seen:
                    z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content or b"", zipfile.ZIP_DEFLATED)
                    seen.add(name)
        return pa.table([*(rows.column(c).slice(0, 1) for c in by), pa.array([len(seen)], pa.int64()), pa.array([out.getvalue()], pa.binary())], [*by, "n_files", "archive"])

    rows = files.where("name IS NOT NULL").select(*by, "name", F.col("content").cast("binary").alias("content"))
    return rows.groupBy(*by).applyInArrow(pack, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "n_files long, archive binary"]))


def unzipped(archives: DataFrame, by: list[str]) -> DataFrame:
    """(by…, name, content) of the files in archives."""
    kinds = dict(archives.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, archive in enumerate(batch.column("archive").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(archive)) as z:
                    names = z.namelist()
                    own = [batch.column(c).take(pa.array([i] * len(names), pa.int64())) for c in by]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array([z.read(n) for n in names], pa.binary())], [*by, "name", "content"])

    return archives.select(*by, "archive").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "name string, content binary"]))


def paper_files(papers: DataFrame, pdfs: DataFrame | None = None, texts: DataFrame | None = None, package: str = "package") -> DataFrame:
    """(package, name, content) of papers (package, paper_id, stable_id): their PDFs under pdfs/, found by ``find_pdf``, and texts under md_clean/.

    ``pdfs`` has name and content, ``texts`` paper_id and content. A paper without one or the other has the rest.
    """
    parts = []
    if pdfs is not None:
        held = find_pdf(papers, pdfs.select("name"))
        parts.append(papers.join(held, "paper_id").join(pdfs, F.col("file") == F.col("name")).select(package, F.concat(F.lit("pdfs/"), "name").alias("name"), F.col("content").cast("binary").alias("content")))
    if texts is not None:
        parts.append(papers.join(texts, "paper_id").select(package, F.concat(F.lit("md_clean/"), "paper_id", F.lit(".clean.md")).alias("name"), F.col("content").cast("binary").alias("content")))
    return reduce(DataFrame.unionByName, parts)
