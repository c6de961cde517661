"""Flows: from TEI to chunks and metadata, from pages to books, and the roll-up of steps."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import ids
from lexloom.operators.chunking import chunk_articles, chunk_texts
from lexloom.operators.dedup import doi_report, first_doi, screen_batch
from lexloom.operators.dense import incremental
from lexloom.operators.lifecycle import copy_selected, processable
from lexloom.operators.metadata import keep_filled, keyword_category, screening_route, with_quality, year_by_paper
from lexloom.operators.pages import chapters, clean_pages, front_or_back
from lexloom.operators.registry import download_plan
from lexloom.operators.screening import title_and_abstract
from lexloom.operators.tei import read_tei


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[], object]


def run_steps(steps: list[Step]) -> tuple[str, list[tuple[str, str]]]:
    """(ok, partial or error; outcome of each step): steps in order until one fails."""
    outcomes: list[tuple[str, str]] = []
    for i, step in enumerate(steps):
        try:
            step.run()
            outcomes.append((step.name, "ok"))
        except Exception as e:  # a failed step is an outcome, and the rest is not run
            outcomes.append((step.name, f"error: {e}"))
            outcomes += [(s.name, "skipped") for s in steps[i + 1 :]]
            return ("partial" if i else "error"), outcomes
    return "ok", outcomes


def process_articles(tei: DataFrame, before: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of a category from (paper_id, tei_xml): papers, references and chunks.

    What earlier metadata had filled stays. ``tei`` rows that aren't XML are in none of them.
    """
    parsed = read_tei(tei)
    papers = parsed.select("paper_id", "title", "doi", "journal", "year", "authors", "abstract", "highlights", F.size("references").alias("n_references"), F.octet_length("markdown").alias("md_bytes"))
    if before is not None:
        papers = keep_filled(papers, before, ["paper_id"])
    references = parsed.select("paper_id", F.explode("references").alias("r")).select("paper_id", "r.*")
    chunks = chunk_articles(parsed.select("paper_id", "markdown", "tables"))
    return {"papers": with_quality(papers, size="md_bytes"), "references": references, "chunks": year_by_paper(chunks, papers.select("paper_id", F.lit(None).cast("string").alias("stable_id"), "year", F.lit(1).alias("line_no")))}


def process_books(pages: DataFrame, toc: DataFrame, target: int = 1000, overlap: int = 120) -> dict[str, DataFrame]:
    """Sections and chunks of books from (book_id, page, text) and (book_id, level, title, page, seq).

    Front and back matter has no chunks. section_part begins anew with each section's chunks.
    """
    sections = chapters(toc, clean_pages(pages))
    keyed = sections.where(~front_or_back("title")).withColumn("key", F.concat_ws("\x1f", F.col("book_id").cast("string"), F.format_string("%07d", F.col("page_start")), "heading_path"))
    cut = chunk_texts(keyed, "key", "text", target, overlap).withColumnsRenamed({"chunk_index": "section_part", "chunk": "piece"})
    order = Window.partitionBy("book_id").orderBy("page_start", "heading_path", "section_part")
    chunks = cut.join(keyed.drop("text"), "key").select("book_id", F.col("book_id").alias("paper_id"), F.lit("book").alias("doc_type"), F.col("title").alias("section"), F.lit("chapter").alias("section_canonical"), F.lit("text").alias("type"), "heading_path", "page_start", "page_end", "section_part", F.col("piece").alias("text"), F.sha1("piece").alias("chunk_hash"))
    return {"sections": sections, "chunks": chunks.withColumn("chunk_index", F.row_number().over(order))}


def book_papers(books: DataFrame) -> DataFrame:
    """Books as papers: by their id, with the fields that citations read."""
    return books.select(F.col("book_id").alias("paper_id"), F.col("book_id").alias("stable_id"), "title", F.lit("").alias("doi"), F.lit("").alias("journal"), "year", "authors")


def book_text(sections: DataFrame) -> DataFrame:
    """(book_id, markdown): sections under their headings in order of pages."""
    part = F.concat(F.lit("## "), F.col("heading_path"), F.lit("\n\n"), F.col("text"))
    return sections.groupBy("book_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_start", "heading_path", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("markdown"))


def ingest(batch: DataFrame, corpus: DataFrame, index: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """What a new batch changes: its screening, rows of the index to keep, chunks to embed."""
    kept, new = incremental(index, chunks, "paper_id")
    return {"screened": screen_batch(batch, corpus), "index": kept, "to_embed": new}


def screen_papers(batch: DataFrame, corpus: DataFrame, keywords: DataFrame) -> DataFrame:
    """``batch`` with outcome, title, abstract, category, confidence and route, nothing moved yet.

    ``batch`` has name (unique), doi, sha256, first_page and pages; duplicates of the corpus or of
    each other go to their own route, whatever their category.
    """
    screened = screen_batch(batch, corpus)
    read = title_and_abstract(batch)
    classes = keyword_category(read, keywords, "name", F.concat_ws(" ", "title", "abstract"))
    joined = screened.join(read, "name").join(classes, "name")
    status = F.when(F.col("outcome").startswith("duplicate"), "DUPLICATE").otherwise("OK")
    return joined.withColumn("status", status).withColumn("route", screening_route()).drop("first_page", "pages")


def project_name(name: str, reserved: tuple[str, ...] = ()) -> str:
    """``name``, if a project may have it: small letters, digits, _ and -, and no category of the collection."""
    if not re.fullmatch(r"[a-z0-9_-]+", name):
        raise ValueError(f"not a name of a project: {name}")
    if name in reserved:
        raise ValueError(f"{name} is a category of the collection")
    return name


def process_project(name: str, pdfs: DataFrame, texts: DataFrame, tei: DataFrame) -> dict[str, DataFrame]:
    """Tables of a project of its own, with its name: what has a PDF (name), a text (name) and a TEI (name, tei_xml) is processed.

    Raises where there is no PDF at all; nothing is screened.
    """
    project = project_name(name)
    if not pdfs.limit(1).count():
        raise ValueError("no PDFs")
    ready = processable(tei, texts, pdfs)
    tables = process_articles(ready.select(F.col("name").alias("paper_id"), "tei_xml"))
    return {k: t.withColumn("project", F.lit(project)) for k, t in tables.items()}


def project_from_table(name: str, rows: DataFrame, corpus: DataFrame, project: DataFrame, blocked: DataFrame, reserved: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """What a table of papers (doi, title, seq) asks for: rows, report, copies and downloads.

    The first row of each DOI counts. Papers that the corpus (doi, name) has are copied, unless the
    project (name) holds them, and the others downloaded, but for blocked ones. Raises without a DOI.
    """
    project_name(name, reserved)
    kept = first_doi(rows)
    if not kept.limit(1).count():
        raise ValueError("no DOI in the table")
    plan = download_plan(kept, blocked, corpus)
    copies = copy_selected(plan.where("plan = 'known'"), corpus, project)
    return {"rows": plan, "report": doi_report(rows), "copies": copies, "downloads": plan.where("plan = 'download'").drop("plan")}


def paper_doi(files: DataFrame) -> DataFrame:
    """``files`` with the DOI of their document information, else of their first pages."""
    return files.withColumn("doi", F.coalesce(ids.doi("info", "text"), ids.doi("first_pages", "text")))
