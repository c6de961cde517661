"""Reading new papers before they are processed: title and abstract, names with DOIs by hand, cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import col
from lexloom.functions.text import filled, trim_space
from lexloom.operators.ranking import let

# Headings that end a title or an abstract, and lines of a journal's header.
TITLE_END = r"(?iU)^\s*(abstract|resumen|keywords?|palabras\s+clave|introduction|introducción|doi\b)"
ABSTRACT = r"(?imd)^[ \t]*(abstract|resumen)[ \t]*$"
ABSTRACT_END = r"(?imdU)\n\s*\n|^\s*(keywords?|introduction|1[\s.]\s*\w|©|highlights?)"
SECTION = r"(?iU)^\s*(keywords?|palabras\s+clave|introduction|introducción|highlights?|graphical\s+abstract|1[\s.]\s*\w)"
HEADER = r"(?iU)^\s*(\d{4}|vol\.?\s*\d+|doi\s*:|https?://|received\s*:|accepted\s*:|available\s+online|©|\bISSN\b|elsevier|springer|wiley|mdpi|taylor\s*&|[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,4})"
TITLE_LINES, TITLE_CHARS, ABSTRACT_CHARS, LEAST_ABSTRACT, LEAST_LINE = 12, 350, 1500, 80, 45


def _filled_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), trim_space), lambda x: x != "")


def _before(lines: Column, ends) -> Column:
    """The lines before the first one that ``ends``."""
    at = F.array_position(F.transform(lines, ends), True)
    return F.when(at == 0, lines).otherwise(F.slice(lines, F.lit(1), (at - 1).cast("int")))


def _from(lines: Column, begins) -> Column:
    """The lines from the first one that ``begins``."""
    at = F.array_position(F.transform(lines, begins), True).cast("int")
    return F.when(at == 0, F.slice(lines, 1, 0)).otherwise(F.slice(lines, at, F.size(lines)))


def _joined(lines: Column, most: int) -> Column:
    """Lines in a row, up to the one that makes them longer than ``most``."""
    return F.aggregate(lines, F.lit(""), lambda a, x: F.when(F.length(a) > most, a).when(a == "", x).otherwise(F.concat(a, F.lit(" "), x)))


def title_of(page) -> Column:
    """The first lines of a page, four at most, up to a heading that ends a title; tiny lines don't count."""
    first = F.slice(_filled_lines(F.coalesce(col(page), F.lit(""))), 1, TITLE_LINES)
    own = let(first, lambda lines: F.filter(_before(lines, lambda x: x.rlike(TITLE_END)), lambda x: F.length(x) >= 4))
    return _joined(F.slice(own, 1, 4), TITLE_CHARS)


def abstract_of(text) -> Column:
    """What follows the heading of an abstract, else the first dense lines after a journal's header."""

    def under_heading(parts: Column) -> Column:
        body = F.substring(F.get(parts, F.lit(1)), 1, 2000)
        ended = F.when(body.rlike(ABSTRACT_END), F.get(F.split(body, ABSTRACT_END, 2), F.lit(0))).otherwise(F.substring(body, 1, ABSTRACT_CHARS))
        return let(trim_space(ended), lambda x: F.when(F.length(x) > LEAST_ABSTRACT, F.substring(x, 1, ABSTRACT_CHARS)))

    def dense(lines: Column) -> Column:
        own = let(_before(lines, lambda x: x.rlike(SECTION)), lambda y: _from(y, lambda x: ~x.rlike(HEADER) & (F.length(x) >= LEAST_LINE)))
        return F.nullif(F.substring(_joined(own, ABSTRACT_CHARS - 100), 1, ABSTRACT_CHARS), F.lit(""))

    whole = F.coalesce(col(text), F.lit(""))
    headed = let(F.split(whole, ABSTRACT, 2), lambda parts: F.when(F.size(parts) > 1, under_heading(parts)))
    return F.coalesce(headed, let(_filled_lines(whole), dense), trim_space(F.substring(whole, 1, 500)))


def title_and_abstract(papers: DataFrame) -> DataFrame:
    """(name, title, abstract) of (name, first_page, pages); null texts are empty."""
    return papers.select("name", title_of("first_page").alias("title"), abstract_of("pages").alias("abstract"))


def append_missing(sheet: DataFrame, files: DataFrame, today: str) -> DataFrame:
    """The sheet of DOIs by hand (name, doi, added) with a row for each file that it lacks."""
    new = files.select("name").distinct().join(sheet.select("name"), "name", "left_anti")
    return sheet.unionByName(new.select("name", F.lit("").alias("doi"), F.lit(today).alias("added")))


def update_renamed(sheet: DataFrame, renamed: DataFrame, today: str) -> DataFrame:
    """The sheet after renames (original, new, doi).

    A new name that is there changes nothing; an original that is there takes the new name, and the
    DOI where it had none, and keeps its date; else there is a new row.
    """
    open_ = renamed.join(sheet.select(F.col("name").alias("new")), "new", "left_anti")
    joined = sheet.join(open_.select(F.col("original").alias("name"), "new", F.col("doi").alias("_doi")), "name", "left")
    kept = joined.select(F.coalesce("new", "name").alias("name"), F.coalesce(filled("doi"), F.col("_doi"), F.col("doi")).alias("doi"), "added")
    fresh = open_.join(sheet.select(F.col("name").alias("original")), "original", "left_anti")
    return kept.unionByName(fresh.select(F.col("new").alias("name"), "doi", F.lit(today).alias("added")))


def first_success(attempts: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(value, method) of the first attempt that gave something; ``attempts`` are (method, column) in order."""
    value = F.coalesce(*(filled(c) for _, c in attempts))
    method = F.coalesce(*(F.when(filled(c).isNotNull(), m) for m, c in attempts))
    return value, method


# Parts of names of models that don't chat.
NO_CHAT = ["embedding", "image", "tts", "audio", "live", "vision"]


def chat_models(models: DataFrame, family: str = "gemini", kind: str = "flash") -> DataFrame:
    """(name, rank) of a family's models of one kind, newest version first, then the shortest name."""
    name = F.regexp_replace("id", "^[^/]*/", "")
    fits = F.lower(name).startswith(family) & F.lower(name).contains(kind)
    for x in NO_CHAT:
        fits = fits & ~F.lower(name).contains(x)
    version = F.transform(F.split(F.regexp_extract(F.lower(name), family + r"-(\d+(?:\.\d+)*)", 1), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    found = models.where(fits).select(name.alias("name"), version.alias("v")).distinct()
    return found.select("name", F.row_number().over(Window.orderBy(F.desc("v"), F.length("name"), "name")).alias("rank"))
