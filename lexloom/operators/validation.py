"""Rules for bibliographic records, comparison with a lookup service, and dismissals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lexloom.functions import ids
from lexloom.functions.blocks import matching_ratios
from lexloom.functions.text import filled, stem
from lexloom.operators.ranking import let

# Words of an affiliation, and surnames of a proceedings' editors.
AFFILIATION = [
    "university", "universidad", "universitat", "universite", "institute", "instituto", "institut",
    "department", "dept", "faculty", "school", "laboratory", "laboratories", "lab", "college", "center", "centre",
    "gmbh", "inc", "ltd", "llc", "corp", "dtu", "lyngby", "denmark", "spain", "china", "germany", "netherlands",
]
EDITORS = ["how", "andiappan", "ng", "lam", "varbanov", "klemeš", "klemes", "walmsley", "tan"]  # fixed values: a default, see ``issues``
EDITORS_DOI = "10.3303/"
FLAGGING = ("medium", "high")
LEAST_RATIO, LEAST_OVERLAP, LEAST_JOURNAL = 0.85, 0.5, 8

ISSUE = "struct<code: string, field: string, severity: string>"
AUTHOR = "struct<full: string, forename: string, surname: string>"


def _issue(condition: Column, code: str, field: str, severity: str) -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(severity).alias("severity")))


def author_names(authors="authors") -> Column:
    """Names as shown: forename and surname, else the full name; blank ones go."""
    value = F.coalesce(F.col(authors) if isinstance(authors, str) else authors, F.expr("array()").cast(f"array<{AUTHOR}>"))
    name = lambda a: F.coalesce(filled(F.concat_ws(" ", filled(a["forename"]), filled(a["surname"]))), filled(a["full"]))
    return F.filter(F.transform(value, name), lambda x: x.isNotNull())


def last_word(name: Column) -> Column:
    return F.element_at(F.split(F.trim(name), r"(?U)\s+"), -1)


def title_is_journal(title: Column, journal: Column) -> Column:
    """Of stems."""
    return (title != "") & (title == journal)


def title_begins_with_journal(title: Column, journal: Column) -> Column:
    """Of stems."""
    return (F.length(journal) >= LEAST_JOURNAL) & (title != journal) & title.startswith(F.concat(journal, F.lit("_")))


def issues(this_year: int) -> Column:
    """All local issues of a record with title, journal, authors, year and doi. Stems and names are made once for each record."""

    def found(v: Column) -> Column:
        names = v["names"]
        glued = F.exists(names, lambda n: ~n.rlike(r"(?U)\s") & n.rlike("[a-z][A-Z]"))
        placed = F.exists(names, lambda n: n.rlike(r"\d") | n.rlike(r"(?iU)\b(" + "|".join(AFFILIATION) + r")\b"))
        editors = F.size(F.filter(F.slice(names, 1, 5), lambda n: F.lower(last_word(n)).isin(EDITORS)))
        series = F.lower(F.coalesce("doi", F.lit(""))).startswith(EDITORS_DOI)
        year = ids.year_number("year")
        every = F.array(
            _issue(title_is_journal(v["title"], v["journal"]), "title_eq_journal", "title", "high"),
            _issue(title_begins_with_journal(v["title"], v["journal"]), "title_has_journal_prefix", "title", "medium"),
            _issue(glued, "authors_glued", "authors", "info"),
            _issue(placed, "authors_affiliation", "authors", "high"),
            _issue((editors >= 3) | (series & (editors >= 2)), "authors_editors", "authors", "high"),
            _issue(year.isNull() | ~year.between(1900, this_year + 1), "year_implausible", "year", "medium"),
            _issue(filled("doi").isNotNull() & ~ids.doi_valid("doi"), "doi_malformed", "doi", "high"),
        )
        return F.filter(every, lambda x: x.isNotNull())

    return let(F.struct(stem("title").alias("title"), stem("journal").alias("journal"), author_names().alias("names")), found)


def drop_dismissed(rows: DataFrame, dismissed: DataFrame, column: str = "issues") -> DataFrame:
    """Issues without those whose paper and field somebody has verified."""
    marks = dismissed.groupBy(F.col("paper_id").alias("_pid")).agg(F.collect_set("field").alias("_fields"))
    joined = rows.join(marks, F.col("paper_id") == F.col("_pid"), "left")
    kept = F.filter(column, lambda x: ~F.coalesce(F.array_contains(F.col("_fields"), x["field"]), F.lit(False)))
    return joined.withColumn(column, F.when(F.col("_fields").isNull(), F.col(column)).otherwise(kept)).drop("_pid", "_fields")


def flagged(column: str = "issues") -> Column:
    return F.exists(column, lambda x: x["severity"].isin(*FLAGGING))


def validate(papers: DataFrame, this_year: int, dismissed: DataFrame | None = None) -> DataFrame:
    """Papers with an issue of weight, with all their issues; dismissal comes before the weighing."""
    found = papers.withColumn("issues", issues(this_year))
    if dismissed is not None:
        found = drop_dismissed(found, dismissed)
    return found.where(flagged())


def issue_counts(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("issues.code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


@F.pandas_udf(DoubleType())
def _blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    asked = a.notna()
    out = pd.Series(1.0, index=a.index)
    out[asked] = matching_ratios(a[asked].tolist(), b[asked].tolist())
    return out


def matching_ratio(a: Column, b: Column) -> Column:
    """Twice the matching characters over all, by longest matching blocks; nulls are empty. Edit distance is something else.

    Equal texts, and pairs whose lengths alone keep them under the limit, are not compared.
    """
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    bound = 2 * F.least(F.length(a), F.length(b)) / F.greatest(F.lit(1), F.length(a) + F.length(b))
    asks = (a != b) & (bound >= LEAST_RATIO)
    return F.when(a == b, 1.0).when(bound < LEAST_RATIO, bound).otherwise(_blocks_ratio(F.when(asks, a), F.when(asks, b)))


def surnames(authors: Column) -> Column:
    one = lambda a: stem(F.coalesce(filled(a["surname"]), last_word(filled(a["full"]))))
    return F.filter(F.transform(F.coalesce(authors, F.expr("array()").cast(f"array<{AUTHOR}>")), one), lambda x: x.isNotNull() & (x != ""))


def authors_incomplete(authors="authors") -> Column:
    """No authors, or none with a forename or surname of its own."""
    a = F.col(authors) if isinstance(authors, str) else authors
    return a.isNull() | (F.size(a) == 0) | F.forall(a, lambda x: filled(x["forename"]).isNull() & filled(x["surname"]).isNull())


def year_severity(delta: Column) -> Column:
    return F.when(F.abs(delta) == 1, "low").otherwise("medium")


LOOKUP = ("doi", "title", "journal", "journal_short", "year", "authors")
FOUND = "struct<code: string, field: string, severity: string, kind: string, stored: string, suggested: string>"


def compare(papers: DataFrame, lookup: DataFrame, by_ratio: bool = True) -> DataFrame:
    """Papers of valid DOI with ``found``: what the lookup says otherwise, and ``fetched``: whether it knows the DOI.

    ``lookup`` has doi, title, journal, journal_short, year and authors (family, given), a DOI once.
    ``by_ratio`` holds titles that differ against each other by matching blocks, in Python; without it
    any difference of normalised titles counts.
    """
    theirs = lookup.select(F.lower(F.trim("doi")).alias("_k"), *(F.col(c).alias(f"_{c}") for c in LOOKUP[1:]), F.lit(True).alias("_known"))
    rows = papers.where(ids.doi_valid("doi")).withColumn("_k", F.lower(F.trim("doi"))).join(theirs, "_k", "left").withColumn("fetched", F.col("_known").isNotNull())
    rows = rows.withColumn("_ratio", matching_ratio(stem("title"), stem("_title")) if by_ratio else (stem("title") == stem("_title")).cast("double"))

    def issue(condition: Column, code: str, field: str, severity, kind: str, stored, suggested) -> Column:
        say = lambda x: F.lit(x) if isinstance(x, str) or x is None else x.cast("string")
        return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), say(severity).alias("severity"), F.lit(kind).alias("kind"), say(stored).alias("stored"), say(suggested).alias("suggested")))

    known, title, journal = F.col("fetched"), filled("_title"), filled("_journal")
    short, mine = filled("_journal_short"), filled("journal")
    as_journal = title_is_journal(stem("title"), stem("journal")) | title_begins_with_journal(stem("title"), stem("journal"))
    year, their_year, id_year = ids.year_number("year"), F.nullif(ids.year_number("_year"), F.lit(0)), ids.year_in_id("paper_id")
    their_names = F.filter(F.transform(F.coalesce("_authors", F.expr("array()").cast("array<struct<family:string,given:string>>")), lambda a: stem(last_word(filled(a["family"])))), lambda x: x.isNotNull())
    common = F.size(F.array_intersect(F.array_distinct(surnames(F.col("authors"))), F.array_distinct(their_names)))
    apart = F.size(their_names) > 0
    shown = F.array_join(F.transform("_authors", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"]))), "; ")
    differs = known & mine.isNotNull() & (journal.isNotNull() | short.isNotNull()) & (stem("journal") != stem("_journal")) & (stem("journal") != stem("_journal_short"))
    found = F.array(
        issue(~known, "crossref_miss", "doi", "info", "miss", F.trim("doi"), None),
        issue(known & title.isNotNull() & as_journal, "title_recover", "title", "high", "recover", F.trim("title"), title),
        issue(known & title.isNotNull() & ~as_journal & (F.col("_ratio") < LEAST_RATIO), "title_mismatch", "title", "medium", "mismatch", F.trim("title"), title),
        issue(known & mine.isNull() & (journal.isNotNull() | short.isNotNull()), "journal_fill", "journal", "medium", "fill", "", F.coalesce(journal, short)),
        issue(differs, "journal_mismatch", "journal", "medium", "mismatch", F.trim("journal"), F.coalesce(journal, short)),
        issue(known & their_year.isNotNull() & ~year.eqNullSafe(their_year), "year_mismatch", "year", F.when(year.isNull(), "medium").otherwise(year_severity(their_year - year)), "mismatch", year, their_year),
        issue(their_year.isNull() & id_year.isNotNull() & ~year.eqNullSafe(id_year), "year_mismatch", "year", "medium", "mismatch", year, id_year),
        issue(known & apart & (authors_incomplete() | (common / F.size(F.array_distinct(their_names)) < LEAST_OVERLAP)), "authors_mismatch", "authors", "info", "mismatch", F.array_join(author_names(), "; "), shown),
    )
    return rows.withColumn("found", F.filter(found, lambda x: x.isNotNull())).drop("_k", "_known", "_ratio", *(f"_{c}" for c in LOOKUP[1:]))


def sidecar(papers: DataFrame, lookup: DataFrame, this_year: int, dismissed: DataFrame | None = None, limit: int | None = None, order: str = "paper_id") -> DataFrame:
    """Papers to look at: local issues of weight, a difference from the lookup, or a DOI that it doesn't know.

    ``limit`` bounds how many papers are looked up, in order; the others have no ``found``.
    """
    local = papers.withColumn("issues", issues(this_year))
    valid = papers.where(ids.doi_valid("doi"))
    if limit is not None:
        valid = valid.orderBy(order).limit(limit)
    compared = compare(valid, lookup).select(F.col("paper_id").alias("_pid"), "found", "fetched")
    rows = local.join(compared, F.col("paper_id") == F.col("_pid"), "left").drop("_pid")
    if dismissed is not None:
        rows = drop_dismissed(drop_dismissed(rows, dismissed), dismissed, "found")
    repair = F.exists(F.coalesce("found", F.expr("array()").cast(f"array<{FOUND}>")), lambda x: x["kind"].isin("mismatch", "recover", "fill"))
    missed = F.exists(F.coalesce("found", F.expr("array()").cast(f"array<{FOUND}>")), lambda x: x["code"] == "crossref_miss")
    return rows.where(flagged() | repair | missed)


def stale(issue_field: Column, suggested: Column, current: Column, snapshot: Column) -> Column:
    """Whether an issue no longer applies: the suggestion was taken, or without one the field has changed."""
    same = lambda a, b: F.when(issue_field == "year", ids.year_number(a).eqNullSafe(ids.year_number(b))).otherwise(F.coalesce(F.trim(a), F.lit("")) == F.coalesce(F.trim(b), F.lit("")))
    applies = issue_field.isin("title", "journal", "year")
    return applies & F.when(filled(suggested).isNotNull(), same(current, suggested)).otherwise(~same(current, snapshot))


OVERRIDES = ("category", "paper_id", "field", "date", "note")
OVERRIDE_FIELDS = ("title", "journal", "year", "authors", "doi")


def dismiss(overrides: DataFrame, rows: DataFrame, today: str) -> DataFrame:
    """Overrides with new marks; a mark that is there gets the new date and note. Other fields raise."""
    bad = rows.where(~F.col("field").isin(*OVERRIDE_FIELDS)).limit(1).count()
    if bad:
        raise ValueError(f"only {', '.join(OVERRIDE_FIELDS)} can be dismissed")
    new = rows.select("category", "paper_id", "field", F.lit(today).alias("date"), F.coalesce("note", F.lit("")).alias("note"))
    return overrides.join(new, ["category", "paper_id", "field"], "left_anti").select(*OVERRIDES).unionByName(new)


def undismiss(overrides: DataFrame, rows: DataFrame) -> DataFrame:
    return overrides.join(rows.select("category", "paper_id", "field"), ["category", "paper_id", "field"], "left_anti").select(*OVERRIDES)


def rename_overrides(overrides: DataFrame, renames: DataFrame) -> DataFrame:
    new = renames.select(F.col("old_id").alias("paper_id"), "new_id")
    return overrides.join(new, "paper_id", "left").select("category", F.coalesce("new_id", "paper_id").alias("paper_id"), "field", "date", "note")


def first_calls(papers: DataFrame, limit: int, order: str = "paper_id") -> DataFrame:
    """The papers of valid DOI that a bounded lookup asks for."""
    return papers.where(ids.doi_valid("doi")).orderBy(order).limit(limit)
