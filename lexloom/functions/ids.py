"""Identifiers: DOIs in their several forms, years, paper ids, file stems, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import col, let
from lexloom.functions.text import file_name, filled, short_title, slug

DOI_TEXT = r"(?i)\b(10\.\d{4,9}/[-._;(),<>/:A-Z0-9]+)\b"
DOI_VALID = r"^10\.\d{4,9}/\S+$"
DOI_URL = r"(?i)^https?://(dx\.)?doi\.org/"


def doi_valid(doi) -> Column:
    return F.coalesce(F.trim(col(doi)), F.lit("")).rlike(DOI_VALID)


def doi_tail(doi) -> Column:
    """Without closing signs, and without words glued to the end: ``2-Gwithin`` is ``2-G``, ``48Abstract`` is ``48``."""
    x = F.regexp_replace(F.trim(col(doi)), r"[).,;\]}>]+$", "")
    x = F.regexp_replace(x, r"^[(\[<{]+", "")
    x = F.regexp_replace(x, r"(-[a-zA-Z])[a-zA-Z]{2,}$", "$1")
    return F.regexp_replace(x, r"([0-9])[a-zA-Z]{3,}$", "$1")


def doi(value, mode: str) -> Column:
    """A DOI normalised the way that its place of use does.

    registry: trimmed and lower case. corpus: also without URL and closing slashes. plain: as corpus,
    case kept. screen: URL anywhere removed, empty unless valid. provenance: lower case, URL anywhere
    removed, no closing slashes. extract: URL at the start removed, case kept, trimmed again. text: the
    first DOI in a text, its tail cleaned. filename: the DOI of a name, its first underscore a slash.
    loose: as text, lower case, empty where there is none.
    """
    x = F.trim(F.coalesce(col(value).cast("string"), F.lit("")))
    anywhere = r"https?://(dx\.)?doi\.org/"
    if mode == "registry":
        return F.lower(x)
    if mode == "corpus":
        return F.regexp_replace(F.regexp_replace(F.lower(x), DOI_URL, ""), "/+$", "")
    if mode == "plain":
        return F.regexp_replace(F.regexp_replace(x, DOI_URL, ""), "/+$", "")
    if mode == "screen":
        bare = F.trim(F.regexp_replace(x, anywhere, ""))
        return F.when(bare.rlike(r"(?i)^10\.\d{4,9}/\S+"), bare).otherwise("")
    if mode == "provenance":
        return F.regexp_replace(F.regexp_replace(F.lower(x), anywhere, ""), "/+$", "")
    if mode == "extract":
        return F.regexp_replace(F.trim(F.regexp_replace(x, DOI_URL, "")), "/+$", "")
    if mode == "text":
        bare = F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("\x00"), F.lit(" ")), f"(?i){anywhere}", ""), r"(?i)\bdoi\s*:\s*", "")
        return F.nullif(doi_tail(F.regexp_extract(bare, DOI_TEXT, 1)), F.lit(""))
    if mode == "filename":
        name = F.regexp_replace(x, r"(?i)\.pdf$", "")
        found = lambda n, pattern: let(F.regexp_extract(n, pattern, 1), lambda r: F.nullif(r, F.lit("")))
        raw = let(name, lambda n: F.coalesce(found(n, r"\[(10\.\d{4,9}_[^\]]+)\]"), found(n, r"^(10\.\d{4,9}_\S+)$")))
        return let(doi(F.regexp_replace(raw, "^([^_]*)_", "$1/"), "plain"), lambda r: F.nullif(r, F.lit("")))
    if mode == "loose":
        return F.lower(F.coalesce(doi(value, "text"), F.lit("")))
    raise ValueError(f"no DOI mode {mode!r}")


DOI_MODES = ("registry", "corpus", "plain", "screen", "provenance", "extract", "text", "filename", "loose")


def doi_file(value) -> Column:
    """A DOI as part of a file name."""
    return F.regexp_replace(F.regexp_replace(F.replace(col(value), F.lit("/"), F.lit("_")), r'[\x00-\x1f\x7f\\*?:"<>|]', ""), r"^[ .]+|[ .]+$", "")


def _year(value, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(col(value).cast("string"), F.lit("")), pattern, 1), F.lit("")).cast("int")


def year_in_id(value) -> Column:
    """The first 1900-2039 in an id, also inside longer digit runs."""
    return _year(value, r"(19\d{2}|20[0-3]\d)")


def year_bounded(value) -> Column:
    """As ``year_in_id``, but not inside longer digit runs."""
    return _year(value, r"(?<!\d)(19\d{2}|20[0-3]\d)(?!\d)")


def year_in_text(value) -> Column:
    return _year(value, r"\b((?:19|20)\d{2})\b")


def year_number(value) -> Column:
    return col(value).cast("string").try_cast("int")


def surname_of(authors) -> Column:
    """The first author's surname, else the last word of the full name, else empty."""
    first = F.get(authors, F.lit(0))
    full = F.split(F.trim(F.coalesce(first["full"], F.lit(""))), r"(?U)\s+")
    return F.coalesce(filled(first["surname"]), F.element_at(full, -1), F.lit(""))


def paper_id(year, authors, title) -> Column:
    """``year_surname_short_title``; what is missing is 0000, unknownauthor, untitled."""
    surname = let(slug(surname_of(authors)), lambda s: F.coalesce(F.nullif(s, F.lit("")), F.lit("unknownauthor")))
    name = F.concat_ws("_", F.coalesce(F.nullif(col(year).cast("string"), F.lit("0")), F.lit("0000")), surname, let(filled(title), lambda t: short_title(F.coalesce(t, F.lit("untitled")))))
    return F.regexp_replace(file_name(F.concat(name, F.lit(".pdf"))), r"\.pdf$", "")


def canonical_name(value) -> Column:
    return col(value).rlike(r"^\d{4}_[a-z0-9]+_.+")


def clean_stem(value) -> Column:
    """Lower case and without a DOI inside."""
    return (col(value) == F.lower(col(value))) & ~col(value).rlike(r"_10_\d{4,5}_")


# Fields that name a paper's file, in order of trust, and endings that are not part of its stem.
STEM_FIELDS = ("paper_id", "source_file", "pdf_file", "filename", "file", "source_pdf", "tei_file")
STEM_ENDINGS = r"(?i)(\.tei\.xml|\.clean\.md|\.summary\.md|\.chunks\.jsonl|\.jsonl|\.xml|\.pdf)$"


def infer_stem(columns: list[str]) -> Column:
    """The stem of the first field that is filled, of those that there are."""
    named = [filled(F.col(c).cast("string")) for c in STEM_FIELDS if c in columns]
    return F.regexp_replace(F.regexp_extract(F.coalesce(*named, F.lit("")), r"[^/]*$", 0), STEM_ENDINGS, "")


def short_hash(value, n: int = 12) -> Column:
    return F.substring(F.sha1(col(value)), 1, n)


def content_hash(text, settings: str = "") -> Column:
    return F.sha2(F.concat(F.coalesce(col(text).cast("string"), F.lit("")), F.lit(settings)), 256)


def pii(url) -> Column:
    return F.nullif(F.upper(F.regexp_extract(F.coalesce(col(url), F.lit("")), r"(?i)/pii/([A-Z0-9]{17,18})", 1)), F.lit(""))


# Publishers by part of their addresses, in order.
PUBLISHERS = {
    "elsevier": ["sciencedirect.com", "elsevier.com"],
    "springer": ["springer.com"],
    "wiley": ["wiley.com"],
    "taylor_francis": ["tandfonline.com"],
    "mdpi": ["mdpi.com"],
}


def publisher(url) -> Column:
    x, out = F.lower(F.coalesce(col(url), F.lit(""))), F.lit("unknown")
    for name, parts in reversed(PUBLISHERS.items()):
        hit = F.lit(False)
        for p in parts:
            hit = hit | x.contains(p)
        out = F.when(hit, name).otherwise(out)
    return out


def is_pdf(content) -> Column:
    return F.hex(F.substring(col(content), 1, 4)) == "25504446"
