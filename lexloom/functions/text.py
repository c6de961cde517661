"""Text as columns: folding, tokens, white space, names and titles.

Java's ``\\w`` and ``\\s`` know ASCII only, so patterns that must know Unicode begin with ``(?U)``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import col, let


def _fold_pairs() -> tuple[str, str]:
    """Letters from U+00C0 to U+024F (and the micro sign) that fold to one other character."""
    pairs = [("µ", "μ")]
    for code in range(0xC0, 0x250):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
        if len(plain) == len(c.lower()) == 1 and plain != c.lower():
            pairs.append((c.lower(), plain))
    pairs = list(dict.fromkeys(pairs))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _fold_pairs()


def fold(text) -> Column:
    """Lower case without accents; ASCII texts take the short way."""
    low = F.lower(F.coalesce(col(text), F.lit("")))
    marks = F.regexp_replace(F.translate(low, _FROM, _TO), "[̀-ͯ]", "")
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(marks)


def strip_accents(text) -> Column:
    """Without accents, case kept."""
    pairs = [(a.upper(), b.upper()) for a, b in zip(_FROM, _TO, strict=True) if len(a.upper()) == 1]
    upper, to = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
    return F.regexp_replace(F.translate(F.translate(F.coalesce(col(text), F.lit("")), _FROM, _TO), upper, to), "[̀-ͯ]", "")


def fold_fully(text) -> Column:
    """Full compatibility folding (ligatures, superscripts, any script), by batches in Python."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda x: "".join(c for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c)))

    return run(col(text))


# The token alphabet of the lexical index.
TOKEN = "[a-z0-9α-ω]+(?:-[a-z0-9α-ω]+)*"
SEGMENT = "[a-zα-ω]+|[0-9]+"
#: What a text has where any of its tokens has parts.
JOINT = "[a-zα-ω][0-9]|[0-9][a-zα-ω]|[a-z0-9α-ω]-[a-z0-9α-ω]"


def tokens(text) -> Column:
    """Tokens of folded text; a hyphenated one also by parts, a mixed one also by letters and digits."""

    def segments(part: Column) -> Column:
        found = F.regexp_extract_all(part, F.lit(SEGMENT), F.lit(0))
        return F.when(F.size(found) > 1, found).otherwise(F.array().cast("array<string>"))

    def expand(raw: Column) -> Column:
        parts = F.split(raw, "-")
        own = F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))
        return F.when(raw.rlike("^[a-zα-ω]+$|^[0-9]+$"), F.array(raw)).otherwise(F.concat(F.array(raw), own, F.flatten(F.transform(parts, segments))))

    def found(folded: Column) -> Column:
        raw = F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))
        return F.when(folded.rlike(JOINT), F.flatten(F.transform(raw, expand))).otherwise(raw)

    return F.get(F.transform(F.array(fold(text)), found), F.lit(0))  # folded once


# Words that only Spanish has among the two languages of queries.
SPANISH_WORDS = ["de", "la", "el", "en", "para", "con", "que", "del", "los", "las", "una", "un", "es", "por", "se", "cual", "como"]
SPANISH_LETTERS = "[ñáéíóúü]"


def spanish_hits(text) -> Column:
    hits = F.size(F.array_intersect(F.array_distinct(tokens(text)), F.array(*map(F.lit, SPANISH_WORDS))))
    return hits + F.lower(F.coalesce(col(text), F.lit(""))).rlike(SPANISH_LETTERS).cast("int")


def looks_spanish(text) -> Column:
    """At least two signs: different Spanish words, and any accented letter as one more."""
    return spanish_hits(text) >= 2


def norm_space(text) -> Column:
    """Line ends as newlines, runs of blanks as one, three or more newlines as two, trimmed."""
    x = F.regexp_replace(F.coalesce(col(text), F.lit("")), "\r\n?", "\n")
    x = F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\n{3,}", "\n\n")
    return trim_space(x)


def norm_blank(text) -> Column:
    """All white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", " "))


def trim_space(text) -> Column:
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def words(text) -> Column:
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), r"(?U)\s+"), lambda w: w != "")


def filled(value) -> Column:
    """The value, or null where it is blank."""
    return F.nullif(F.trim(col(value)), F.lit(""))


def key(text) -> Column:
    """Comparison key: all but a-z and 0-9 as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def stem(text) -> Column:
    """Lower case, with blanks, dots, hyphens and commas as one underscore."""
    x = F.lower(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)[\s.\-,]+", "_"))
    return F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_+|_+$", "")


def slug(text) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.lower(strip_accents(text)), "&", " and "), "['’`´]", "")
    x = F.regexp_replace(F.trim(F.regexp_replace(x, r"[^a-z0-9\s\-]", " ")), r"[\s\-]+", "_")
    return F.regexp_replace(F.regexp_replace(x, "_+", "_"), "^_+|_+$", "")


def safe_slug(text, most: int = 120) -> Column:
    """Word characters of any script, the rest as underscores, cut to ``most``."""
    x = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(col(text), F.lit(""))), r"(?U)[^\w\-]+", "_"), "_+", "_")
    return F.substring(F.regexp_replace(x, "^_+|_+$", ""), 1, most)


# Words that a short title leaves out.
TITLE_STOPWORDS = [
    "a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "with", "without", "via", "using", "use",
    "towards", "toward", "over", "under", "through", "during", "between",
    "de", "del", "la", "el", "los", "las", "y", "en", "por", "para", "con", "sin", "sobre", "un", "una", "unos", "unas",
]


def short_title(text, most: int = 8) -> Column:
    plain = F.regexp_replace(F.lower(strip_accents(text)), r"[^a-z0-9\s]", " ")

    def chosen(every: Column) -> Column:
        telling = F.filter(every, lambda w: ~w.isin(TITLE_STOPWORDS))
        return let(telling, lambda t: F.when(F.size(t) > 0, t).otherwise(every))

    return let(let(words(plain), chosen), lambda w: F.when(F.size(w) > 0, F.array_join(F.slice(w, 1, most), "_")).otherwise("untitled"))


def file_name(text, most: int = 180) -> Column:
    """A name without forbidden characters; a longer one keeps ``most`` - 4 characters and ends in .pdf."""
    x = F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), r'[<>:"/\\|?*]', "_"), r"(?U)\s+", "_")
    x = F.regexp_replace(F.regexp_replace(x, "_+", "_"), r"^[._ ]+|[._ ]+$", "")
    return let(x, lambda x: F.when(F.length(x) > most, F.concat(F.substring(F.regexp_replace(x, r"\.[^.]*$", ""), 1, most - 4), F.lit(".pdf"))).otherwise(x))


def clean_name(text, most: int = 150) -> Column:
    """A file name without control characters, path signs or double dots."""
    x = F.regexp_replace(F.coalesce(col(text), F.lit("")), r'[\x00-\x1f\x7f\\/*?:"<>|]', "")
    x = F.trim(F.regexp_replace(F.replace(x, F.lit(".."), F.lit("")), r"(?U)\s+", " "))
    return F.regexp_replace(F.substring(x, 1, most), r"[ .]+$", "")


def title_key(title, mode: str = "words") -> Column:
    """Four ways to compare titles.

    words: lower case without signs; ascii: a-z and 0-9 only; fold: without accents;
    stem: words after composing, which agrees with ``words`` on composed text.
    """
    x = F.lower(F.coalesce(col(title), F.lit("")))
    if mode in ("words", "stem"):
        return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))
    if mode == "ascii":
        return F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))
    if mode == "fold":
        return F.trim(F.regexp_replace(fold(title), r"(?U)\s+", " "))
    raise ValueError(f"no title mode {mode!r}")


# Section labels by words of the heading, in order; the first that is contained wins.
SECTIONS = {
    "abstract": ["abstract"],
    "introduction": ["introduction", "background", "motivation"],
    "methods": ["method", "material", "experiment", "procedure", "setup", "approach", "protocol", "design", "operational"],
    "results": ["result", "finding", "performance", "measurement", "characterization", "evaluation", "removal", "efficiency"],
    "discussion": ["discussion"],
    "conclusion": ["conclusion", "summary", "outlook", "future", "perspective"],
}


def section(title) -> Column:
    """The canonical section of a heading, ``other`` where no word fits."""
    x, out = F.lower(F.coalesce(col(title), F.lit(""))), None
    for name, parts in SECTIONS.items():
        hit = F.lit(False)
        for p in parts:
            hit = hit | x.contains(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def approx_tokens(chars) -> Column:
    return F.greatest(F.lit(1), F.floor(col(chars) / 4).cast("int"))
