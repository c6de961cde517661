"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histograms of character classes and of common words are held against the
mean histograms of whole languages, over all other documents, by Jensen-Shannon distance. The
closest language counts, whatever the document names, of those whose script can be the text's:
where none is, as for a text in Cyrillic among Latin ones, the distances give no verdict. A
language is a reference where enough documents name it. Texts too short for a histogram pass, and
the word test holds only for documents that name one of four languages or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed, table

SPACE = r"[\x20\x09-\x0D]+"
#: Frequent short words of four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "was", "on", "with", "be"],
    "fr": ["le", "la", "les", "et", "des", "une", "est", "pour", "qui", "dans"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "mit", "den", "von", "zu"],
    "es": ["el", "los", "las", "que", "y", "del", "por", "con", "una", "para"],
}
WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
LANGUAGES = sorted(COMMON_WORDS)
#: Greatest distances (0 to 1) from the closest language.
MOST_CLASS, MOST_WORD = 0.3, 0.6
#: Below so many characters or common words a histogram says nothing.
LEAST_CHARS, LEAST_COMMON = 200, 30
LEAST_WORDS = 50
#: Bits for a window's place beside its hash; texts with more words have their windows sorted as they are.
PLACES = 20
#: Documents of LEAST_CHARS from which a language is a reference; each of them counts alike, so a few long odd ones don't tell.
LEAST_DOCS = 20
#: How far UTF-8's further bytes of a character, on average, may be from a reference's for both to be of one script.
SCRIPT = 0.4
CLASSES = 7
#: Up to so many further references go into the plan as values; more go to all tasks as one array. A text meets each of them either way.
MOST_REFERENCES = 200


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice.

    Windows are sorted as hashes that carry their place, and neighbours are compared. Where two
    neighbours have one hash but other words, the windows themselves are sorted.
    """
    low = (1 << PLACES) - 1

    def places(w):
        return F.sequence(F.lit(0), F.size(w) - 3)

    def hashes(w):
        return F.transform(places(w), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))

    def same(x, y):
        return F.shiftright(x, PLACES) == F.shiftright(y, PLACES)

    def window(w, x):
        i = x.bitwiseAND(F.lit(low)).cast("int")
        return F.struct(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def twins(s):
        return F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))

    def of_hashes(w, t):
        met = F.exists(F.transform(t, lambda x, j: same(x, F.get(t, j + 1)) & (window(w, x) != window(w, F.get(t, j + 1)))), lambda x: x)
        return F.when(F.size(t) == 0, F.lit(0)).when(F.coalesce(met, F.lit(False)), of_windows(w)).otherwise(covered(F.sort_array(F.transform(t, lambda x: x.bitwiseAND(F.lit(low)).cast("int")))))

    def of_windows(w):
        sorted_ = F.sort_array(F.transform(places(w), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i"))))
        return let(let(sorted_, lambda s: F.filter(s, lambda x, j: (x["g"] == F.get(s, j - 1)["g"]) | (x["g"] == F.get(s, j + 1)["g"]))), lambda t: covered(F.sort_array(F.transform(t, lambda x: x["i"]))))

    def covered(p):
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(p, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])

    def count(w):
        return F.when(F.size(w) < 4, F.lit(0)).when(F.size(w) > low, of_windows(w)).otherwise(let(let(F.sort_array(hashes(w)), twins), lambda t: of_hashes(w, t)))

    return let(words, count).cast("long")


def features(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, lang, the base counts, character classes and common-word counts of whole texts, and ``row`` where it is given."""
    rest = [] if row is None else [row.alias("row")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"), *rest)
    words = one.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    lines = let(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    common = let(F.filter("words", lambda w: w.isin(WORDS)), lambda c: F.transform(F.array(*map(F.lit, WORDS)), lambda b: F.size(c) - F.size(F.array_remove(c, b))))
    count = lambda pattern: F.regexp_count(F.col("text"), F.lit(pattern)).cast("long")
    out = words.select(
        *(["row"] if rest else []),
        "doc_id",
        "lang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length("text").cast("long").alias("n_chars"),
        (F.octet_length("text") - F.length("text")).cast("long").alias("n_wide"),
        count("[#*$%&|<>]").alias("n_symbols"),
        count("[A-Z]").alias("n_upper"),
        count("[0-9]").alias("n_digit"),
        count("[.,;:!?]").alias("n_stop"),
        lines.cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        common.alias("common"),
    )
    kinds = F.array(*(F.col(c) for c in ("n_symbols", "n_upper", "n_digit", "n_stop", "n_wide")), F.col("n_chars") - F.col("word_chars"))
    return out.withColumn("classes", let(kinds, lambda k: F.concat(k, F.array(F.greatest(F.lit(0).cast("long"), F.col("n_chars") - F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a + x))))))


def shape(counts: Column, n_chars: Column, n_wide: Column) -> Column:
    """Shares of the classes and the further bytes of a character, of a document; null for one too short."""
    return F.when(n_chars >= LEAST_CHARS, let(total(counts), lambda t: F.concat(F.transform(counts, lambda x: x / t), F.array(n_wide / n_chars))))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)


def references(found: DataFrame) -> DataFrame:
    """(ref_lang, ref_n, ref_shape, ref_common) of each language that enough documents name: sums of their shapes and of all common words."""
    sums = lambda c, n: F.array(*(F.coalesce(F.sum(F.get(c, F.lit(i))).cast("double"), F.lit(0.0)) for i in range(n)))
    grouped = found.where(F.col("lang").isNotNull()).groupBy(F.col("lang").alias("ref_lang")).agg(F.count("shape").alias("ref_n"), sums("shape", CLASSES + 1).alias("ref_shape"), sums("common", len(WORDS)).alias("ref_common"))
    return grouped.where(F.col("ref_n") >= LEAST_DOCS)


def class_distance(counts: Column, own_shape: Column, n: Column, sums: Column, own: Column) -> Column:
    """Distance from the mean of a reference's other documents; null where they are of another script."""
    mean = F.when(own, F.zip_with(sums, own_shape, lambda s, x: F.greatest(s - x, F.lit(0.0)) / (n - 1))).otherwise(F.transform(sums, lambda s: s / n))

    def held(m):
        fits = F.abs(F.get(own_shape, F.lit(CLASSES)) - F.get(m, F.lit(CLASSES))) <= SCRIPT
        return F.when(fits, distance(counts, F.slice(m, 1, CLASSES)))

    return let(mean, held)


def distance(counts: Column, share: list[float] | Column) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram with rows from a reference."""
    zero = F.lit(0.0)

    def term(p, q):
        m = (p + q) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(zero)
        return (part(p) + part(q)) / 2

    def divergence(c):
        return let(total(c), lambda s: F.aggregate(F.zip_with(c, share if isinstance(share, Column) else F.array(*map(F.lit, share)), lambda p, q: term(p / s, q)), zero, lambda a, x: a + x))

    return F.sqrt(F.greatest(zero, divergence(counts)))


def judge(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """One row per document: the base counts, distances from the closest language, and the verdict.

    A null or empty text has no words and fails the base rules. Rows that repeat are judged each
    for itself; an empty table gives none. A text is held against every reference of its script,
    without its own part in the one that it names; where there is none, only the base rules
    count. The common words of a text in a language beyond the fixed list don't count. Other
    columns are not read, but ``row`` goes along where it is given.
    """
    doubles = lambda c: F.transform(F.col(c), lambda x: x.cast("double"))
    found = checkpointed(features(docs, row).withColumn("shape", shape(doubles("classes"), F.col("n_chars"), F.col("n_wide"))))
    sums = checkpointed(references(found))
    four = sums.where(F.col("ref_lang").isin(LANGUAGES)).collect()
    further = sums.where(~F.col("ref_lang").isin(LANGUAGES)).limit(MOST_REFERENCES + 1).collect()
    planned = four + (further if len(further) <= MOST_REFERENCES else [])
    least = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0] if xs else F.lit(None).cast("double")  # noqa: E731  # null is no distance, not the least
    literal = lambda xs: F.array(*map(F.lit, xs))
    known = F.col("lang").eqNullSafe
    apart = [class_distance(doubles("classes"), F.col("shape"), F.lit(r.ref_n), literal(r.ref_shape), known(r.ref_lang)) for r in planned]
    if len(further) > MOST_REFERENCES:
        rest = sums.where(~F.col("ref_lang").isin(LANGUAGES)).agg(F.collect_list(F.struct("ref_lang", "ref_n", "ref_shape")).alias("refs"))
        found = found.crossJoin(F.broadcast(rest))  # one row, of about 100 bytes a language
        apart.append(F.when(F.col("shape").isNotNull(), F.array_min(F.transform("refs", lambda r: class_distance(doubles("classes"), F.col("shape"), r["ref_n"], r["ref_shape"], known(r["ref_lang"]))))))
    by_class = F.when(F.col("shape").isNotNull(), least(apart))
    guard_word = (F.aggregate("common", F.lit(0), lambda a, x: a + x) >= LEAST_COMMON) & (F.col("lang").isNull() | F.col("lang").isin(LANGUAGES))
    shares = [[x / sum(r.ref_common) for x in r.ref_common] for r in four if sum(r.ref_common)]
    by_word = F.when(guard_word, least([distance(doubles("common"), w) for w in shares]))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MOST_CLASS) | (F.coalesce("word_distance", F.lit(0.0)) > MOST_WORD)
    judged = found.withColumns({"class_distance": by_class, "word_distance": by_word, "base_failed": base})
    return judged.select(*([] if row is None else ["row"]), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "class_distance", "word_distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, in the columns of ``docs``; each row is judged where it stands.

    Null and empty texts go, and so do rows of any doc_id, null ones too, that fail; repeated rows
    stay or go together. An empty table gives no rows.
    """
    return judge(docs, F.struct(*docs.columns)).where("kept").select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _distance_sql(counts: str, share: str) -> str:
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z.p + z.q) / 2)) ELSE 0 END"
    pairs = f"list_transform(list_zip({counts}, {share}), lambda z: {{'p': z[1]::DOUBLE / list_sum({counts}), 'q': z[2]}})"
    term = f"({part('z.p')} + {part('z.q')}) / 2"
    return f"sqrt(greatest(0, list_sum(list_transform({pairs}, lambda z: {term}))))"


OP9_SQL = f"""
WITH w AS (SELECT doc_id, lang, row_number() OVER () AS r, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM documents),
g AS (SELECT r, unnest(list_transform(range(1, greatest(1, len(w) - 1)), lambda i: {{'i': i, 'g': w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]}})) AS s FROM w),
n AS (SELECT r, s.i AS i, count(*) OVER (PARTITION BY r, s.g) AS n FROM g),
c AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM n WHERE n >= 2) GROUP BY r),
b AS (SELECT doc_id, lang, r, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) AS n_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  [len(regexp_extract_all(text, '[#*$%&|<>]')), len(regexp_extract_all(text, '[A-Z]')), len(regexp_extract_all(text, '[0-9]')), len(regexp_extract_all(text, '[.,;:!?]')), strlen(text) - length(text), length(text) - length(array_to_string(w, ''))] AS k,
  list_transform({WORDS}, lambda x: len(list_filter(w, lambda y: y = x))) AS common FROM w LEFT JOIN c USING (r)),
f AS (SELECT *, list_concat(k, [greatest(0, n_chars - list_sum(k))::BIGINT]) AS classes FROM b),
v AS (SELECT r, lang, classes, list_concat(list_transform(classes, lambda x: x::DOUBLE / list_sum(classes)), [(strlen(text) - length(text))::DOUBLE / n_chars]) AS shape FROM f WHERE n_chars >= {LEAST_CHARS}),
rc AS (SELECT lang, n, list(s ORDER BY i) AS sums FROM (SELECT lang, i, count(*) AS n, sum(shape[i]) AS s FROM v, range(1, {CLASSES + 2}) x(i) WHERE lang IS NOT NULL GROUP BY lang, i HAVING count(*) >= {LEAST_DOCS}) GROUP BY lang, n),
rw AS (SELECT lang, list(s / t ORDER BY i) AS share FROM (SELECT lang, i, sum(common[i])::DOUBLE AS s, sum(sum(common[i])) OVER (PARTITION BY lang)::DOUBLE AS t FROM f, range(1, {len(WORDS) + 1}) x(i) WHERE lang IN {tuple(LANGUAGES)} AND lang IN (SELECT lang FROM rc) GROUP BY lang, i) WHERE t > 0 GROUP BY lang),
held AS (SELECT r, classes, shape, CASE WHEN v.lang = rc.lang THEN list_transform(list_zip(sums, shape), lambda z: greatest(z[1] - z[2], 0) / (n - 1)) ELSE list_transform(sums, lambda x: x / n) END AS share FROM v, rc),
dc AS (SELECT r, min({_distance_sql("classes", f"share[1:{CLASSES}]")}) AS dc FROM held WHERE abs(shape[{CLASSES + 1}] - share[{CLASSES + 1}]) <= {SCRIPT} GROUP BY r),
dw AS (SELECT r, min({_distance_sql("common", "rw.share")}) AS dw FROM f, rw WHERE list_sum(common) >= {LEAST_COMMON} AND (f.lang IS NULL OR f.lang IN {tuple(LANGUAGES)}) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND coalesce(dc, 0) <= {MOST_CLASS} AND coalesce(dw, 0) <= {MOST_WORD} AS kept FROM f LEFT JOIN dc USING (r) LEFT JOIN dw USING (r)
"""
