"""Duplicates of papers: by DOI, title and content, which one to keep, and screening of new batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions import ids
from lexloom.functions.text import key, title_key
from lexloom.operators.ranking import checkpointed, numbered, running_max

LEAST_TITLE = 10
#: Rows, at most about, that a task sorts.
TASK_ROWS = 250_000
PREFIX = 60


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each group of ``keys``: the first in ``order``, which must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def least_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """As ``first_by`` for an ascending order with nulls first, by partial minima: a group may be any share of the rows."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns))


def most_cited(hits: DataFrame, doi: str = "doi", cited: str = "cited_by", seq: str = "seq") -> DataFrame:
    """The most cited row of each DOI, earlier ones first at ties; rows without DOI all stay."""
    n = F.coalesce(F.col(cited).cast("string").try_cast("long"), F.lit(0))
    has = F.coalesce(F.trim(doi), F.lit("")) != ""
    return least_by(hits.where(has), [doi], [-n, F.col(seq)]).unionByName(hits.where(~has))


def first_doi(rows: DataFrame, doi: str = "doi", seq: str = "seq") -> DataFrame:
    """The first row of each DOI in lower case; rows without one go."""
    keyed = rows.withColumn("_doi", ids.doi(doi, "corpus")).where(F.col("_doi") != "")
    return least_by(keyed, ["_doi"], [F.col(seq)]).drop("_doi")


def doi_report(rows: DataFrame, doi: str = "doi") -> DataFrame:
    """One row: how many rows have no DOI and how many repeat one."""
    keyed = rows.select(ids.doi(doi, "corpus").alias("d"))
    counts = keyed.groupBy("d").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("d") == "", F.col("n"))), F.lit(0)).alias("n_no_doi"), F.coalesce(F.sum(F.when(F.col("d") != "", F.col("n") - 1)), F.lit(0)).alias("n_duplicates"))


def completeness(columns: list[str]) -> Column:
    """How many of the columns say something."""
    return sum((F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).isin("", "[]", "{}"), 0).otherwise(1) for c in columns), F.lit(0))


def keep_intra_order(stem: str = "stem", score: str = "completeness", line: str = "line_no") -> list[Column]:
    """Clean names first, then the fullest record, then by name and line."""
    return [F.when(ids.clean_stem(stem), 0).otherwise(1), F.desc(score), F.lower(stem), F.col(line)]


def keyword_relevance(text: Column, keywords: dict[str, list[str]], category: str = "category") -> Column:
    """How many keywords of a row's own category its text contains."""
    out = F.lit(0)
    for name, words in keywords.items():
        hits = sum((F.lower(text).contains(w.lower()).cast("int") for w in words), F.lit(0))
        out = F.when(F.col(category) == name, hits).otherwise(out)
    return out


def decide(papers: DataFrame, across: bool = False) -> DataFrame:
    """(doi, duplicate_type, keep_category, keep_stem, remove_category, remove_stem, remove_line).

    ``papers`` has doi, category, stem, line_no, completeness and relevance. Within a category one
    paper of a DOI stays. Across categories, if asked for, the representatives of the categories
    compete: a unique most relevant one wins, else clean name, category, completeness, name, line. A row is
    removed once. Rows without DOI or stem take no part.
    """
    known = papers.where((F.coalesce("doi", F.lit("")) != "") & (F.coalesce("stem", F.lit("")) != ""))
    known = known.repartition(max(int(papers.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // TASK_ROWS)), "doi")  # all windows lie within a DOI
    inside = Window.partitionBy("doi", "category").orderBy(*keep_intra_order())
    ranked = known.withColumn("n", F.row_number().over(inside)).withColumn("keep_stem", F.first("stem").over(inside))
    intra = ranked.where("n > 1").select("doi", F.lit("intra").alias("duplicate_type"), F.col("category").alias("keep_category"), "keep_stem", F.col("category").alias("remove_category"), F.col("stem").alias("remove_stem"), F.col("line_no").alias("remove_line"))
    if not across:
        return intra
    of = Window.partitionBy("doi")
    best = ranked.where("n = 1").withColumn("most", F.max("relevance").over(of)).withColumn("at_most", F.count_if(F.col("relevance") == F.col("most")).over(of))
    # count_if sees the window's maximum, computed in the projection before
    alone = (F.col("most") > 0) & (F.col("at_most") == 1) & (F.col("relevance") == F.col("most"))
    order = Window.partitionBy("doi").orderBy(F.when(alone, 0).otherwise(1), F.when(ids.clean_stem("stem"), 0).otherwise(1), F.lower("category"), F.desc("completeness"), F.lower("stem"), "line_no")
    chosen = best.withColumn("m", F.row_number().over(order)).withColumn("keep_category", F.first("category").over(order)).withColumn("keep_stem", F.first("stem").over(order))
    cross = chosen.where("m > 1").select("doi", F.lit("cross").alias("duplicate_type"), "keep_category", "keep_stem", F.col("category").alias("remove_category"), F.col("stem").alias("remove_stem"), F.col("line_no").alias("remove_line"))
    return intra.unionByName(cross)


def title_groups(papers: DataFrame, title: str = "title", doi: str = "doi", category: str = "category") -> DataFrame:
    """(category, norm_title, n): one title at least twice in a category, unless with two different DOIs.

    Titles under ten characters, normalised, are left out.
    """
    keyed = papers.select(category, title_key(title).alias("norm_title"), F.nullif(ids.doi(doi, "corpus"), F.lit("")).alias("d")).where(F.length("norm_title") >= LEAST_TITLE)
    groups = keyed.groupBy(category, "norm_title").agg(F.count("*").alias("n"), F.count_distinct("d").alias("n_dois"))
    found = groups.where("n >= 2 and n_dois < 2").select(category, "norm_title", "n")
    return found


def content_groups(docs: DataFrame, content: str = "text", category: str = "source") -> DataFrame:
    """(category, sha256, n) of contents that a category has at least twice."""
    return docs.where(F.col(content).isNotNull()).groupBy(F.col(category), F.sha2(F.col(content).cast("string"), 256).alias("sha256")).agg(F.count("*").alias("n")).where("n >= 2")


def content_losers(docs: DataFrame, id_col: str, content: str = "text", category: str = "source") -> DataFrame:
    """Rows to remove: all but one of equal contents in a category, a clean name first, then the least name."""
    name = F.col(id_col).cast("string")
    order = F.struct(F.when(ids.clean_stem(name), 0).otherwise(1), F.lower(name), F.col(id_col))
    hashed = docs.where(F.col(content).isNotNull()).withColumn("_h", F.sha2(F.col(content).cast("string"), 256))
    # The one that stays is found by partial minima, so that a thousand copies are no task's burden.
    kept = hashed.groupBy(F.col(category).alias("_c"), F.col("_h").alias("_k")).agg(F.min_by(F.col(id_col), order).alias("_keep"))
    same = hashed[category].eqNullSafe(kept["_c"]) & (hashed["_h"] == kept["_k"]) & (hashed[id_col] != kept["_keep"])
    return hashed.join(kept, same, "left_semi").drop("_h")


def default_keep(members: DataFrame, group: str, seq: str = "seq") -> DataFrame:
    """(group, keep, risky): one with a PDF first, then a clean name, then in order; risky with two PDFs or two DOIs."""
    order = Window.partitionBy(group).orderBy(F.col("has_pdf").desc(), F.when(ids.clean_stem("stem"), 0).otherwise(1), F.col(seq))
    top = members.withColumn("_n", F.row_number().over(order))
    return top.groupBy(group).agg(F.max(F.when(F.col("_n") == 1, F.col("stem"))).alias("keep"), ((F.count_if("has_pdf") >= 2) | (F.count_distinct(F.nullif(F.col("doi"), F.lit(""))) >= 2)).alias("risky"))


def apply_decisions(papers: DataFrame, decisions: DataFrame) -> DataFrame:
    """``papers`` without the rows that decisions remove, by category, stem and line."""
    gone = decisions.select(F.col("remove_category").alias("category"), F.col("remove_stem").alias("stem"), F.col("remove_line").alias("line_no"))
    return papers.join(gone, ["category", "stem", "line_no"], "left_anti")


def screen_batch(batch: DataFrame, corpus: DataFrame) -> DataFrame:
    """``batch`` with its outcome: duplicate_doi, duplicate_hash, duplicate_batch, kept or kept_no_doi.

    Both have doi and sha256; batch has name, in whose order it is screened. A DOI of the corpus
    comes first, then a content of the corpus, then a DOI that the batch has kept before; rows
    without DOI are kept, equal ones too.
    """
    keyed = batch.withColumn("_doi", ids.doi("doi", "corpus"))
    known_doi = corpus.select(ids.doi("doi", "corpus").alias("_doi")).where(F.col("_doi") != "").distinct().withColumn("_in_corpus", F.lit(True))
    known_hash = corpus.select("sha256").where(F.col("sha256").isNotNull()).distinct().withColumn("_same_content", F.lit(True))
    seen = keyed.join(known_hash, "sha256", "left")
    # Rows without DOI, however many, meet no other row.
    free = seen.where("_doi = ''").withColumn("outcome", F.when(F.col("_same_content"), "duplicate_hash").otherwise("kept_no_doi"))
    named = seen.where("_doi != ''").join(known_doi, "_doi", "left")
    new = F.col("_in_corpus").isNull() & F.col("_same_content").isNull()
    nth = F.row_number().over(Window.partitionBy("_doi", new).orderBy("name"))
    outcome = F.when(F.col("_in_corpus"), "duplicate_doi").when(F.col("_same_content"), "duplicate_hash").when(F.col("_nth") > 1, "duplicate_batch").otherwise("kept")
    named = named.withColumn("_nth", nth).withColumn("outcome", outcome)
    columns = [*batch.columns, "outcome"]
    return free.select(*columns).unionByName(named.select(*columns))


def matches_by_prefix(names: DataFrame, known: DataFrame, name: str = "name", known_name: str = "known") -> DataFrame:
    """(name, known): equal keys, or a name that goes on after a known key of at least 60 characters.

    Long keys join by their first 60 characters, so no name meets every key.
    """
    a, b = names.select(name, key(name).alias("k")), known.select(known_name, key(known_name).alias("m"))
    exact = a.join(b, F.col("k") == F.col("m")).select(name, known_name)
    long_ = b.where(F.length("m") >= PREFIX).withColumn("p", F.substring("m", 1, PREFIX))
    begun = a.where(F.length("k") >= PREFIX).withColumn("p", F.substring("k", 1, PREFIX)).join(long_, "p").where(F.col("k").startswith(F.col("m"))).select(name, known_name)
    return exact.unionByName(begun).distinct()


def same_paper(papers: DataFrame, others: DataFrame) -> DataFrame:
    """(id, other_id, by): the least other id with equal content, else that with the same DOI. Both have id, sha256 and doi."""
    a = papers.select("id", "sha256", ids.doi("doi", "corpus").alias("d"))
    b = others.select(F.col("id").alias("other_id"), "sha256", ids.doi("doi", "corpus").alias("d"))

    def least_two(rows: DataFrame, on: str) -> DataFrame:  # one of two different ids is another's
        low = F.min("other_id").alias("low")
        first = rows.groupBy(on).agg(low)
        second = rows.join(first, on).where("other_id != low").groupBy(on).agg(F.min("other_id").alias("next"))
        return first.join(second, on, "left")

    other = F.when(F.col("low") != F.col("id"), F.col("low")).otherwise(F.col("next"))
    by_hash = a.where("sha256 IS NOT NULL").join(least_two(b.where("sha256 IS NOT NULL").select("sha256", "other_id"), "sha256"), "sha256").select("id", other.alias("other_id"), F.lit(0).alias("turn"))
    by_doi = a.where("d != ''").join(least_two(b.where("d != ''").select("d", "other_id"), "d"), "d").select("id", other.alias("other_id"), F.lit(1).alias("turn"))
    best = least_by(by_hash.unionByName(by_doi).where("other_id IS NOT NULL"), ["id"], [F.col("turn"), F.col("other_id")])
    return best.select("id", "other_id", F.when(F.col("turn") == 0, "hash").otherwise("doi").alias("by"))


def unique_names(rows: DataFrame, name: str, seq: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with unique_name: in order of ``seq`` each takes its name, else the first of name_2, name_3, ... that is free.

    Rows of one name are numbered where they stand. Only where a name ends in a number, as ``a_2``
    beside ``a``, can rows of different names want the same: all propose at once, the first in order
    holds a name, the others go on to the next that nobody before them holds, and so on until no
    row is turned away. That gives what going through the rows one by one gives, since rows of one
    name want the same names in the same order and whoever turns a row away has come before it. No
    group is one task's. Names must not be null.
    """
    columns = [*rows.columns, "unique_name"]
    keyed = rows.withColumn("_root", F.regexp_replace(name, r"(_\d+)+$", ""))
    family = [*within, "_root"]
    odd = keyed.where(F.col(name) != F.col("_root")).select(*family).distinct()
    own = F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), F.col("_n")))

    def placed(df: DataFrame) -> DataFrame:
        return numbered(df, [F.col(seq)], "_n", [*within, name]).withColumn("_n", F.col("_n") + 1)

    plain = placed(keyed.join(odd, family, "left_anti")).withColumn("unique_name", own).select(*columns)
    ordered = numbered(keyed.join(odd, family, "left_semi"), [F.col(seq), F.col(name)], "_o")
    now = checkpointed(placed(ordered).withColumn("_j", F.col("_n")))
    while True:
        asked = now.withColumn("unique_name", own)
        first = F.min(F.struct("_o", F.col(name).alias("by")))
        held = checkpointed(asked.groupBy(*within, "unique_name").agg(first.alias("_f")).select(*within, "unique_name", F.col("_f._o").alias("_h"), F.col("_f.by").alias("_by")))
        turned = asked.join(held, [*within, "unique_name"]).where(F.col("_o") > F.col("_h")).select("_o", "_n")
        if not turned.limit(1).count():
            return plain.unionByName(asked.select(*columns))
        # Numbers of each name that rows of others hold, in runs without a gap.
        number = F.regexp_extract("unique_name", r"_([1-9]\d{0,17})$", 1)
        taken = held.where(number != "").select(*within, F.regexp_replace("unique_name", r"_\d+$", "").alias(name), number.cast("long").alias("_n"), "_h", "_by").where((F.col("_by") != F.col(name)) & (F.col("_n") > 1))
        run = taken.withColumn("_run", F.col("_n") - F.row_number().over(Window.partitionBy(*within, name).orderBy("_n")))  # numbers, not rows
        whole = run.groupBy(*within, name, "_run").agg(F.max("_n").alias("_end"), F.max("_h").alias("_last"))
        ends = run.join(whole, [*within, name, "_run"]).select(*within, name, "_n", "_end", "_last")
        on = [*within, name, "_n"]
        moved = now.join(turned.select("_o", F.lit(True).alias("_t")), "_o", "left").join(ends, on, "left")
        after = F.when(F.col("_last") < F.col("_o"), F.col("_end") + 1).otherwise(F.col("_n") + 1)  # a run that ends before a row is none of its own
        step = moved.withColumn("_d", F.when(F.col("_t"), after).otherwise(F.col("_n")) - F.col("_j")).drop("_t", "_end", "_last")
        # Of rows of one name each wants a later number than the one before it.
        now = checkpointed(running_max(step, [*within, name], [F.col("_j")], "_d").withColumn("_n", F.col("_d") + F.col("_j")).drop("_d"))
