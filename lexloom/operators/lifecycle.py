"""Papers over time: soft deletion and restoring, renaming, merging trees, status and orphans.

Tables are immutable, so a deletion is a row in a table of tombstones that reads are held
against, and a rename is a mapping that is joined to every table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import ids
from lexloom.functions.text import filled, key
from lexloom.operators.dedup import least_by, unique_names


def visible(table: DataFrame, tombstones: DataFrame, on: list[str] | None = None) -> DataFrame:
    """What isn't deleted."""
    on = on or ["category", "paper_id"]
    return table.join(tombstones.select(*on).distinct(), on, "left_anti")


def quarantine(tombstones: DataFrame, papers: DataFrame, reason: str, now: str) -> DataFrame:
    """More tombstones; a paper that has one keeps it."""
    new = papers.select("category", "paper_id").distinct().join(tombstones, ["category", "paper_id"], "left_anti")
    return tombstones.unionByName(new.select("category", "paper_id", F.lit(reason).alias("reason"), F.lit(now).alias("deleted_at")))


def restore(tombstones: DataFrame, papers: DataFrame) -> DataFrame:
    return tombstones.join(papers.select("category", "paper_id"), ["category", "paper_id"], "left_anti")


def purge(table: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The table without what is deleted, for good."""
    return visible(table, tombstones)


def quarantine_list(tombstones: DataFrame) -> DataFrame:
    return tombstones.orderBy(F.desc("deleted_at"), "category", "paper_id")


def purge_by_doi(papers: DataFrame, dois: DataFrame, order: str = "category") -> DataFrame:
    """``papers`` without those DOIs, each from the first category in order that has it."""
    wanted = dois.select(ids.doi("doi", "corpus").alias("_d")).where("_d != ''").distinct()
    hits = papers.withColumn("_d", ids.doi("doi", "corpus")).join(wanted, "_d", "left_semi")
    first = hits.groupBy("_d").agg(F.min(order).alias(order))
    gone = hits.join(first, ["_d", order]).select("category", "paper_id")
    return papers.join(gone, ["category", "paper_id"], "left_anti")


class TakenError(ValueError):
    """A rename to an id that is there already, or two to one."""


def rename(tables: dict[str, DataFrame], renames: DataFrame, check: str) -> dict[str, DataFrame]:
    """Every table with new ids by (category, old_id, new_id).

    ``check`` names the table whose ids must be free; nothing is renamed if one is taken. A stable_id
    follows only where it was the old id. A path follows where its file begins with the old id.
    """
    targets = renames.select("category", F.col("new_id").alias("paper_id"))
    taken = targets.join(tables[check].select("category", "paper_id"), ["category", "paper_id"], "left_semi").join(renames.select("category", F.col("old_id").alias("paper_id")), ["category", "paper_id"], "left_anti")
    twice = targets.groupBy("category", "paper_id").count().where("count > 1").drop("count")
    if found := taken.unionByName(twice).limit(3).collect():
        raise TakenError(", ".join(f"{r.category}/{r.paper_id}" for r in found))
    out = {}
    for name, table in tables.items():
        joined = table.join(renames.select("category", F.col("old_id").alias("paper_id"), "new_id"), ["category", "paper_id"], "left")
        new: dict[str, Column] = {"paper_id": F.coalesce("new_id", "paper_id")}
        if "stable_id" in table.columns:
            new["stable_id"] = F.when(F.col("new_id").isNotNull() & (F.col("stable_id") == F.col("paper_id")), F.col("new_id")).otherwise(F.col("stable_id"))
        for c in ("source_pdf", "source_tei", "source_md_clean", "tei_file"):
            if c in table.columns:
                folder, base = F.regexp_extract(c, "^(.*/)?", 0), F.regexp_extract(c, "[^/]*$", 0)
                moved = F.concat(folder, "new_id", F.substr(base, F.length("paper_id") + 1))
                new[c] = F.when(F.col("new_id").isNotNull() & base.startswith(F.col("paper_id")), moved).otherwise(F.col(c))
        out[name] = joined.select(*(new[c].alias(c) if c in new else F.col(c) for c in table.columns))
    return out


def rename_preview(papers: DataFrame) -> DataFrame:
    """(category, paper_id, new_id, changes): canonical ids by year, surname and title, made unique in a category."""
    made = papers.withColumn("_base", ids.paper_id(F.col("year"), F.col("authors"), F.col("title")))
    named = unique_names(made.select("category", "paper_id", "_base"), "_base", "paper_id", ("category",))
    return named.select("category", "paper_id", F.col("unique_name").alias("new_id"), (F.col("unique_name") != F.col("paper_id")).alias("changes"))


def merge_tree(target: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    """The target with what it lacks of the source; at conflicts the target stays."""
    return target.unionByName(source.join(target.select(*on), on, "left_anti"), allowMissingColumns=True)


def update_fields(papers: DataFrame, patches: DataFrame) -> DataFrame:
    """New values by (category, paper_id); an empty one clears journal and doi only, and null means no change."""
    fields = [c for c in ("title", "journal", "year", "doi") if c in patches.columns]
    p = patches.select("category", "paper_id", *(F.col(c).alias(f"_{c}") for c in fields))
    joined = papers.join(p, ["category", "paper_id"], "left")

    def value(c: str) -> Column:
        new, old = F.col(f"_{c}"), F.col(c)
        given = new.isNotNull() if c in ("journal", "doi") else filled(new.cast("string")).isNotNull()
        return F.when(given, new).otherwise(old)

    return joined.select(*(value(c).alias(c) if c in fields else F.col(c) for c in papers.columns))


def status(papers: DataFrame, **artefacts: DataFrame) -> DataFrame:
    """(category, paper_id, a flag for each artefact, complete): which tables of (category, name) have a paper's key."""
    out = papers.select("category", "paper_id").distinct().withColumn("_k", key("paper_id"))
    for name, table in artefacts.items():
        have = table.select("category", key("name").alias("_k")).distinct().withColumn(f"has_{name}", F.lit(True))
        out = out.join(have, ["category", "_k"], "left").withColumn(f"has_{name}", F.coalesce(f"has_{name}", F.lit(False)))
    every = F.lit(True)
    for name in artefacts:
        every = every & F.col(f"has_{name}")
    return out.withColumn("complete", every).drop("_k")


def orphans(table: DataFrame, others: DataFrame, name: str = "name") -> DataFrame:
    """Rows whose key the other table hasn't."""
    keyed = table.withColumn("_k", key(name))
    return keyed.join(others.select(key(name).alias("_k")).distinct(), "_k", "left_anti").drop("_k")


def mismatches(pdfs: DataFrame, texts: DataFrame, name: str = "name") -> DataFrame:
    """(name, missing): texts without a PDF and PDFs without a text."""
    a, b = orphans(texts, pdfs, name), orphans(pdfs, texts, name)
    return a.select(name, F.lit("pdf").alias("missing")).unionByName(b.select(name, F.lit("text").alias("missing")))


def processable(tei: DataFrame, texts: DataFrame, pdfs: DataFrame | None = None, name: str = "name") -> DataFrame:
    """TEI rows that have a text, and a PDF where there is a table of PDFs."""
    out = tei.withColumn("_k", key(name)).join(texts.select(key(name).alias("_k")), "_k", "left_semi")
    if pdfs is not None:
        out = out.join(pdfs.select(key(name).alias("_k")), "_k", "left_semi")
    return out.drop("_k")


def copy_selected(wanted: DataFrame, corpus: DataFrame, project: DataFrame) -> DataFrame:
    """(doi, name, outcome) of wanted DOIs: existing in the project, copied from the corpus, or not_found."""
    w = wanted.select(ids.doi("doi", "corpus").alias("doi")).where("doi != ''").distinct()
    have = least_by(corpus.select(ids.doi("doi", "corpus").alias("doi"), "name"), ["doi"], [F.col("name")])
    there = project.select("name").distinct().withColumn("_there", F.lit(True))
    return w.join(have, "doi", "left").join(there, "name", "left").select("doi", "name", F.when(F.col("name").isNull(), "not_found").when(F.col("_there"), "existing").otherwise("copied").alias("outcome"))


def split_rows(sidecar: DataFrame, papers: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows of the papers) of a side table, by key."""
    keyed, gone = sidecar.withColumn("_k", key(column)), papers.select(key("paper_id").alias("_k")).distinct()
    return keyed.join(gone, "_k", "left_anti").drop("_k"), keyed.join(gone, "_k", "left_semi").drop("_k")


def last_snapshots(snapshots: DataFrame, keep: int = 12) -> DataFrame:
    return snapshots.orderBy(F.desc("taken_at")).limit(keep)


def changed_files(files: DataFrame, before: DataFrame) -> DataFrame:
    """(path, digest) of files whose content is new since the last snapshot."""
    now = files.select("path", F.sha2(F.col("content"), 256).alias("digest"))
    return now.join(before.select("path", "digest"), ["path", "digest"], "left_anti")
