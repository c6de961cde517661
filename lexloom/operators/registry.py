"""The registry of papers still to get: upsert, snooze, block, reconcile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions import ids
from lexloom.operators.dedup import least_by

# The columns of the registry in order, and the states that an upsert leaves alone.
COLUMNS = ("doi", "title", "year", "category", "landing_url", "status", "reason", "last_checked", "notes", "snooze_until")
RESOLVED = ("downloaded", "manual", "duplicate", "wrong_document", "blocked")
REFRESHED = ("title", "year", "category", "landing_url", "reason", "last_checked")


def shaped(rows: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """All columns in order, as text; those that are missing or null are empty."""
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns))


def _key(name: str = "doi") -> Column:
    return ids.doi(name, "registry")


def _touched(registry: DataFrame, dois: DataFrame, changes: dict[str, Column], condition: Column | None = None) -> DataFrame:
    """``registry`` with changes where the DOI is among ``dois`` (and the condition holds)."""
    known = dois.select(_key().alias("_k")).where("_k != ''").distinct().withColumn("_hit", F.lit(True))
    joined = registry.withColumn("_k", _key()).join(known, "_k", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & (condition if condition is not None else F.lit(True))
    return joined.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in COLUMNS))


def upsert(registry: DataFrame, rows: DataFrame, today: str, seq: str = "seq") -> DataFrame:
    """New DOIs come in as pending; pending ones are refreshed; resolved ones, notes and snoozes stay.

    Rows apply in order of ``seq``: the first decides the spelling of a new DOI, the last its values.
    """
    given = rows.withColumn("_k", _key()).where("_k != ''")
    text = lambda c, n=None: F.substring(x, 1, n) if n and (x := F.coalesce(F.col(c).cast("string"), F.lit(""))) is not None else F.coalesce(F.col(c).cast("string"), F.lit(""))
    landing = F.coalesce(F.col("landing_url").cast("string"), F.concat(F.lit("https://doi.org/"), F.trim("doi"))) if "landing_url" in rows.columns else F.concat(F.lit("https://doi.org/"), F.trim("doi"))
    entry = given.select("_k", seq, F.trim("doi").alias("n_doi"), text("title", 300).alias("n_title"), text("year").alias("n_year"), text("category").alias("n_category"), landing.alias("n_landing_url"), text("reason", 200).alias("n_reason"))
    values = F.struct("n_title", "n_year", "n_category", "n_landing_url", "n_reason")
    new = entry.groupBy("_k").agg(F.max_by(values, seq).alias("last"), F.min_by("n_doi", seq).alias("n_doi")).select("_k", "last.*", "n_doi", F.lit(today).alias("n_last_checked"))
    both = registry.withColumn("_k", _key()).withColumn("_old", F.lit(True)).join(new, "_k", "full")
    old, fresh = F.col("_old").isNotNull(), F.col("n_doi").isNotNull()
    refresh = old & fresh & ~F.col("status").isin(*RESOLVED)

    def value(c: str) -> Column:
        mine = F.col(f"n_{c}") if c in (*REFRESHED, "doi") else F.lit("pending") if c == "status" else F.lit("")
        kept = F.when(refresh, mine).otherwise(F.col(c)) if c in REFRESHED else F.col(c)
        return F.when(old, kept).otherwise(mine).alias(c)

    return both.select(*map(value, COLUMNS))


def mark_downloaded(registry: DataFrame, dois: DataFrame, today: str) -> DataFrame:
    return _touched(registry, dois, {"status": F.lit("downloaded"), "last_checked": F.lit(today)})


# The note of a reconciled row.
RECONCILED = "reconciliado: DOI ya en el corpus"


def reconcile(registry: DataFrame, corpus: DataFrame, today: str) -> DataFrame:
    """Pending rows whose DOI the corpus has become downloaded."""
    changes = {"status": F.lit("downloaded"), "last_checked": F.lit(today), "notes": F.lit(RECONCILED)}
    return _touched(registry, corpus, changes, F.col("status") == "pending")


def snooze(registry: DataFrame, dois: DataFrame, today: str, years: int = 2, note: str = "") -> DataFrame:
    until = F.date_format(F.date_add(F.lit(today).cast("date"), 365 * years), "yyyy-MM-dd")
    return _touched(registry, dois, {"snooze_until": until} | ({"notes": F.lit(note)} if note else {}))


def unsnooze(registry: DataFrame, dois: DataFrame) -> DataFrame:
    return _touched(registry, dois, {"snooze_until": F.lit("")})


# Fixed value: the note of a row that came in by being blocked.
BLOCKED = "vetado manualmente (no estaba en el registro)"


def block(registry: DataFrame, rows: DataFrame, today: str, reason: str = "") -> DataFrame:
    """DOIs become blocked, and come in if they are new; snoozes stay as they are."""
    changed = _touched(registry, rows, {"status": F.lit("blocked"), "reason": F.lit(reason[:200]), "last_checked": F.lit(today)})
    fresh = least_by(rows.withColumn("_k", _key()).where("_k != ''"), ["_k"], [F.col("doi")]).join(registry.select(_key().alias("_k")), "_k", "left_anti")
    fixed = {"doi": F.trim("doi"), "status": F.lit("blocked"), "reason": F.lit(reason[:200]), "last_checked": F.lit(today), "notes": F.lit(BLOCKED), "landing_url": F.concat(F.lit("https://doi.org/"), F.trim("doi"))}
    take = lambda c: fixed[c] if c in fixed else F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    return changed.unionByName(fresh.select(*(take(c).alias(c) for c in COLUMNS)))


def unblock(registry: DataFrame, dois: DataFrame, today: str) -> DataFrame:
    return _touched(registry, dois, {"status": F.lit("pending"), "last_checked": F.lit(today)}, F.col("status") == "blocked")


def active(registry: DataFrame, today: str) -> DataFrame:
    """Pending and not snoozed beyond today; dates compare as text."""
    until = F.trim("snooze_until")
    return registry.where((F.col("status") == "pending") & ((until == "") | (until <= today))).orderBy("category", F.desc("last_checked"), "doi")


def blocked_dois(registry: DataFrame) -> DataFrame:
    return registry.where("status = 'blocked'").select(_key().alias("doi")).where("doi != ''").distinct()


def known_dois(papers: DataFrame, names: DataFrame) -> DataFrame:
    """DOIs of metadata and those inside file names."""
    a, b = papers.select(_some(ids.doi("doi", "corpus")).alias("doi")), names.select(_some(F.lower(ids.doi("name", "filename"))).alias("doi"))
    return a.unionByName(b).distinct()


def _some(doi: Column) -> Column:
    """A row for a DOI that is there. A filter would be computed again, also on other tables whose keys it is made of."""
    return F.explode(F.filter(F.array(doi), lambda x: x != ""))


def download_plan(rows: DataFrame, blocked: DataFrame, corpus: DataFrame) -> DataFrame:
    """``rows`` with plan: blocked before known before download, every row kept."""
    keyed = rows.withColumn("_k", _key())
    b, c = blocked.select(_key().alias("_k")).distinct().withColumn("_b", F.lit(1)), corpus.select(_key().alias("_k")).distinct().withColumn("_c", F.lit(1))
    joined = keyed.join(b, "_k", "left").join(c, "_k", "left")
    return joined.withColumn("plan", F.when(F.col("_b").isNotNull(), "blocked").when(F.col("_c").isNotNull(), "known").otherwise("download")).drop("_k", "_b", "_c")


def doi_origins(papers: DataFrame, files: DataFrame) -> DataFrame:
    """(doi, origin) over metadata first and file names after, the first of each."""
    a = papers.select(_some(ids.doi("doi", "corpus")).alias("doi"), F.col("origin"), F.lit(0).alias("turn"))
    b = files.select(_some(F.lower(ids.doi("name", "filename"))).alias("doi"), F.col("name").alias("origin"), F.lit(1).alias("turn"))
    return least_by(a.unionByName(b), ["doi"], [F.col("turn"), F.col("origin")]).select("doi", "origin")


def with_outcome(rows: DataFrame, outcomes: DataFrame, on: str = "row_id") -> DataFrame:
    """``rows`` with status and method of their download by row number; a row without an outcome is pending."""
    return rows.join(outcomes.select(on, "status", "method"), on, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def split_pending(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that are downloaded, rows that are not)."""
    done = F.col("status") == "downloaded"
    return rows.where(done), rows.where(~done)


def feed_back(registry: DataFrame, rows: DataFrame, today: str, seq: str = "row_id") -> DataFrame:
    """The registry after a download: what failed comes in or is refreshed with its status as reason, what came is marked."""
    done, pending = split_pending(rows)
    asked = pending.drop("reason").withColumn("reason", F.col("status")).drop("status")
    return mark_downloaded(upsert(registry, asked, today, seq), done, today)
