"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the text over its actual share. Each document inverts
the Poisson distribution of that mean at a uniform number hashed from its id and the seed, is
repeated that often, and all repeats are shuffled globally by a hashed key. Documents decide
by themselves, so nothing but one sum for each source crosses between them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed, table

SEED = 17
#: The columns of ``documents``.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")
#: Target weights are text shares to this power when none are given: 1 keeps the mix, 0 evens it out.
TEMPERATURE = 0.7
#: The greatest mean that is drawn at once: higher rates are sums of equal parts, each with a number of its own.
MOST_RATE = 8.0
#: The rates of up to so many sources go to all tasks; those of more join by source.
MOST_BROADCAST = 100_000
#: Characters of text in a partition of the mix, at most, about.
TASK_CHARS = 128 << 20
#: Terms of the distribution function; beyond them its rest is under 1e-12 at MOST_RATE.
TERMS = 40


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the MD5 of the keys: 52 bits, the same in any SQL engine."""
    text = F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(u: Column, mean: Column, terms: int = TERMS) -> Column:
    """How many values of the distribution function lie at or below ``u``: the inverse at ``u``."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.struct(p.alias("p"), (a["c"] + p).alias("c"), (a["n"] + F.when(u >= a["c"], 1).otherwise(0)).alias("n"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda a: a["n"])


def copies(mean: Column, *keys: Column) -> Column:
    """A Poisson number of any mean: the sum over parts of at most MOST_RATE, drawn at hashed numbers of their own."""
    parts = F.greatest(F.lit(1), F.ceil(mean / MOST_RATE).cast("int"))
    share = mean / parts
    more = F.aggregate(F.sequence(F.lit(1), parts - 1), F.lit(0), lambda n, j: n + poisson(uniform(*keys, j), share))
    return poisson(uniform(*keys), share) + F.when(parts > 1, more).otherwise(0)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, size: str | None = None) -> DataFrame:
    """(source, rate, chars) of every source: target share of the characters over actual share, and the characters.

    With ``weights``, a source that is not named gets none. Sources without any text count as
    one character, so that they have a rate too. A null source is a source of its own. A rate has
    no bound: a small source is repeated until it has its share. ``size`` names a column of
    characters where the text itself isn't at hand.
    """
    chars = F.col(size) if size else F.length(F.col("text").cast("string"))
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.greatest(F.sum(F.coalesce(chars, F.lit(0)).cast("long")), F.lit(1)).alias("chars"))
    if weights is None:
        target = F.pow(F.col("chars").cast("double"), F.lit(temperature))
    else:
        target = reduce(lambda c, kv: c.when(F.col("source") == kv[0], F.lit(float(kv[1]))), weights.items(), F.when(F.lit(False), F.lit(0.0))).otherwise(F.lit(0.0))
    wanted = sizes.withColumn("target", target)
    total = wanted.agg(F.sum(F.col("chars").cast("double")).alias("all_chars"), F.sum("target").alias("all_targets"))
    rate = F.col("target") / F.col("all_targets") * F.col("all_chars") / F.col("chars")
    return wanted.crossJoin(F.broadcast(total)).select("source", F.when(F.col("all_targets") > 0, rate).otherwise(0.0).alias("rate"), "chars")  # total is one row


def replicate(docs: DataFrame, rate: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count of ``rate``; adds _rate, _copy and _shuffle_key.

    Rows that repeat a doc_id get the same count each. A null doc_id counts as the empty id. An
    empty table gives no rows. Sources may be few or many: their rates join by source.
    """
    rate = rate.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    if rate.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        rate = F.broadcast(rate)
    joined = docs.join(rate, F.col("source").cast("string").eqNullSafe(F.col("_source"))).drop("_source")
    n = copies(F.col("_rate"), F.lit(seed), F.lit("count"), F.col("doc_id"))
    repeats = joined.withColumn("_n", n).where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return repeats.withColumn("_shuffle_key", uniform(F.lit(seed), F.lit("order"), F.col("doc_id"), F.col("_copy")))


def shuffled(mixed: DataFrame, n_chars: int = 0) -> DataFrame:
    """In order of the hashed key over all partitions, ties by doc_id and copy; no rows give none.

    Keys are uniform in [0, 1), so equal ranges of them are equal partitions; no pass over the
    data looks for their bounds. There are as many as ``n_chars`` of text ask for, and as the
    session has at the least.
    """
    n = max(int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_chars // TASK_CHARS))
    return mixed.repartitionById(n, F.floor(F.col("_shuffle_key") * n).cast("int")).sortWithinPartitions("_shuffle_key", "doc_id", "_copy")


def draws(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The mixed and shuffled documents as structs ``row``, with the _rate, _copy and _shuffle_key of each.

    Null texts count as no characters, a null source as one of its own, a null doc_id as the empty
    id; repeated rows get the same count each, ties of the key go by doc_id and copy, and an empty
    table gives no rows.
    """
    rows = docs.select("doc_id", "source", F.length(F.col("text").cast("string")).cast("long").alias("chars"), F.struct(*docs.columns).alias("row"))
    rate = checkpointed(rates(rows, weights, temperature, "chars"))
    expected = rate.agg(F.sum(F.col("rate") * F.col("chars"))).first()[0] or 0
    return shuffled(replicate(rows, rate, seed), int(expected))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """The mixed and shuffled documents, in the columns of ``docs``.

    Null texts count as no characters, a null source as one of its own, a null doc_id as the empty
    id. Repeated rows get the same count each, ties of the key go by doc_id and copy, and an empty
    table gives no rows.
    """
    return draws(docs, weights, temperature, seed).select("row.*")


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of OP5_SQL, taken from whole documents after the global shuffle; the digest is of all their columns."""
    docs = table(spark, sf_dir, "documents")
    mixed = draws(docs)
    whole = F.concat_ws("|", *(F.coalesce(F.col(f"row.{c}").cast("string"), F.lit("")) for c in DOCUMENT))
    columns = F.col("row.doc_id"), F.col("row.source"), F.col("_copy").cast("long").alias("copy"), F.round("_rate", 9).alias("rate"), F.col("_shuffle_key").alias("shuffle_key")
    return mixed.select(*columns, F.length("row.text").cast("long").alias("chars"), F.sha2(whole, 256).alias("row_sha256"))


OP5_SQL = f"""
WITH sizes AS (
  SELECT source, greatest(sum(coalesce(length(text), 0)), 1) AS chars FROM documents GROUP BY source),
rates AS (
  SELECT source, pow(chars::DOUBLE, {TEMPERATURE}) / sum(pow(chars::DOUBLE, {TEMPERATURE})) OVER () * sum(chars::DOUBLE) OVER () / chars AS rate FROM sizes),
shares AS (
  SELECT source, rate, greatest(1, ceil(rate / {MOST_RATE}))::INT AS parts, rate / greatest(1, ceil(rate / {MOST_RATE})) AS share FROM rates),
numbered AS (
  SELECT *, row_number() OVER () AS r, sha256({" || '|' || ".join(f"coalesce({c}::VARCHAR, '')" for c in DOCUMENT)}) AS row_sha256 FROM documents),
drawn AS (
  SELECT d.r, d.source, unnest(range(parts)) AS j, coalesce(d.doc_id::VARCHAR, '') AS id FROM numbered d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source),
hashed AS (
  SELECT r, source, ('0x' || substr(md5('{SEED}|count|' || id || CASE WHEN j > 0 THEN '|' || j ELSE '' END), 1, 13))::BIGINT / {float(1 << 52)} AS u FROM drawn),
terms AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT source, k, exp(-share) * pow(share, k) / gamma(k + 1) AS p FROM shares, range({TERMS}) t(k))),
counted AS (
  SELECT r, count(t.k) AS n FROM hashed h LEFT JOIN terms t ON h.source IS NOT DISTINCT FROM t.source AND h.u >= t.c GROUP BY r)
SELECT doc_id, source, copy, round(rate, 9) AS rate,
       ('0x' || substr(md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy), 1, 13))::BIGINT / {float(1 << 52)} AS shuffle_key,
       length(text) AS chars, row_sha256
FROM (SELECT d.*, s.rate, unnest(range(n)) AS copy FROM numbered d JOIN counted USING (r) JOIN shares s ON d.source IS NOT DISTINCT FROM s.source WHERE n > 0)
"""
