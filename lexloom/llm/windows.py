"""Removal of word windows that occur before, by Rabin-Karp hashes of every window.

A word's 64-bit value is a polynomial of its bytes, a window's is a polynomial of its words'
values: the hash of two neighbouring runs follows from theirs, so runs of 1, 2, 4 ... words make up
any length. The sum of other values of the same words names the slice of the hash space.

Documents form batches by ranges of doc_id. A batch sends each different hash once, eight bytes
wide, to its slice, where Spark gathers those of all batches; a slice counts which of them an
earlier range of doc_id has and answers with a bit for each. A batch then knows of each of its
windows whether it starts earlier, in another batch or in itself, and merges such windows into
maximal intervals of words to remove. No window is a group of its own, so a passage that a third
of all documents share is one entry of each batch.

Two windows with other words have the same slice and hash with a chance of 2 ** -64 over the
number of slices, which grows with the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import binary_column, table, text_bytes, tidy_group
from lexloom.llm.suffix import MOST_CUTS, SALTS, TASK_BYTES, batch_number

WINDOW = 20
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text in a batch, and of hashes in a slice, about.
BATCH_BYTES, SLICE_BYTES = 4 << 20, 16 << 20
#: Words whose bytes are hashed at once.
BLOCK_WORDS = 1 << 16
_BYTE, _WORD = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(41).integers(1, (1 << 64) - 1, 256, np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_VALUES[_IS_SPACE] = 0
SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


@dataclass
class Words:
    """All words of consecutive texts: where each starts and stops in the bytes, and its text."""

    body: np.ndarray
    texts: int
    start: np.ndarray
    stop: np.ndarray
    owner: np.ndarray


def words_of(texts: pa.ChunkedArray | pa.Array) -> Words:
    body, offsets = text_bytes(texts)
    word, edge = ~_IS_SPACE[body], np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    outside = np.concatenate(([True], ~word, [True]))
    start = np.flatnonzero(word & (edge[:-1] | outside[:-2]))
    stop = np.flatnonzero(word & (edge[1:] | outside[2:])) + 1
    return Words(body, len(offsets) - 1, start, stop, np.searchsorted(offsets, start, "right") - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def word_values(words: Words) -> np.ndarray:
    """A 64-bit value of each word's bytes."""
    out = np.zeros(len(words.start), np.uint64)
    power = np.ones(1, np.uint64)
    for i in range(0, len(out), BLOCK_WORDS):
        start, stop = words.start[i : i + BLOCK_WORDS], words.stop[i : i + BLOCK_WORDS]
        size = stop - start
        if len(power) < size.max():
            power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * size.max(), _BYTE, np.uint64))), dtype=np.uint64)
        part, first = words.body[start[0] : stop[-1]], start - start[0]
        place = np.arange(len(part)) - np.repeat(first, np.diff(np.concatenate((first, [len(part)]))))
        np.minimum(place, len(power) - 1, out=place)  # only white space, which counts nothing, lies beyond
        out[i : i + BLOCK_WORDS] = _mix(np.add.reduceat(_VALUES[part] * power[place], first) + size.astype(np.uint64) * np.uint64(_WORD))
    return out


def window_hashes(value: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``window`` values, put together from runs of doubling length."""
    if len(value) < window:
        return np.zeros(0, np.uint64)
    run, size, out, have = value, 1, None, 0
    while True:
        if window & size:
            shift = np.uint64(pow(_WORD, have, 1 << 64))
            out = run if out is None else run[: len(out) - size] * shift + out[size:]
            have += size
        if have == window:
            return out[: len(value) - window + 1]
        run = run[:-size] * np.uint64(pow(_WORD, size, 1 << 64)) + run[size:]
        size *= 2


def window_sums(value: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A mixed sum of another value of the words of each run, which doesn't follow from its hash."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(value ^ np.uint64(_BYTE)), dtype=np.uint64)))
    return _mix(total[window:] - total[:-window]) if len(value) >= window else np.zeros(0, np.uint64)


@dataclass
class Batch:
    """The windows of a batch: their first words, and an order by slice and hash, in which equal ones are neighbours."""

    words: Words
    at: np.ndarray  # in the order
    hash: np.ndarray  # in the order
    new: np.ndarray  # where another hash begins
    slice: np.ndarray  # of each different hash


def batch_of(texts: pa.Table, slices: int, window: int) -> Batch:
    words = words_of(texts.column("text"))
    value = word_values(words)
    h, s = window_hashes(value, window), (window_sums(value, window) >> np.uint64(20)) % np.uint64(slices)
    at = np.flatnonzero(words.owner[: len(h)] == words.owner[len(words.owner) - len(h) :])
    h, s = h[at], s[at].astype(np.uint32)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(s[order].astype(np.uint16), kind="stable")] if slices <= 1 << 16 else order[np.argsort(s[order], kind="stable")]
    at, h, s = at[order], h[order], s[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])))) if len(h) else np.zeros(0, np.int64)
    return Batch(words, at, h, new, s[new])


def _runs(slice_: np.ndarray) -> list[tuple[int, int, int]]:
    """(slice, first, last + 1) of each run of ascending slices."""
    begin = np.flatnonzero(np.concatenate(([True], slice_[1:] != slice_[:-1]))) if len(slice_) else np.zeros(0, np.int64)
    return list(zip(slice_[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(slice_)], strict=True)) if len(slice_) else []


def _ordered(texts: pa.Table) -> pa.Table:
    return texts.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def earlier(rows: pa.Table) -> pa.Table:
    """Of the hashes that all batches have in a slice: a bit for each, which says that an earlier range of doc_id has it."""
    rows = rows.sort_by("batch")
    batch = np.asarray(rows.column("batch"))
    blobs = rows.column("hashes").to_pylist()
    size = np.array([len(b) // 8 for b in blobs])
    h = np.frombuffer(b"".join(blobs), "<u8")
    range_ = np.repeat(batch // SALTS, size)
    order = np.argsort(h, kind="stable")  # equal hashes stay in the order of their batches
    new = np.concatenate(([True], h[order[1:]] != h[order[:-1]]))
    least = range_[order[np.flatnonzero(new)]]
    seen = np.zeros(len(h), bool)
    seen[order] = range_[order] > least[np.cumsum(new) - 1]
    ends = np.cumsum(size)
    parts = [(b, np.packbits(seen[e - n : e]).tobytes()) for b, n, e in zip(batch.tolist(), size.tolist(), ends.tolist(), strict=True) if seen[e - n : e].any()]
    return pa.table([pa.array([b for b, _ in parts], pa.int64()), pa.array([rows.column("slice")[0].as_py()] * len(parts), pa.int64()), pa.array([x for _, x in parts], pa.binary())], ["batch", "slice", "bits"])


def hits(batch: Batch, ids: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
    """First words of the windows that start earlier too: in an earlier range, a lesser doc_id, or before in the same row."""
    seen = np.zeros(len(batch.new), bool)
    for s, a, b in _runs(batch.slice):
        if s in answers:
            seen[a:b] = np.unpackbits(np.frombuffer(answers[s], np.uint8), count=b - a).astype(bool)
    if not len(batch.at):
        return batch.at
    cls = np.zeros(len(batch.at), np.int64)
    cls[batch.new[1:]] = 1
    cls = np.cumsum(cls)
    row = batch.words.owner[batch.at]
    rank = np.cumsum(np.concatenate(([0], ids[1:] != ids[:-1])))[row]
    again = np.concatenate(([False], (row[1:] == row[:-1]) & (cls[1:] == cls[:-1])))  # places ascend within a hash
    return np.sort(batch.at[seen[cls] | (rank > rank[batch.new][cls]) | again])


def covered(found: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words lie in a window that starts at one of ``found``."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, found, 1)
    np.add.at(step, found + window, -1)
    return np.cumsum(step)[:-1] > 0


def cut_out(words: Words, gone: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(number of words, removed intervals of words, kept words joined by single spaces) of each text."""
    counts = np.bincount(words.owner, minlength=words.texts)
    first = np.cumsum(counts) - counts
    edge = np.flatnonzero(gone & np.concatenate(([True], ~gone[:-1] | (words.owner[1:] != words.owner[:-1])))) if len(gone) else np.zeros(0, np.int64)
    last = np.flatnonzero(gone & np.concatenate((~gone[1:] | (words.owner[1:] != words.owner[:-1]), [True]))) + 1 if len(gone) else edge
    own = words.owner[edge]
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(own, minlength=words.texts)))), pa.int32()), pa.StructArray.from_arrays([pa.array(edge - first[own], pa.int64()), pa.array(last - first[own], pa.int64())], fields=list(SPAN)))
    kept = np.flatnonzero(~gone)
    start, stop, owner = words.start[kept], words.stop[kept], words.owner[kept]
    gap = np.concatenate((owner[1:] == owner[:-1], [False]))[: len(kept)]  # another kept word follows, so white space does
    step = np.zeros(len(words.body) + 1, np.int8)
    step[start] += 1
    step[stop + gap] -= 1
    body = words.body.copy()
    body[stop[gap]] = 32
    ends = np.concatenate(([0], np.cumsum(np.bincount(owner, stop - start + gap, words.texts).astype(np.int64))))
    return pa.array(counts), spans, binary_column(body[np.cumsum(step[:-1], dtype=np.int8).astype(bool)], ends, pa.string())


def remove_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (removed intervals of words) and kept (the words left, joined by single spaces) of every row.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a row of
    lesser doc_id, or before it in the same row. Windows are judged on the texts as they come.
    Texts of fewer words, null and empty ones lose nothing. Rows of one doc_id are not repeats of
    each other; a row without doc_id neither loses words nor takes them from others. An empty table
    gives no rows. Other columns are not read.
    """
    if window < 1:
        raise ValueError("a window has a word at least")
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = plain.where(F.col("doc_id").isNotNull())
    size = known.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("rows"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    n_bytes, usual = int(size.bytes or 0), int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = max(1, min(int(size.rows), -(-n_bytes // BATCH_BYTES)))
    slices = max(usual, -(-2 * n_bytes // SLICE_BYTES))  # eight bytes for a word, and words of four bytes at the least, mostly
    ranges = min(batches, MOST_CUTS)
    cuts = known.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    number = batch_number(known, [size.low, *cuts, size.high], -(-batches // ranges))
    tasks = -(-n_bytes // TASK_BYTES)

    def index(texts: pa.Table) -> pa.Table:
        batch, which = batch_of(_ordered(texts), slices, window), texts.column("batch")[0].as_py()
        h = batch.hash[batch.new].astype("<u8")
        rows = [(s, h[a:b].tobytes()) for s, a, b in _runs(batch.slice)]
        return pa.table([pa.array([s for s, _ in rows], pa.int64()), pa.array([which] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["slice", "batch", "hashes"])

    def count(rows: pa.Table) -> pa.Table:
        return earlier(rows)

    def cut(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _ordered(texts)
        batch = batch_of(texts, slices, window)
        found = hits(batch, np.asarray(texts.column("doc_id")), dict(zip(answers.column("slice").to_pylist(), answers.column("bits").to_pylist(), strict=True)))
        return pa.table([texts.column("doc_id"), *cut_out(batch.words, covered(found, len(batch.words.start), window))], ["doc_id", "n_words", "spans", "kept"])

    def dealt(rows: DataFrame, by: str) -> DataFrame:
        return rows.repartition(tasks, by) if tasks > usual else rows

    by_batch = dealt(number, "batch").groupBy("batch")
    hashes = by_batch.applyInArrow(tidy_group(index), "slice long, batch long, hashes binary")
    answers = dealt(hashes, "slice").groupBy("slice").applyInArrow(tidy_group(count), "batch long, slice long, bits binary")
    out = by_batch.cogroup(answers.groupBy("batch")).applyInArrow(tidy_group(cut), "doc_id long, n_words long, spans array<struct<start: long, stop: long>>, kept string")
    whole = F.array_remove(F.split("text", SPACE), "")
    rest = plain.where(F.col("doc_id").isNull()).select("doc_id", F.size(whole).cast("long").alias("n_words"), F.array().cast("array<struct<start: long, stop: long>>").alias("spans"), F.array_join(whole, " ").alias("kept"))
    return out.unionByName(rest)


def op11_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_windows(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
least AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
own AS (SELECT s, r, min(i) AS own FROM win GROUP BY s, r),
hit AS (SELECT r, i FROM win JOIN least USING (s) JOIN own USING (s, r) WHERE doc_id > least OR i > own),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS j FROM hit),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d) a ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
