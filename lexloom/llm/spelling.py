"""Spelling variants: words at edit distance 1, found in tries of letter-group counts.

A word is the vector of its counts in 32 letter groups, the low five bits of a code point. One
inserted, deleted or replaced letter leaves at most one group with one more (a surplus) and at most
one with one less (a deficit). Eight coarser groups, the low three bits, deal the words to parts: a
word goes where its own coarse vector belongs, and where it belongs without one letter of each
coarse group it has, so two near words meet in just one place.

A part's rows form a trie: below the coarse vector, a level for each group and a branch for each
count. Every row searches it, depth first, with a budget of one deficit and, after it, one surplus;
the other order is the other word's search, so each pair is found once. Only what is in the leaves
reached is compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2, log10

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import checkpointed, spread, table, tidy, tidy_group

LEVELS, COARSE = 32, 8
#: Least letters and occurrences of a word, and how many times as frequent its form must be.
LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: One run in so many loses a letter.
NOISE = 31
#: Rows of a part, about; searches and comparisons at once; letters up to which words are compared as a matrix.
PART_ROWS, AT_ONCE, WIDE = 1 << 16, 1 << 18, 40
_LOSS = np.random.default_rng(12).integers(1, (1 << 64) - 1, COARSE, np.uint64) | np.uint64(1)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame, noise: int = NOISE) -> DataFrame:
    """(word, n): runs of letters of all texts with A-Z in lower case, counted.

    A run whose crc32, with its doc_id, is a multiple of ``noise`` has lost a letter. Words have at
    least LEAST_LETTERS letters and LEAST_COUNT occurrences. A null text has no words; a null
    doc_id is written as nothing; each of repeated rows counts. Other columns are not read.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"))
    low = F.when(F.col("run").rlike("[À-Þ]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.lower("run"))  # lower() would change these too
    hashed = runs.select("id", low.alias("word")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
    at = (F.col("h") % F.length("word")).cast("int")
    lost = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
    words = hashed.select(F.when(F.col("h") % noise == 0, lost).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, int64 offsets) of words whose code points are all below U+0100."""
    words = words.cast(pa.large_binary())
    _, ends, data = words.buffers()
    ends = np.frombuffer(ends, np.int64, len(words) + 1, words.offset * 8)
    body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    lead = body >= 0xC2
    high = np.concatenate(([False], lead[:-1]))[: len(body)]
    code = np.where(high, body + ((np.concatenate(([0], body[:-1]))[: len(body)] & 3) << 6) - 0x80, body)[~lead]
    before = np.concatenate(([0], np.cumsum(lead)))
    ends = ends - ends[0]
    return code.astype(np.uint8), ends - before[ends]


def vectors(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of each word in each group."""
    n = len(ends) - 1
    owner = np.repeat(np.arange(n), np.diff(ends))
    return np.bincount(owner * LEVELS + (code & (LEVELS - 1)), minlength=n * LEVELS).reshape(n, LEVELS)


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, which are there): a word's coarse vector as a number, and the same without one letter of each coarse group."""
    coarse = counts.reshape(len(counts), LEVELS // COARSE, COARSE).sum(axis=1)
    own = (coarse.astype(np.uint64) * _LOSS).sum(axis=1, dtype=np.uint64)
    return np.concatenate((own[:, None], own[:, None] - _LOSS[None]), axis=1), np.concatenate((np.ones((len(counts), 1), bool), coarse > 0), axis=1)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((key ^ (key >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)


class Trie:
    """Rows in the order of their keys and counts; a node is a run of rows, numbered within its level."""

    def __init__(self, key: np.ndarray, counts: np.ndarray):
        self.counts, self.base = counts, int(counts.max(initial=0)) + 2
        first = np.full(len(key), -1)  # the level at which a row parts from the one before
        if len(key):
            differ = counts[1:] != counts[:-1]
            first[1:] = np.where(key[1:] != key[:-1], -1, np.where(differ.any(axis=1), differ.argmax(axis=1), LEVELS))
        self.node = [(np.cumsum(first < level) - 1).astype(np.int32) for level in range(LEVELS + 1)]
        self.child = []
        for level in range(LEVELS):
            begin = np.flatnonzero(first <= level)
            self.child.append(self.node[level][begin].astype(np.int64) * self.base + counts[begin, level])
        self.leaf = np.append(np.flatnonzero(first < LEVELS), len(key))

    def step(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which nodes have a branch of that count, the nodes below it)."""
        want = node.astype(np.int64) * self.base + count
        at = np.minimum(np.searchsorted(self.child[level], want), len(self.child[level]) - 1)
        there = np.flatnonzero(self.child[level][at] == want)
        return there, at[there]

    def search(self, rows: np.ndarray, lost: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, leaf) of each leaf within the budgets of ``rows``; the deficit lies in the coarse group that a row has lost."""
        none = np.zeros(0, np.int64)
        one, one_at, both, both_at = none, none, none, none  # rows that have spent the deficit, or the surplus too, and their nodes
        for level in range(LEVELS):
            c = self.counts[:, level]
            up, up_at = self.step(level, one_at, c[one] + 1)
            on, on_at = self.step(level, one_at, c[one])
            stay, stay_at = self.step(level, both_at, c[both])
            both, both_at = np.concatenate((both[stay], one[up])), np.concatenate((stay_at, up_at))
            may = rows[(lost[rows] == level % COARSE) & (c[rows] > 0)]
            down, down_at = self.step(level, self.node[level][may], c[may] - 1)
            one, one_at = np.concatenate((one[on], may[down])), np.concatenate((on_at, down_at))
        yield one, one_at
        yield both, both_at


def is_near(code: np.ndarray, ends: np.ndarray, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each two words differ by exactly one inserted, deleted or replaced letter; x is never the longer one."""
    out, size = np.zeros(len(q), bool), np.diff(ends)
    short = np.flatnonzero(size[q] <= WIDE)
    if len(short):
        wide = int(size[q[short]].max())
        some, place = np.unique(np.concatenate((q[short], x[short])), return_inverse=True)
        inside = np.arange(wide)[None] < size[some][:, None]
        ahead = np.where(inside, code[np.minimum(ends[some][:, None] + np.arange(wide), len(code) - 1)], 0)
        back = np.where(inside, code[np.maximum(ends[some + 1][:, None] - 1 - np.arange(wide), 0)], 0)
        a, b = place[: len(short)], place[len(short) :]
        equal = np.zeros(len(short), np.int64)
        for m in (ahead, back):
            differ = m[a] != m[b]
            equal += np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
        lq, lx = size[q[short]], size[x[short]]
        out[short] = (equal < 2 * wide) & (equal >= lq - 1) & (lq - lx <= 1)
    for i in np.flatnonzero(size[q] > WIDE).tolist():
        a, b = (code[ends[k] : ends[k + 1]] for k in (q[i], x[i]))
        n = len(b)
        if len(a) - n <= 1:
            head, tail = a[:n] != b, a[::-1][:n] != b[::-1]
            p, s = (int(d.argmax()) if d.any() else n for d in (head, tail))
            out[i] = p + s >= len(a) - 1 and not (len(a) == n and p == n)
    return out


def near_pairs(code: np.ndarray, ends: np.ndarray, part: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of near words whose common place is in this part."""
    counts = vectors(code, ends)
    keys, there = places(counts)
    word, lost = np.nonzero(there & (_part(keys, parts) == part))
    key, lost = keys[word, lost], lost - 1
    kind = np.uint8 if counts.max(initial=0) < 256 else np.dtype(">u4")
    packed = np.concatenate((key.astype(">u8")[:, None].view(np.uint8), np.ascontiguousarray(counts[word].astype(kind)).view(np.uint8).reshape(len(word), LEVELS * np.dtype(kind).itemsize)), axis=1)
    order = np.argsort(np.ascontiguousarray(packed).view(f"S{packed.shape[1]}").ravel(), kind="stable")
    word, lost, key = word[order], lost[order], key[order]
    trie = Trie(key, counts[word])

    def compared(rows: np.ndarray, first: np.ndarray, number: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of rows and the ``number`` of rows from ``first`` on, the near ones, some at a time."""
        total = np.cumsum(number)
        if len(total) and total[-1]:
            for a in range(0, int(total[-1]), AT_ONCE):
                b = min(a + AT_ONCE, int(total[-1]))
                i, j = np.searchsorted(total, a, "right"), np.searchsorted(total, b - 1, "right") + 1
                size = np.minimum(total[i:j], b) - np.maximum(total[i:j] - number[i:j], a)
                since = np.maximum(total[i:j] - number[i:j], a) - (total[i:j] - number[i:j])
                q, x = word[np.repeat(rows[i:j], size)], word[np.repeat(first[i:j] + since, size) + spread(size)]
                near = is_near(code, ends, q, x)
                yield q[near], x[near]

    asking = np.flatnonzero(lost >= 0)
    for i in range(0, len(asking), AT_ONCE):
        for row, leaf in trie.search(asking[i : i + AT_ONCE], lost):
            yield from compared(row, trie.leaf[leaf], trie.leaf[leaf + 1] - trie.leaf[leaf])
    # Words of one vector meet wherever they lose a letter; their first coarse group has them compared.
    own = asking[lost[asking] == there[word[asking], 1:].argmax(axis=1)]
    yield from compared(own, own + 1, trie.leaf[trie.node[LEVELS][own] + 1] - own - 1)


def near_words(words: DataFrame, column: str = "word", count: str = "n") -> DataFrame:
    """(word, n_near, form, form_n) of words that have near ones: their number, and the most frequent of them, ties by code point.

    ``words`` has different words of letters below U+0100, each once; null ones go. A word that is
    near to none has no row.
    """
    given = words.select(F.col(column).cast("string").alias("word"), F.col(count).cast("long").alias("n")).where("word IS NOT NULL")
    parts = max(1, -(-(COARSE + 1) * given.count() // PART_ROWS))

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, there = places(vectors(*letters(batch.column(0))))
            part = np.sort(_part(np.where(there, keys, keys[:, :1]), parts), axis=1)
            new = np.concatenate((np.ones((len(part), 1), bool), part[:, 1:] != part[:, :-1]), axis=1)
            row, of = np.nonzero(new)
            yield pa.RecordBatch.from_arrays([pa.array(part[row, of]), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["part", "word", "n"])

    def search(rows: pa.Table) -> pa.Table:
        text, n = rows.column("word").combine_chunks(), np.asarray(rows.column("n"))
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        best = np.empty(len(n), np.int64)  # the place of each word when the frequent ones come first
        order = np.asarray(pc.sort_indices(pa.table([rows.column("n"), text], ["n", "word"]), [("n", "descending"), ("word", "ascending")]))
        best[order] = np.arange(len(n))
        number, form = np.zeros(len(n), np.int64), np.full(len(n), len(n))
        for q, x in near_pairs(*letters(text), rows.column("part")[0].as_py(), parts):
            for a, b in ((q, x), (x, q)):
                number += np.bincount(a, minlength=len(n))
                np.minimum.at(form, a, best[b])
        found = np.flatnonzero(number)
        other = pa.array(order[form[found]])
        return pa.table([text.take(pa.array(found)), pa.array(number[found]), text.take(other), pa.array(n).take(other)], ["word", "n_near", "form", "form_n"])

    met = given.mapInArrow(deal, "part long, word string, n long").groupBy("part").applyInArrow(tidy_group(search), "word string, n_near long, form string, form_n long")
    best = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("word"))).alias("best"))
    return best.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))


def roots(forms: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """(word, root) of words with a form: the last form that is reached. Each form is ``ratio`` times as frequent, none more than ``most``.

    Every round doubles the steps taken, so a few joins are enough.
    """
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    for _ in range(ceil(log2(1 + log10(max(1, most)) / log10(ratio)))):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = checkpointed(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, form, root, n_near, form_n of different ``words`` (word, n).

    A word's form is its near word with the greatest n, the least in the order of code points
    among those, if that is at least ``ratio`` times its own; else null, as form_n. The root is
    the last form reached, or the word itself. No words give no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    given = checkpointed(words.select("word", "n"))
    joined = given.join(near_words(given).withColumnRenamed("form", "best").withColumnRenamed("form_n", "best_n"), "word", "left")
    far = F.col("best_n") >= ratio * F.col("n")
    found = checkpointed(joined.select("word", "n", F.when(far, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(far, F.col("best_n")).alias("form_n")))
    most = found.agg(F.max("n")).first()[0] or 1
    last = roots(found.where("form IS NOT NULL"), most, ratio)
    return found.join(last, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(corpus_words(table(spark, sf_dir, "documents")))


OP12_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
run AS (SELECT doc_id, translate(x, '{_UPPER}', '{_LOWER}') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS x FROM documents)),
own AS (SELECT w, coalesce(doc_id::VARCHAR, '') || ':' || w AS s, count(*) AS n FROM run WHERE length(w) >= {LEAST_LETTERS} GROUP BY ALL),
bytes AS (SELECT w, n, list_transform(range(strlen(s)), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT) AS b FROM own),
hashed AS (SELECT w, n, xor(list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM bytes, crc),
lost AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM lost WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
longer AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cut c JOIN words w ON c.s = w.word),
near AS (SELECT a, b FROM longer UNION ALL SELECT b, a FROM longer UNION ALL SELECT DISTINCT x.word, y.word FROM cut x JOIN cut y ON x.s = y.s AND x.i = y.i AND x.word <> y.word),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS form, max(n) AS form_n FROM near JOIN words ON b = word GROUP BY a),
found AS (SELECT w.word, n, CASE WHEN form_n >= {RATIO} * n THEN form END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {RATIO} * n THEN form_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM found UNION ALL SELECT k.word, f.word, f.form FROM walk k JOIN found f ON k.next = f.word)
SELECT word, n, form, root, n_near, form_n FROM found JOIN (SELECT word, root FROM walk WHERE next IS NULL) USING (word)
"""
