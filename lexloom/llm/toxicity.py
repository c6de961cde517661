"""Toxicity by a convolutional text classifier over hashed word embeddings.

A word is the sum of two hashed rows, so words rarely share both. Texts are scored whole:
the greatest response of each filter over all words of a text. Training starts from random
weights and learns from every labelled text, whole, in six rounds: tasks of some thousand texts
each go on from the same net, and Spark averages what they changed. The scale of the scores and the
thresholds by language are set on two tenths of the labelled texts that are kept aside.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import bounded_batches, checkpointed, stored, table, text_bytes
from lexloom.llm.convnet import ConvNet, Learner

#: Characters of a text in ``labelled_sample``, in one piece from a hashed place of a longer one.
SAMPLE_CHARS = 60_000
#: Tenths of the labelled texts that the net learns from; of the two others one sets the scale, one the thresholds.
LEARNED, SCALED, CHOSEN = 8, 8, 9
#: Texts of a round, where there are so many (of fewer texts more rounds learn), and of one of its tasks.
ROUND_ROWS, TASK_ROWS = 8192, 4096
#: Ids of a block in which Spark averages the tables, as a power of two; and languages with thresholds of their own at most.
BLOCK, MOST_LANGUAGES = 12, 1000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 6
#: How soft the maximum is in the rounds, the fewest steps that they make together, and rows of a step.
BETAS, LEAST_STEPS, BATCH = (1.0, 2.0, 4.0, 8.0, None, None), 240, 64
#: Labelled texts that must have a bucket; rarer ones are not learned and say nothing.
SUPPORT = 3
#: Words scored and bytes hashed at once.
SLICE, HASHED = 1 << 17, 1 << 20
#: What `predicted` asks of a score.
FIXED_THRESHOLD = 0.3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_VALUE = np.random.default_rng(11).integers(0, (1 << 64) - 1, 256, np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))), dtype=np.uint64)


_POWER: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def word_ids(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((words, 2) bucket ids of all letter runs, int64 word offsets by text); about HASHED bytes of texts at a time."""
    cuts = np.unique(np.concatenate(([0], np.searchsorted(offsets, np.arange(HASHED, len(body), HASHED), "left"), [len(offsets) - 1])))
    ids, at = [np.zeros((0, 2), np.int32)], [np.zeros(1, np.int64)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        found, ends = _hashed(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        ids.append(found)
        at.append(ends[1:] + at[-1][-1])
    return np.concatenate(ids), np.concatenate(at)


def _hashed(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, len(body).bit_length())
    if size not in _POWER:
        _POWER.clear()
        _POWER[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    power, inverse = _POWER[size]
    letter = _LETTER[body]
    edge = np.zeros(len(body) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(letter & (np.concatenate(([True], ~letter[:-1])) | edge[:-1]))
    until = np.flatnonzero(letter & (np.concatenate((~letter[1:], [True])) | edge[1:])) + 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[_LOWER[body]] * power[: len(body)], dtype=np.uint64)))
    h = (total[until] - total[first]) * inverse[first]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    ids = np.stack((h & np.uint64(BUCKETS - 1), (h >> np.uint64(32)) & np.uint64(BUCKETS - 1)), axis=1).astype(np.int32)
    return ids, np.searchsorted(first, offsets)


@dataclass
class ToxicityModel:
    net: ConvNet | None
    slope: float = 1.0
    intercept: float = 0.0
    #: Thresholds by language, for decisions; scores never see a language.
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = FIXED_THRESHOLD

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.intercept, -30, 30)))

    def margins(self, texts: pa.Array) -> np.ndarray:
        """What the net says for class 1 over class 0."""
        body, offsets = text_bytes(texts)
        ids, at = word_ids(body, offsets)
        n = np.diff(at)
        pooled = np.full((len(n), len(self.net.bias)), -np.inf, np.float32)
        owner = np.repeat(np.arange(len(n)), n)
        most, pad = self.net.most, np.full((self.net.most, 2), BUCKETS)
        for a in range(0, len(ids), SLICE):
            # Each text ends in padding; a slice sees the words after it, and a text's maximum joins over slices.
            b = min(len(ids), a + SLICE)
            cut = np.flatnonzero(np.diff(owner[a:b])) + 1
            part = np.insert(ids[a:b], np.repeat(cut, most), BUCKETS, axis=0)
            tail = ids[b : b + most] if b < len(ids) else pad
            tail = np.concatenate((np.where((owner[b : b + most] == owner[b - 1])[:, None], tail, BUCKETS) if b < len(ids) else tail, pad))[:most]
            x = self._embed(np.concatenate((part, tail)))
            starts = np.concatenate(([0], cut + most * np.arange(1, len(cut) + 1)))
            docs = owner[a + np.concatenate(([0], cut))]
            pads = ((cut + most * np.arange(len(cut)))[:, None] + np.arange(most)).ravel()  # from there the next text would be seen
            pooled[docs] = np.maximum(pooled[docs], self._pool(x, starts, len(part), pads))
        empty = n == 0
        if empty.any():
            pooled[empty] = self._pool(self._embed(np.full((most + 1, 2), BUCKETS)), np.array([0]), 1)
        z = self.net.logits(pooled).astype(np.float64)
        return z[:, 1] - z[:, 0]

    def _embed(self, ids: np.ndarray) -> np.ndarray:
        return self.net.tables[0][ids[:, 0]] + self.net.tables[1][ids[:, 1]]

    def _pool(self, x: np.ndarray, starts: np.ndarray, n: int, pads: np.ndarray | None = None) -> np.ndarray:
        found = []
        for w, weight in self.net.filters.items():
            y = x[:n] @ weight[0]
            for j in range(1, w):
                y += x[j : n + j] @ weight[j]
            if pads is not None:
                y[pads] = -np.inf
            found.append(np.maximum.reduceat(y, starts, axis=0))
        return np.concatenate(found, axis=1)


def held_out(doc_id: str = "doc_id"):
    """True for the fold that no model learns from; a null id is not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> pa.Table:
    """At most ``rows`` labelled texts of each class, chosen by a hash of doc_id, none of the held-out fold.

    A doc_id with several labels is toxic if one of them says so; of several rows one text stands
    for a doc_id.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # 2 * rows at most
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    text = F.col("text").cast("string")
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length(text) - SAMPLE_CHARS + 1)).cast("int")
    piece = F.substr(text, place + 1, F.lit(SAMPLE_CHARS))
    texts = docs.select(F.col("doc_id").cast("long"), F.struct(piece.alias("text"), lang.cast("string").alias("lang")).alias("row"), F.xxhash64(text).alias("h"))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("row", "h").alias("row"))
    return one.select("doc_id", "row.text", "row.lang", "toxic").toArrow().sort_by("doc_id")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text, lang, part, sixth) of every labelled document, none of the held-out fold; what ``labelled_sample`` says holds."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    text = F.col("text").cast("string")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    texts = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long"), F.struct(text.alias("text"), lang.cast("string").alias("lang")).alias("row"), F.xxhash64(text).alias("h"))
    one = texts.join(known, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("row", "h").alias("row"))
    number = lambda n, seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n)).cast("int")
    return one.select("doc_id", "toxic", "row.text", "row.lang", number(10, 1).alias("part"), number(len(BETAS), 2).alias("sixth"))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Train on four fifths of all labelled texts; set the scale on half of the rest and thresholds on the other half.

    Both classes weigh alike in training, and as they are in the rest. Without rows of both classes
    there is no net, and every score is 0.
    """
    bounded_batches(docs.sparkSession)
    rows = stored(labelled(docs, labels), "labelled")  # each round reads its part
    counts = {(r.toxic, r.learned): r["count"] for r in rows.groupBy("toxic", (F.col("part") < LEARNED).alias("learned")).count().collect()}
    ours = [counts.get((c, True), 0) for c in (0, 1)]
    if sum(counts.values()) < 20 or not min(ours):
        return ToxicityModel(None)
    model = ToxicityModel(train_net(rows.where(F.col("part") < LEARNED), ours))
    margins = checkpointed(margins_of(rows.where(F.col("part") >= LEARNED), model))
    total = sum(counts.values())
    share = sum(n for (c, _), n in counts.items() if c == 1) / total
    prior = float(np.log(share / (1 - share)))
    binned = margins.where(F.col("part") == SCALED).groupBy(F.round("margin", 2).alias("m"), "toxic").count().collect()  # margins of a hundredth, some thousand at most
    m, y, n = (np.array([r[i] for r in binned], np.float64) for i in range(3))
    slope, shift = _platt(m + prior, y, n) if len(set(y.tolist())) == 2 else (1.0, 0.0)
    model.slope, model.intercept = slope, slope * prior + shift
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("margin") + F.lit(model.intercept))))
    place = sum((score >= float(t)).cast("int") for t in GRID)
    by = checkpointed(margins.where(F.col("part") == CHOSEN).groupBy("lang", "toxic", place.alias("place")).count())
    model.threshold = _best(by.groupBy("toxic", "place").agg(F.sum("count").alias("n")).collect())
    both = by.where("lang IS NOT NULL").groupBy("lang").agg(*(F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col("count"))), F.lit(0)).alias(f"n{c}") for c in (0, 1)))
    named = both.where("n0 >= 5 AND n1 >= 5").orderBy(F.desc(F.col("n0") + F.col("n1")), "lang").limit(MOST_LANGUAGES).select("lang")
    of: dict[str, list] = {}
    for r in by.join(F.broadcast(named), "lang").select("toxic", "place", F.col("count").alias("n"), "lang").collect():  # 40 rows a language at most
        of.setdefault(r.lang, []).append(r)
    model.thresholds = {name: _best(found) for name, found in sorted(of.items())}
    return model


def margins_of(rows: DataFrame, model: ToxicityModel) -> DataFrame:
    """(part, lang, toxic, margin) of labelled texts, margins within 30."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.clip(shared.value.margins(batch.column("text")), -30, 30)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "lang", "toxic")), pa.array(found, pa.float64())], ["part", "lang", "toxic", "margin"])

    return rows.select("part", "lang", "toxic", "text").mapInArrow(run, "part int, lang string, toxic int, margin double")


# --- training ---------------------------------------------------------------------


def train_net(rows: DataFrame, of_class: list[int]) -> ConvNet:
    """The net of all labelled texts, from random weights; buckets of too few texts are padding while it learns, and 0 after.

    Each round has a maximum of its own softness and takes at least a sixth of the texts, each of
    which has its round; of few texts a round takes more of them, and goes over them again.
    """
    n, rounds = sum(of_class), len(BETAS)
    sixths = min(rounds, -(-rounds * ROUND_ROWS // n))
    again = max(1, -(-LEAST_STEPS * BATCH // (rounds * n)))
    weights = np.array([n / (2 * c) for c in of_class])
    rare = rare_buckets(rows)
    learner = Learner.begin(2, BUCKETS, 2, dim=DIM, widths=WIDTHS, filters=FILTERS, rate=0.01, row_rate=0.1, scale=0.01, rng=np.random.default_rng(7))
    for i, beta in enumerate(BETAS):
        some = rows.where(F.pmod(F.col("sixth") - i, F.lit(rounds)) < sixths)
        tasks = max(1, n * sixths // (rounds * TASK_ROWS))
        dealt = some.select("doc_id", "toxic", "text").repartition(tasks, "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
        learned_round(dealt, learner, rare, beta, again, weights, i)
    for t, none in zip(learner.net.tables, rare, strict=True):
        t[:-1][none] = 0
    return learner.net


def _by_text(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets by text, each id's text)."""
    ids, at = word_ids(*text_bytes(texts))
    return ids, at, np.repeat(np.arange(len(at) - 1), np.diff(at))


def rare_buckets(rows: DataFrame) -> list[np.ndarray]:
    """Of both tables, which buckets fewer than SUPPORT of the texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            ids, _, owner = _by_text(batch.column("text"))
            for j in range(2):
                pairs = np.unique(ids[:, j].astype(np.int64) * max(1, batch.num_rows) + owner)
                seen[j] += np.bincount(pairs // max(1, batch.num_rows), minlength=BUCKETS)
        blocks = np.minimum(seen, SUPPORT).astype(np.uint8).reshape(-1, 1 << BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["block", "seen"])

    def total(t: pa.Table) -> pa.Table:
        found = sum(np.frombuffer(b, np.uint8).astype(np.int64) for b in t.column("seen").to_pylist())
        return pa.table({"block": t.column("block").slice(0, 1), "seen": pa.array([np.minimum(found, SUPPORT).astype(np.uint8).tobytes()], pa.binary())})

    kinds = "block int, seen binary"
    found = rows.select("text").mapInArrow(run, kinds).groupBy("block").applyInArrow(total, kinds).toArrow().sort_by("block")  # half a MB
    return list(np.frombuffer(b"".join(found.column("seen").to_pylist()), np.uint8).reshape(2, BUCKETS) < SUPPORT)


def _steps(sizes: np.ndarray, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """All texts in steps of like size, of about SLICE words at most."""
    for chosen in np.array_split(rng.permutation(len(sizes)), -(-len(sizes) // BATCH)):
        words = np.cumsum(np.minimum(sizes[chosen], SLICE)) // SLICE
        yield from np.split(chosen, np.flatnonzero(np.diff(words)) + 1)


def heads(net: ConvNet, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, places) of a long text: the words from each place where a filter responds most, which say as much as all of it to the maximum."""
    most, best, at = net.most, np.full(len(net.bias), -np.inf), np.zeros(len(net.bias), np.int64)
    whole = ToxicityModel(net)
    for a in range(0, len(ids), SLICE):
        n = min(SLICE, len(ids) - a)
        x = whole._embed(np.concatenate((ids[a : a + n + most], np.full((most, ids.shape[1]), BUCKETS))))
        y = np.concatenate([sum(x[j : n + j] @ weight[j] for j in range(w)) for w, weight in net.filters.items()], axis=1)
        top = y.argmax(axis=0)
        value = y[top, np.arange(len(top))]
        at, best = np.where(value > best, a + top, at), np.maximum(best, value)
    places = np.unique(at)
    padded = np.concatenate((ids, np.full((most, ids.shape[1]), BUCKETS, ids.dtype)))
    return np.concatenate([padded[p : p + most] for p in places]), most * np.arange(len(places))


def learned_round(rows: DataFrame, learner: Learner, rare: list[np.ndarray], beta: float | None, again: int, weights: np.ndarray, number: int) -> None:
    """``learner`` as the mean of what each partition of ``rows`` makes of it; a row of a table is the mean of those that changed it."""
    shared = rows.sparkSession.sparkContext.broadcast((learner, rare))  # 20 MB, fixed by BUCKETS and DIM
    schema = "kind int, block int, task int, n long, ids binary, found binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, (begun, none) = TaskContext.get().partitionId(), shared.value
        own = copy.deepcopy(begun)
        touched, n, rng = np.zeros((2, BUCKETS + 1), bool), 0, np.random.default_rng((number, task))
        for batch in batches:
            if not batch.num_rows:
                continue
            y = np.asarray(batch.column("toxic"), np.int64)
            ids, at, _ = _by_text(batch.column("text"))
            for j in range(2):
                ids[none[j][ids[:, j]], j] = BUCKETS
            texts, n = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], n + len(y)
            for _ in range(again):
                for chosen in _steps(np.diff(at), rng):
                    changed = own.step([heads(own.net, texts[i]) if len(texts[i]) > SLICE else texts[i] for i in chosen], y[chosen], beta, weights[y[chosen]])
                    for j, c in enumerate(changed):
                        touched[j][c] = True
        if not n:
            return
        made = [(2, 0, np.zeros(0, np.int32), np.concatenate([np.ravel(v) for v in (*own.dense(), np.float32(own.adam.t))]).astype(np.float64))]
        for j in range(2):
            changed = np.flatnonzero(touched[j][:-1]).astype(np.int32)
            for part in np.split(changed, np.flatnonzero(np.diff(changed >> BLOCK)) + 1):
                if len(part):
                    made.append((j, int(part[0]) >> BLOCK, part, np.column_stack((own.net.tables[j][part], own.squares[j][part]))))
        columns = [[m[0] for m in made], [m[1] for m in made], [task] * len(made), [n] * len(made), [m[2].tobytes() for m in made], [m[3].tobytes() for m in made]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["kind", "block", "task", "n", "ids", "found"])

    def mean(t: pa.Table) -> pa.Table:
        t = t.sort_by("task")  # sums in one order
        kind, block = t.column("kind")[0].as_py(), t.column("block")[0].as_py()
        ids, found, n = (t.column(c).to_pylist() for c in ("ids", "found", "n"))
        if kind == 2:
            ids, found = b"", np.average([np.frombuffer(f, np.float64) for f in found], axis=0, weights=n)
        else:
            total, times, base = np.zeros((1 << BLOCK, DIM + 1)), np.zeros(1 << BLOCK), block << BLOCK
            for i, f in zip(ids, found, strict=True):
                at = np.frombuffer(i, np.int32) - base
                total[at] += np.frombuffer(f, np.float32).reshape(-1, DIM + 1)
                times[at] += 1
            at = np.flatnonzero(times)
            ids, found = (at + base).astype(np.int32).tobytes(), (total[at] / times[at][:, None]).astype(np.float32)
        return pa.table([pa.array([x], k) for x, k in ((kind, pa.int32()), (block, pa.int32()), (0, pa.int32()), (sum(n), pa.int64()), (ids, pa.binary()), (found.tobytes(), pa.binary()))], ["kind", "block", "task", "n", "ids", "found"])

    for r in rows.select("toxic", "text").mapInArrow(run, schema).groupBy("kind", "block").applyInArrow(mean, schema).toArrow().to_pylist():  # no more than the learner itself
        if r["kind"] == 2:
            flat = np.frombuffer(r["found"], np.float64)
            for value in learner.dense():
                value[...] = flat[: value.size].reshape(value.shape)
                flat = flat[value.size :]
            learner.adam.t = round(float(flat[0]))
        else:
            at, found = np.frombuffer(r["ids"], np.int32), np.frombuffer(r["found"], np.float32).reshape(-1, DIM + 1)
            learner.net.tables[r["kind"]][at], learner.squares[r["kind"]][at] = found[:, :DIM], found[:, DIM]
    shared.unpersist()


def _platt(margin: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic fit with smoothed targets; ``n`` rows have each margin and class."""
    ones = float((y * n).sum())
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (n.sum() - ones + 2))
    x = np.stack((margin, np.ones(len(y))), axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):  # Newton steps with a little weight decay
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hessian, x.T @ (n * (p - target)) + 1e-2 * (w - [1.0, 0.0])), -1, 1)
    return max(0.05, float(w[0])), float(w[1])


#: Thresholds that are tried.
GRID = np.linspace(0.05, 0.95, 19)


def _best(rows: list) -> float:
    """The middle of the thresholds with the best F1; rows of (toxic, place, n): so many texts reach the first ``place`` thresholds."""
    counts = np.zeros((2, len(GRID) + 1))
    for r in rows:
        counts[r[0], r[1]] += r[2]
    hit = counts[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
    f1 = 2 * hit[1] / np.maximum(1e-12, hit.sum(axis=0) + counts[1].sum())
    return float(np.median(GRID[f1 == f1.max()]))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) and flagged (by the language's threshold).

    Null and empty texts get the score of an empty text. Repeated rows are scored each for
    itself, and an empty table gives no rows. Without a column ``lang`` one threshold holds for all.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, fixed by BUCKETS and DIM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = shared.value.scores(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("lang"), pa.array(found, pa.float64())], ["doc_id", "held_out", "lang", "score"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), lang.cast("string").alias("lang"), F.col("text").cast("string"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, lang string, score double")
    least = F.lit(model.threshold)
    if model.thresholds:
        limits = F.create_map(*(F.lit(x) for pair in model.thresholds.items() for x in pair))
        least = F.coalesce(limits[F.coalesce("lang", F.lit(""))], least)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= FIXED_THRESHOLD).cast("int").alias("predicted"), (F.col("score") >= least).alias("flagged"))


def op2_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
