"""Language identification by a convolutional network over bytes.

A text is cut into windows of fixed length that cover it whole. Filters of several widths slide
over the byte classes of a window, the greatest response of each is kept, and a softmax reads
them; a text's probabilities are the mean over its windows by length. For speed the filters are
turned into tables over pairs of byte classes after training: the responses are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.common import bounded_batches, checkpointed, spread, table, text_bytes
from lexloom.llm.convnet import ConvNet, softmax, train
from lexloom.llm.toxicity import held_out

#: Labelled rows of each language that a fit reads at most, and the windows of one text in it.
SAMPLE_ROWS, SAMPLE_WINDOWS = 400, 3
#: Rows of all languages together. Very many languages have fewer rows each, but LEAST_ROWS; of more than 2000, those with the most documents are learned.
MOST_ROWS, LEAST_ROWS = 40_000, 20
WINDOW, DIM, WIDTHS, FILTERS, EPOCHS, LEAST_STEPS, BATCH = 256, 8, (2, 3, 4), 8, 6, 300, 32
#: Windows scored at once.
SLICE = 48
UNKNOWN = "und"

#: Byte classes: letters of either case, white space, digits, other ASCII, and each byte of longer characters.
_CLASS = np.full(256, 28, np.int64)
_CLASS[97:123] = np.arange(26)
_CLASS[65:91] = np.arange(26)
_CLASS[[9, 10, 11, 12, 13, 32]] = 26
_CLASS[48:58] = 27
_CLASS[128:256] = np.arange(29, 157)
CLASSES = 157
PAD = CLASSES


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the windows of texts; an empty text has none."""
    n = np.diff(offsets)
    count = -(-n // WINDOW)
    owner, k = np.repeat(np.arange(len(n)), count), spread(count)
    start = offsets[:-1][owner] + k * WINDOW
    return owner, start, np.minimum(WINDOW, offsets[1:][owner] - start)


@dataclass
class LanguageModel:
    net: ConvNet | None
    languages: list[str]

    def __post_init__(self):
        if self.net is None:
            return
        e, f = self.net.tables[0], self.net.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, a.shape[1])
        none = np.zeros((len(e), FILTERS), np.float32)
        first = [e @ f[w][0] for w in WIDTHS], [e @ f[w][1] for w in WIDTHS]
        self.begin = np.concatenate([pair(a, b) for a, b in zip(*first, strict=True)], axis=1)
        self.rest = np.concatenate([pair(e @ f[3][2], none), pair(e @ f[4][2], e @ f[4][3])], axis=1)

    def probabilities(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages); rows of zeros for empty texts."""
        owner, start, length = windows(offsets)
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        classes = np.concatenate((_CLASS[body], np.full(WINDOW + 4, PAD)))
        reach = np.arange(WINDOW + 3)
        for a in range(0, len(start), SLICE):
            s, n = start[a : a + SLICE], length[a : a + SLICE]
            ids = classes[s[:, None] + reach]
            if (n < WINDOW).any():
                ids[reach >= n[:, None]] = PAD
            ids[:, WINDOW:] = PAD
            pair = ids[:, :-1] * (CLASSES + 1) + ids[:, 1:]
            y = self.begin[pair[:, :WINDOW]]
            y[:, :, FILTERS:] += self.rest[pair[:, 2:]]
            short = np.flatnonzero(n < WINDOW)
            if len(short):
                y[short] = np.where((reach[:WINDOW] < n[short][:, None])[:, :, None], y[short], -np.inf)
            half = WINDOW
            while half > 1:
                half //= 2
                y = np.maximum(y[:, :half], y[:, half:])
            np.add.at(total, owner[a : a + SLICE], softmax(self.net.logits(y[:, 0])) * n[:, None])
        return total / np.maximum(1, np.diff(offsets))[:, None]


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def labelled_sample(docs: DataFrame, rows: int) -> pa.Table:
    """(lang, windows) of at most ``rows`` documents of each language, by a hash of doc_id, none of the held-out fold.

    Every language counts, up to MOST_ROWS / LEAST_ROWS of them. The windows are SAMPLE_WINDOWS pieces of WINDOW characters from
    hashed places of the whole text; of several rows with one doc_id and lang one text stands for all.
    """
    known = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    keys = known.select("doc_id", "lang")
    sizes = keys.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n"))
    sizes = checkpointed(sizes.orderBy(F.desc("n"), "lang").limit(max(1, MOST_ROWS // LEAST_ROWS)))
    n_languages = sizes.count()
    rows = max(min(rows, LEAST_ROWS), min(rows, MOST_ROWS // max(1, n_languages)))
    # A hash leaves some four times too many and forty more, so that no language is one task's, and their least hashes stay.
    near = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) <= F.lit(float((4 * rows + 40) << 32)) / F.col("n")
    some = keys.join(F.broadcast(sizes), "lang").where(F.coalesce(near, F.lit(True))).select("doc_id", "lang").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = some.withColumn("nth", nth).where(F.col("nth") <= rows).select("doc_id", "lang")
    places = F.greatest(F.lit(1), F.ceil(F.length("text") / WINDOW))
    windows = F.array(*(F.substr("text", (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(k)), places) * WINDOW + 1).cast("int"), F.lit(WINDOW)) for k in range(SAMPLE_WINDOWS)))
    cut = known.select("doc_id", "lang", F.struct(F.xxhash64("text").alias("h"), F.array_distinct(windows).alias("windows")).alias("row"))
    one = cut.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("row").alias("row"))
    return one.select("doc_id", "lang", "row.windows").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Train on windows of the sample. Without labelled texts there is no net, and nothing is predicted."""
    sample = labelled_sample(docs, rows)
    languages = sorted(set(sample.column("lang").to_pylist()))
    windows = sample.column("windows").combine_chunks()
    y = np.repeat(np.searchsorted(languages, sample.column("lang").to_pylist()), np.diff(np.asarray(windows.offsets))) if len(sample) else np.zeros(0, np.int64)
    body, offsets = text_bytes(windows.flatten())
    sequences = [_CLASS[body[a : min(b, a + WINDOW)]][:, None] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    full = [i for i, s in enumerate(sequences) if len(s)]
    if len(languages) < 2 or not full:
        return LanguageModel(None, languages)
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(full)))
    return LanguageModel(train([sequences[i] for i in full], y[full], len(languages), CLASSES, dim=DIM, widths=WIDTHS, filters=FILTERS, betas=[None] * epochs, batch=BATCH, row_rate=0.05), languages)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred and the probability of that language.

    Null texts and texts without a letter are ``und`` with score 0; so is everything when fewer
    than two languages were learned, but for a single one, which is predicted with score 1.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some MB, fixed by CLASSES and FILTERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            letter = np.fromiter(map(_has_letter, batch.column("text").to_pylist()), bool, batch.num_rows)
            if m.net is None:
                name = np.array((m.languages or [UNKNOWN])[:1] * batch.num_rows, object)
                best = np.full(batch.num_rows, float(bool(m.languages)))
            else:
                p = m.probabilities(*text_bytes(batch.column("text")))
                name, best = np.array(m.languages, object)[p.argmax(axis=1)], p.max(axis=1)
            name, best = np.where(letter, name, UNKNOWN), np.where(letter, np.clip(best, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(name, pa.string()), pa.array(best, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_byte_cnn_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
