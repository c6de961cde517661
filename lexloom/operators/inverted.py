"""A stored inverted index: BM25 questions that read their own terms' blocks and nothing else.

Documents lie in stripes of neighbours by length, and are named by their place there. A block holds
a term's postings of one stripe, with the greatest frequency and the least length among them, which
bound what any of its documents can score whatever the corpus' statistics are. Blocks lie by a hash
of their term in partitions, sorted by term, up to ``ROW`` of a term in a row. A question takes its
terms' bounds, scores the most promising stripes, and then only those others whose bound reaches the
least of the best scores so far.

Tables (segments, ids and lengths by stripe, what is dead, document frequencies, the corpus' size)
change together, by commits of a store. A refresh compares contents by hash, so it tokenizes new and
changed texts only; what is gone or changed is marked dead and counted out of the frequencies.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions.text import tokens
from lexloom.operators import ranking
from lexloom.operators.lexical import EPSILON, K1, MOST_WEIGHTS, B, query_terms, term_counts, top_by_query
from lexloom.operators.ranking import bounded_batches, emptied, shuffles_freed, stored
from lexloom.sources.store import Commit, Store

BUCKETS = 64
#: Bits of a document's place within its stripe.
STRIPE = 8
#: Stripes of a question that are scored first.
FIRST = 8
#: Different terms of all questions up to which they go into the plan as values, and to all tasks.
MOST_TERMS = 5000
#: Postings that a task packs at once, that are merged at once (about, by hash), and that go to Spark at once.
HELD, PART, SENT = 1 << 21, 1 << 20, 1 << 18
#: Blocks of a term in a row.
ROW = 64
#: A bound may be short of a score by rounding.
SLACK = 1e-6


def _bucket(term: Column | str) -> Column:
    return F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int")


def checkpointed(df: DataFrame) -> DataFrame:
    """What an index is built of, computed once."""
    return stored(df)


def packed_term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., toks) as (..., dl, n, terms, tfs): the different tokens of each row, sorted, as one text with blanks between, and how often it has each."""
    for batch in term_counts(batches):
        *rest, dl, terms, tfs = batch.columns
        ends = np.asarray(terms.offsets)
        coded = terms.flatten().dictionary_encode()
        rank = np.empty(len(coded.dictionary), np.int64)
        rank[np.asarray(pc.sort_indices(coded.dictionary))] = np.arange(len(rank))
        order = np.argsort(np.repeat(np.arange(batch.num_rows), np.diff(ends)) * max(1, len(rank)) + rank[np.asarray(coded.indices, np.int64)])
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms.flatten().take(pa.array(order))), " ")
        counts = np.asarray(tfs.flatten())[order].astype("<i4").tobytes()
        made = [dl, pa.array(np.diff(ends).astype(np.int32)), joined, pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(counts)])]
        yield pa.RecordBatch.from_arrays([*rest, *made], [*batch.schema.names[: len(rest)], "dl", "n", "terms", "tfs"])


def _lists(ends: np.ndarray, *values: pa.Array | np.ndarray) -> list[pa.ListArray]:
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for v in values]


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)))


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _dealt(parts: int):
    """(stripe, place, dl, n, terms, tfs) of documents as (part, payload): the blocks of a part's terms, one of a term in a stripe, as compressed Arrow.

    Terms are dealt to parts by their hash. A Spark row for each block would take several times the room in the shuffle.
    """

    def packed(held: list[tuple]) -> pa.RecordBatch:
        coded = pa.concat_arrays([x[0] for x in held]).dictionary_encode()
        stripe, place, dl, tf = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
        part = np.fromiter((zlib.crc32(t.encode()) % parts for t in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        by_term = np.asarray(pc.sort_indices(coded.dictionary))
        by_part = by_term[np.argsort(part[by_term], kind="stable")]
        rank = np.empty(len(part), np.int32)
        rank[by_part] = np.arange(len(part), dtype=np.int32)
        term = rank[np.asarray(coded.indices)]
        order = np.argsort(term, kind="stable")  # documents are in the order of their places
        term, stripe, place, dl, tf = term[order], stripe[order], place[order], dl[order], tf[order]
        begin = _begins(term, stripe)
        ends, own, least = np.append(begin, len(term)), part[by_part][term[begin]], np.minimum.reduceat(dl, begin)
        terms, made = coded.dictionary.take(pa.array(by_part)), []
        cuts = np.append(_begins(own), len(own))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            of, to = ends[low], ends[high]
            blocks = [terms.take(pa.array(term[begin[low:high]])), pa.array(stripe[begin[low:high]]), pa.array(least[low:high]), *_lists(ends[low : high + 1] - of, place[of:to], tf[of:to])]
            sink = pa.BufferOutputStream()
            table = pa.RecordBatch.from_arrays(blocks, ["term", "stripe", "min_dl", "places", "tfs"])
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(table)
            made.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(own[cuts[:-1]].astype(np.int32)), pa.array(made, pa.binary())], ["part", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            batch = batch.filter(pc.greater(batch.column(3), 0))
            if not batch.num_rows:
                continue
            stripe, place, dl, n, terms, tfs = batch.columns
            row = np.repeat(np.arange(batch.num_rows), np.asarray(n))
            counts = np.frombuffer(b"".join(tfs.to_pylist()), "<i4")
            held.append((pc.split_pattern(terms, " ").flatten(), np.asarray(stripe)[row], np.asarray(place).astype(np.uint8)[row], np.asarray(dl)[row], counts))
            size += len(row)
            if size >= HELD:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, payload), sorted by part, as rows of a term with up to ``ROW`` of its blocks."""

    def rows(part: int, payloads: list[bytes]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in payloads]).combine_chunks()
        term, places, tfs = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (t["term"], t["places"], t["tfs"]))
        coded = term.dictionary_encode()
        rank = np.empty(len(coded.dictionary), np.int64)
        by_term = np.asarray(pc.sort_indices(coded.dictionary))
        rank[by_term] = np.arange(len(rank))
        term, stripe, least, count = rank[np.asarray(coded.indices)], np.asarray(t["stripe"]), np.asarray(t["min_dl"]), np.diff(np.asarray(places.offsets))
        order = np.lexsort((stripe, term))
        term, stripe, least, count, first = term[order], stripe[order], least[order], count[order], np.asarray(places.offsets)[:-1][order]
        at = np.repeat(first - _ends(count)[:-1], count) + np.arange(count.sum())
        place, tf = np.asarray(places.values)[at].astype(np.int16), np.asarray(tfs.values)[at]
        begin = _begins(term, stripe)  # a stripe may have come in several pieces
        posting = _ends(np.add.reduceat(count, begin))
        term, stripe, least, most = term[begin], stripe[begin], np.minimum.reduceat(least, begin), np.maximum.reduceat(tf, posting[:-1])
        starts = _begins(term)
        nth = np.arange(len(term)) - np.repeat(starts, np.diff(np.append(starts, len(term))))
        row = np.flatnonzero(nth % ROW == 0)
        ends = np.append(row, len(term))
        made = [pa.array(np.full(len(row), part % BUCKETS, np.int32)), coded.dictionary.take(pa.array(by_term[term[row]])), pa.array(np.diff(posting[ends]).astype(np.int32)), *_lists(ends, stripe, most, least, *_lists(posting, place, tf))]
        whole = pa.RecordBatch.from_arrays(made, ["bucket", "term", "df", "stripes", "max_tfs", "min_dls", "places", "tfs"])
        cuts = [*np.flatnonzero(np.diff(posting[ends[:-1]] // SENT, prepend=-1)), len(row)]
        yield from (whole.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    own, held = None, []
    for batch in batches:
        for part, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and part != own:
                yield from rows(own, held)
                held = []
            own = part
            held.append(payload)
    if held:
        yield from rows(own, held)


def _places() -> list[Column]:
    """A row's stripe, and its place there, by its number within its partition."""
    nth = F.monotonically_increasing_id()
    return [F.shiftright(nth, STRIPE).alias("stripe"), nth.bitwiseAND((1 << STRIPE) - 1).cast("short").alias("place")]


def impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    """What a term of weight 1 gives a document; it grows with tf and falls with dl."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


class InvertedIndex:
    """The index of a collection of (id, text), in a store of its own.

    Each id names one document; a row that is there twice counts once. A null text is an empty
    document, which counts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder, "zstd")
        self._seen: tuple[int, dict[str, DataFrame]] = 0, {}

    def tables(self) -> dict[str, DataFrame]:
        """The newest commit's tables; their files are listed anew only where a commit came since."""
        newest = self.store.manifest()
        if newest and newest["seq"] != self._seen[0]:
            self._seen = newest["seq"], self.store.tables(newest["seq"])
        return self._seen[1]

    # --- building ------------------------------------------------------------

    @staticmethod
    def _dead(forward: DataFrame, dead: DataFrame) -> tuple[DataFrame, Column]:
        """``forward`` and whether a row is in ``dead``, by a word of bits for 64 places, so that no lists of terms are shuffled."""
        words = dead.groupBy(F.col("segment").alias("_g"), F.col("stripe").alias("_s"), F.shiftright(F.col("place").cast("int"), 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, place & 63)")).alias("_bits"))
        own = (F.col("segment") == F.col("_g")) & (F.col("stripe") == F.col("_s")) & (F.shiftright(F.col("place").cast("int"), 6) == F.col("_w"))
        return forward.join(F.broadcast(words), own, "left"), F.expr("coalesce(shiftrightunsigned(_bits, place & 63) & 1L, 0L) = 1L")

    def _alive(self, tables: dict[str, DataFrame]) -> DataFrame:
        rows, dead = self._dead(tables["forward"], tables["dead"])
        return rows.where(~dead).select(*tables["forward"].columns)

    def marks(self) -> str | None:
        """What the last refresh was told of the files behind the documents."""
        newest = self.store.manifest()
        return newest["note"].partition("refresh ")[2] or None if newest else None

    def refresh(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: str = "") -> tuple[int, int] | None:
        """Brings the index to ``docs``; returns how many documents came and went, or None where none did.

        ``marks`` is kept for the next reader, who may then spare a refresh.
        """
        now, tables = self._hashed(docs, id_col, text_col), self.tables()
        gone = self._alive(tables).join(now.select("id", "sha256"), ["id", "sha256"], "left_anti") if tables else None
        return self._take_in(now, gone, tables, f"refresh {marks}")

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, int] | None:
        """Takes in ``docs``, in place of the texts that their ids had before; other documents stay.

        The same documents again change nothing, so a micro-batch may be handed over twice.
        """
        now, tables = self._hashed(docs, id_col, text_col), self.tables()
        gone = self._alive(tables).join(now.select("id").distinct(), "id", "left_semi").join(now.select("id", "sha256"), ["id", "sha256"], "left_anti") if tables else None
        return self._take_in(now, gone, tables, "add")

    def remove(self, ids: DataFrame, id_col: str = "doc_id") -> tuple[int, int] | None:
        """Takes documents out by their ids."""
        tables = self.tables()
        if not tables:
            return None
        gone = self._alive(tables).join(ids.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
        none = tables["forward"].where(F.lit(False)).select("id", F.lit("").alias("text"), "sha256")
        return self._take_in(none, gone, tables, "remove")

    @staticmethod
    def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("sha256", F.sha2("text", 256))

    def _take_in(self, now: DataFrame, gone: DataFrame | None, tables: dict[str, DataFrame], note: str) -> tuple[int, int] | None:
        with shuffles_freed(self.spark):
            # The keys are held in memory, so that no texts are sorted for the join.
            fresh = now.join(self._alive(tables).select("id", "sha256").hint("shuffle_hash"), ["id", "sha256"], "left_anti") if tables else now
            return self._commit(fresh, checkpointed(gone.select("segment", "stripe", "place", "id", "dl")) if gone is not None else None, tables, note)

    def _commit(self, fresh: DataFrame, gone: DataFrame | None, tables: dict[str, DataFrame], note: str) -> tuple[int, int] | None:
        bounded_batches(self.spark)
        kind = fresh.schema["id"].dataType.simpleString()
        # Ranges by length of text, which is sorted before its tokens, which take far more room, are there; equal rows meet in their range.
        near = fresh.withColumn("_n", F.octet_length("text")).repartitionByRange("_n", "id").dropDuplicates(["_n", "id", "sha256"])
        placed = near.sortWithinPartitions("_n", "id").select("id", "sha256", tokens("text").alias("toks"))
        counted = checkpointed(placed.select(*_places(), "id", "sha256", "toks").mapInArrow(packed_term_counts, f"stripe long, place short, id {kind}, sha256 string, dl int, n int, terms string, tfs binary"))
        came, n_tokens = counted.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        went, lost = gone.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first() if gone is not None else (0, 0)
        if tables and not came and not went:
            for built in (counted, gone):
                if built is not None:
                    emptied(built)
            if note.startswith("refresh ") and self.marks() != (note.partition("refresh ")[2] or None):
                with self.store.commit(note):
                    pass
            return None
        with self.store.commit(note) as staged:
            dfs = []
            if came or not tables:
                self._append(staged, counted)
                dfs.append(staged.newest("postings").select("bucket", "term", "df"))
            emptied(counted)
            dead = gone.drop("dl") if gone is not None else staged.newest("forward").where(F.lit(False)).select("segment", "stripe", "place", "id")
            staged.append("dead", dead)
            if gone is not None:
                rows, is_dead = self._dead(tables["forward"], staged.newest("dead"))
                dfs.append(rows.where(is_dead & (F.col("n") > 0)).select(F.explode(F.split("terms", " ")).alias("term")).select(_bucket("term").alias("bucket"), "term", F.lit(-1).alias("df")))
                emptied(gone)
            if tables:
                dfs.append(tables["terms"].select("bucket", "term", "df"))
            df = dfs[0]
            for x in dfs[1:]:
                df = df.unionByName(x)
            df = df.groupBy("bucket", "term").agg(F.sum("df").alias("df")).where("df > 0").select("term", "df", "bucket")
            staged.replace("terms", df.repartition("bucket").sortWithinPartitions("bucket", "term"), by=["bucket"])
            old = tables["size"].first() if tables else None
            n_docs, total = came - went + (old.n_docs if old else 0), n_tokens - lost + (old.n_tokens if old else 0)
            mean = staged.newest("terms").agg(F.avg(_raw(F.lit(n_docs), F.col("df")))).first()[0]
            staged.replace("size", self.spark.createDataFrame([(n_docs, total, float(mean or 0.0))], "n_docs long, n_tokens long, mean double").coalesce(1))
        return came, went

    @staticmethod
    def _append(staged: Commit, counted: DataFrame) -> None:
        """A segment of documents with their counted terms."""
        segment = F.lit(staged.base + 1)
        staged.append("forward", counted.withColumn("segment", segment))
        forward = staged.newest("forward")
        listed = forward.groupBy("segment", "stripe").agg(F.sort_array(F.collect_list(F.struct("place", "id", "dl"))).alias("x"))  # a stripe's documents
        staged.append("stripes", listed.select("segment", "stripe", F.col("x.id").alias("ids"), F.col("x.dl").alias("dls")))
        parts = BUCKETS * max(1, math.ceil((forward.agg(F.sum("n")).first()[0] or 0) / (BUCKETS * PART)))
        dealt = forward.select("stripe", "place", "dl", "n", "terms", "tfs").mapInArrow(_dealt(parts), "part int, payload binary").repartition("part").sortWithinPartitions("part")
        rows = dealt.mapInArrow(_merged, "bucket int, term string, df int, stripes array<long>, max_tfs array<int>, min_dls array<int>, places array<array<short>>, tfs array<array<int>>")
        staged.append("postings", rows.withColumn("segment", segment).sortWithinPartitions("bucket", "term"), by=["bucket"])

    def compact(self) -> None:
        """One segment of all that is alive, without what is dead; statistics stay."""
        bounded_batches(self.spark)
        tables = self.tables()
        placed = self._alive(tables).select("id", "sha256", "dl", "n", "terms", "tfs").repartitionByRange("dl", "id").sortWithinPartitions("dl", "id")
        with shuffles_freed(self.spark), self.store.commit(f"refresh {self.marks() or ''}") as staged:
            for name in ("forward", "stripes", "postings"):
                staged.drop(name)
            self._append(staged, placed.select(*_places(), "id", "sha256", "dl", "n", "terms", "tfs"))
            staged.replace("dead", tables["dead"].where(F.lit(False)))

    def integrity(self) -> DataFrame:
        """One row: documents and tokens by the statistics and by what is alive, and postings by both; ``ok`` where all agree."""
        t = self.tables()
        own = self._alive(t).agg(F.count("*").alias("alive_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("alive_tokens"), F.coalesce(F.sum("n"), F.lit(0)).alias("alive_postings"))
        df = t["terms"].agg(F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
        rows = t["size"].crossJoin(own).crossJoin(df)  # three single rows
        return rows.withColumn("ok", (F.col("n_docs") == F.col("alive_docs")) & (F.col("n_tokens") == F.col("alive_tokens")) & (F.col("postings") == F.col("alive_postings")))

    # --- asking --------------------------------------------------------------

    def _asked(self, tables: dict[str, DataFrame], questions: DataFrame, query_id: str, query_text: str) -> tuple[DataFrame, list[tuple[int, str]] | None]:
        """((qid, bucket, term, w), the different terms if they and the questions are few enough to name them)."""
        asked = query_terms(questions, query_id, query_text).withColumn("bucket", _bucket("term"))
        distinct = asked.select("bucket", "term").distinct().limit(MOST_TERMS + 1).collect()
        few = [(r.bucket, r.term) for r in distinct] if len(distinct) <= MOST_TERMS else None
        known = self._of(tables["terms"], few).join(asked, ["bucket", "term"])
        weights = known.crossJoin(F.broadcast(tables["size"])).withColumn("raw", _raw(F.col("n_docs"), F.col("df")))  # size is one row
        w = F.col("qtf") * F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
        asked = ranking.checkpointed(weights.select("qid", "bucket", "term", w.alias("w"), (F.col("n_tokens") / F.col("n_docs")).alias("avgdl")))
        n = asked.limit(MOST_WEIGHTS + 1).count()
        # Weights go to all tasks, so that no list of postings is shuffled by its term or for each question.
        return F.broadcast(asked) if n <= MOST_WEIGHTS else asked, few if n <= 4 * MOST_TERMS else None

    @staticmethod
    def _of(table: DataFrame, few: list[tuple[int, str]] | None) -> DataFrame:
        """Rows of the asked terms: their partitions, and of those the row groups that may have them."""
        return table if few is None else table.where(F.col("bucket").isin(sorted({b for b, _ in few})) & F.col("term").isin(sorted(t for _, t in few)))

    def bounds(self, asked: DataFrame, few: list | None, postings: DataFrame) -> DataFrame:
        """(qid, segment, stripe, bound): what a document of the stripe scores at most; places aren't read."""
        heads = self._of(postings, few).select("bucket", "term", "segment", "stripes", "max_tfs", "min_dls").join(asked, ["bucket", "term"])
        each = heads.select("qid", "segment", "w", "avgdl", F.explode(F.arrays_zip("stripes", "max_tfs", "min_dls")).alias("b"))
        most = F.greatest(F.lit(0.0), F.col("w") * impact(F.col("b.max_tfs"), F.col("b.min_dls"), F.col("avgdl")))
        return each.groupBy("qid", "segment", F.col("b.stripes").alias("stripe")).agg(F.sum(most).alias("bound")).where("bound > 0")

    def _scores(self, tables: dict[str, DataFrame], asked: DataFrame, few: list | None, stripes: DataFrame, small: bool = False) -> DataFrame:
        """(qid, id, score) of the documents of some stripes with a positive score.

        Postings meet the documents of their stripe before they meet the questions, and what a question gives a document adds up there.
        """
        gone = tables["dead"].groupBy("segment", "stripe").agg(F.collect_list("place").alias("gone"))  # places of a stripe
        own = tables["stripes"].join(stripes.groupBy("segment", "stripe").agg(F.collect_set("qid").alias("qids")), ["segment", "stripe"]).join(gone, ["segment", "stripe"], "left")
        own = own.crossJoin(F.broadcast(tables["size"].select(F.try_divide("n_tokens", "n_docs").alias("avgdl"))))  # size is one row
        lists = self._of(tables["postings"], few)
        if few is None:
            terms = asked.select("bucket", "term").distinct()
            lists = lists.join(F.broadcast(terms) if terms.limit(MOST_WEIGHTS + 1).count() <= MOST_WEIGHTS else terms, ["bucket", "term"], "left_semi")
        blocks = lists.select("bucket", "term", "segment", F.explode(F.arrays_zip("stripes", "places", "tfs")).alias("b")).select("bucket", "term", "segment", F.col("b.stripes").alias("stripe"), F.col("b.places").alias("places"), F.col("b.tfs").alias("tfs"))
        met = blocks.join(F.broadcast(own) if small else own.hint("shuffle_hash"), ["segment", "stripe"])
        pairs = F.arrays_zip("places", "tfs")
        pairs = F.when(F.col("gone").isNull(), pairs).otherwise(F.filter(pairs, lambda p: ~F.array_contains("gone", p.places)))
        parts = F.transform(pairs, lambda p: F.struct(F.get("ids", p.places).alias("id"), impact(p.tfs, F.get("dls", p.places), F.col("avgdl")).alias("x")))
        each = met.select("bucket", "term", "segment", "stripe", "qids", parts.alias("parts")).join(asked.drop("avgdl"), ["bucket", "term"]).where(F.array_contains("qids", F.col("qid"))).select("qid", "segment", "stripe", "w", F.explode("parts").alias("p"))
        return each.groupBy("segment", "stripe", "qid", F.col("p.id").alias("id")).agg(F.sum(F.col("w") * F.col("p.x")).alias("score")).where("score > 0").select("qid", "id", "score")

    def top(self, questions: DataFrame, k: int, query_id: str = "qid", query_text: str = "query") -> DataFrame:
        """(qid, id, score, rank from 1): the best ``k`` of each question, scores to six places, ties by id.

        Nothing that could be among them is left out: a stripe is skipped only where its bound is
        below the k-th best score of the stripes taken first.
        """
        tables = self.tables()
        asked, few = self._asked(tables, questions, query_id, query_text)
        bounds = ranking.checkpointed(self.bounds(asked, few, tables["postings"]))
        by = Window.partitionBy("qid")
        first = bounds.withColumn("_n", F.row_number().over(by.orderBy(F.desc("bound"), "segment", "stripe"))).where(F.col("_n") <= FIRST)
        best = self._scores(tables, asked, few, first, few is not None)  # FIRST stripes for each question at most.withColumn("_n", F.row_number().over(by.orderBy(F.desc("score"), "id"))).where(F.col("_n") <= k)
        least = best.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        if few is not None:
            least = F.broadcast(least)  # a row for each question at most, and questions have terms
        open_ = bounds.join(least, "qid", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
        return top_by_query(self._scores(tables, asked, few, open_), k)

    def top_one(self, question: str, k: int) -> DataFrame:
        """(rank from 1, id, score) of one question."""
        asked = self.spark.createDataFrame([(0, question)], "qid int, query string")
        return self.top(asked, k).select("rank", "id", "score")


def _raw(n_docs: Column, df: Column) -> Column:
    return F.log(n_docs - df + 0.5) - F.log(df + 0.5)
