"""Dense and lexical scores of a whole collection for many questions, fused by reciprocal ranks.

Documents and questions are dealt to parts of bounded size, and each cell of their grid holds the
scores of its documents for its questions as one block. No ranking is sorted whole: the best of a
question in either ranking are its candidates, and a candidate's rank is the number of documents
before it, counted block by block. A document that is no candidate has a worse rank on both sides
than all of these, which bounds its fused score; where the bound isn't below the last result,
the question takes more candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.dense import _matrix
from lexloom.operators.fusion import RRF_K
from lexloom.operators.lexical import K1, B
from lexloom.operators.ranking import checkpointed

#: Documents and their different terms in a part, and questions in a part, at most, about.
PART_ROWS, PART_TERMS, PART_QUESTIONS = 8192, 2_000_000, 512
#: Entries of a matrix that a task computes at once, and documents of a row of scores.
AT_ONCE, ROW_DOCS = 1 << 21, 1024
#: Candidates of a filtered question in each ranking at first, beside twice its results, and how much more of them come each round.
FIRST, MORE = 80, 8


def blocks(corpus: DataFrame, asked: DataFrame, avgdl: float) -> DataFrame:
    """(i, j, ids, qids, ms, dist, lex, may): scores of some documents for some questions, question by question.

    ``corpus``: id, v, passes, dl, terms, tfs. ``asked``: qid, v, only, scaled, m, terms, ws. Squared
    distances and BM25 to six places; NaN where there is no vector or no positive score.
    """
    size = corpus.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).first()
    parts, columns = max(1, -(-size.n // PART_ROWS), -(-int(size.terms or 0) // PART_TERMS)), max(1, -(-asked.count() // PART_QUESTIONS))
    number = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = corpus.withColumn("i", number(parts, "id")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    b = asked.withColumn("j", number(columns, "qid")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kinds = f"i int, j int, ids array<{dict(corpus.dtypes)['id']}>, qids array<string>, ms array<long>, dist array<double>, lex array<double>, may array<boolean>"

    def cell(x: pa.Table, q: pa.Table) -> pa.Table:
        return _block(x, q, avgdl)

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(cell, kinds)


def _block(own: pa.Table, asked: pa.Table, avgdl: float) -> pa.Table:
    names = ["i", "j", "ids", "qids", "ms", "dist", "lex", "may"]
    lists = [pa.list_(own.schema.field("id").type), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.bool_())]
    if not own.num_rows or not asked.num_rows:
        return pa.table([pa.array([], t) for t in [pa.int32(), pa.int32(), *lists]], names)
    i, j = own.column("i")[0].as_py(), own.column("j")[0].as_py()
    own = own.take(pc.sort_indices(own.column("id")))
    qids, only, scaled = asked.column("qid").to_pylist(), asked.column("only").to_pylist(), np.array([bool(x) for x in asked.column("scaled").to_pylist()])
    queries = _matrix(asked.column("v"))[1]
    terms, ws = asked.column("terms").combine_chunks(), asked.column("ws").combine_chunks()
    words = terms.flatten().unique()
    of = np.repeat(np.arange(len(qids)), np.asarray(pc.list_value_length(terms).fill_null(0)))
    word, weight = np.asarray(pc.index_in(terms.flatten(), words)), np.asarray(ws.flatten())
    out = []
    step = max(1, min(ROW_DOCS, AT_ONCE // max(1, len(qids), len(words))))
    for at in range(0, own.num_rows, step):
        some = own.slice(at, step).combine_chunks()
        n = some.num_rows
        dist, may = np.full((len(qids), n), np.nan), np.ones((len(qids), n), bool)
        full = np.flatnonzero(np.asarray(some.column("v").is_valid()))
        if len(full):
            raw, unit = _matrix(some.column("v").take(pa.array(full)))
            for flag, x in ((True, raw), (False, unit)):
                mine = np.flatnonzero(scaled == flag)
                if len(mine):
                    q = queries[mine]
                    dist[np.ix_(mine, full)] = np.round(np.maximum(0, (q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None] - 2 * (q @ x.T)), 6)
        lex = _lexical(some, words, of, word, weight, len(qids), avgdl)
        passes = some.column("passes").combine_chunks()
        row, passed = np.repeat(np.arange(n), np.asarray(pc.list_value_length(passes).fill_null(0))), np.asarray(passes.flatten())
        for f in {x for x in only if x is not None}:
            may[np.ix_([k for k, x in enumerate(only) if x == f], np.setdiff1d(np.arange(n), row[passed == f]))] = False
        out.append((i, j, some.column("id"), dist, lex, may))
    one = lambda parts, kind: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.concat_arrays([p.cast(kind.value_type) for p in parts]))
    m = pa.array(asked.column("m").to_pylist(), pa.int64())
    columns = [[x[2].combine_chunks() for x in out], [pa.array(qids, pa.string())] * len(out), [m] * len(out), *([pa.array(x[k].ravel()) for x in out] for k in (3, 4, 5))]
    return pa.table([pa.array([i] * len(out), pa.int32()), pa.array([j] * len(out), pa.int32()), *(one(c, t) for c, t in zip(columns, lists, strict=True))], names)


def _lexical(some: pa.Table, words: pa.Array, of: np.ndarray, word: np.ndarray, weight: np.ndarray, n_asked: int, avgdl: float) -> np.ndarray:
    """BM25 of each question for each document, to six places; NaN where it isn't positive."""
    terms = some.column("terms").combine_chunks()
    n = some.num_rows
    score = np.zeros((n_asked, n))
    if len(words):
        row = np.repeat(np.arange(n), np.asarray(pc.list_value_length(terms).fill_null(0)))
        code = np.asarray(pc.index_in(terms.flatten(), words).fill_null(-1))
        tf, dl = np.asarray(some.column("tfs").combine_chunks().flatten())[code >= 0], np.asarray(some.column("dl"))
        row, code = row[code >= 0], code[code >= 0]
        given = np.zeros((len(words), n))
        given[code, row] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl))
        step = max(1, AT_ONCE // len(words))
        for at in range(0, n_asked, step):
            own = (of >= at) & (of < at + step)
            weights = np.zeros((min(step, n_asked - at), len(words)))
            weights[of[own] - at, word[own]] = weight[own]
            score[at : at + step] = weights @ given
    return np.where(score > 0, np.round(score, 6), np.nan)


def _best(found: list, m: int) -> list:
    """Of (key, ids, dist, lex) the first ``m`` by key, then id."""
    key, ids, dist, lex = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(key) > m:
        at = np.flatnonzero(key <= np.partition(key, m - 1)[m - 1])
        at = at[np.argsort(ids[at], kind="stable")]
        at = at[np.argsort(key[at], kind="stable")][:m]
        key, ids, dist, lex = key[at], ids[at], dist[at], lex[at]
    return [(key, ids, dist, lex)]


def candidates(scored: DataFrame, times: int, id_kind: str) -> DataFrame:
    """(qid, arm, id, dist, lex, m): of each partition the best of each ranking that pass their question's filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, most, kind = {}, {}, None
        for batch in batches:
            for r in range(batch.num_rows):
                ids, qids, ms, dist, lex, may = (batch.column(c)[r].values for c in ("ids", "qids", "ms", "dist", "lex", "may"))
                kind, names, qids = ids.type, np.asarray(ids), qids.to_pylist()
                dist, lex, may = (np.asarray(x.to_numpy(zero_copy_only=False)).reshape(len(qids), -1) for x in (dist, lex, may))
                for q, qid in enumerate(qids):
                    most[qid] = ms[q].as_py() * times
                    for arm, key in (("dense", dist[q]), ("lexical", -lex[q])):
                        at = np.flatnonzero(may[q] & ~np.isnan(key))
                        held = best.get((qid, arm), [])
                        if len(held) and len(held[0][0]) >= most[qid]:  # later blocks have other ids, so equal keys count too
                            at = at[key[at] <= held[0][0].max()]
                        if len(at):
                            best[qid, arm] = _best([*held, (key[at], names[at], dist[q][at], lex[q][at])], most[qid])
        for (qid, arm), [(_, ids, dist, lex)] in best.items():
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([qid] * n), pa.array([arm] * n), pa.array(ids, kind), pa.array(dist), pa.array(lex), pa.array([most[qid]] * n, pa.int64())], ["qid", "arm", "id", "dist", "lex", "m"])

    return scored.select("ids", "qids", "ms", "dist", "lex", "may").mapInArrow(run, f"qid string, arm string, id {id_kind}, dist double, lex double, m long")


def _before(scores: np.ndarray, values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many of ``scores``, which lie by id, come before each of ``values`` at its place among the ids."""
    at = np.flatnonzero(~np.isnan(scores))
    levels, level = np.unique(scores[at], return_inverse=True)
    width = len(scores) + 1
    keys = np.sort(level * width + at)
    mine = np.searchsorted(levels, values)
    same = (mine < len(levels)) & (levels[np.minimum(mine, len(levels) - 1)] == values) if len(levels) else np.zeros(len(values), bool)
    return np.where(np.isnan(values), 0, np.searchsorted(keys, mine * width + np.where(same, place, 0)))


def _counts(scored: pa.Table, wanted: pa.Table) -> pa.Table:
    """(qid, id, before_dense, before_lexical): documents of these blocks before each wanted one."""
    qid = np.asarray(wanted.column("qid"))
    order = np.argsort(qid, kind="stable")
    wanted = wanted.take(pa.array(order)).combine_chunks()
    qid, ids = qid[order], np.asarray(wanted.column("id"))
    dist, lex = (wanted.column(c).to_numpy() for c in ("dist", "lex"))
    n = np.zeros((2, wanted.num_rows), np.int64)
    names, begin = np.unique(qid, return_index=True) if len(qid) else ([], [])
    ends = dict(zip(names, zip(begin, [*begin[1:], len(qid)], strict=True), strict=True))
    for r in range(scored.num_rows):
        own, qids = np.asarray(scored.column("ids")[r].values), scored.column("qids")[r].as_py()
        d, x = (scored.column(c)[r].values.to_numpy().reshape(len(qids), -1) for c in ("dist", "lex"))
        for q, name in enumerate(qids):
            if name in ends:
                a, b = ends[name]
                place = np.searchsorted(own, ids[a:b])
                n[0, a:b] += _before(d[q], dist[a:b], place)
                n[1, a:b] += _before(-x[q], -lex[a:b], place)
    return pa.table([wanted.column("qid"), wanted.column("id"), pa.array(n[0]), pa.array(n[1])], ["qid", "id", "before_dense", "before_lexical"])


def fused(corpus: DataFrame, asked: DataFrame, avgdl: float) -> DataFrame:
    """(qid, id, score, rank from 0): the best ``k`` by reciprocal ranks of what passes each question's filter, scores to nine places, ties by id.

    Ranks are those of the whole collection, of which each ranking counts to ``pool``.
    """
    id_kind = dict(corpus.dtypes)["id"]
    m = F.when(F.col("only").isNull(), F.col("pool")).otherwise(F.lit(FIRST) + 2 * F.col("k"))
    scored = checkpointed(blocks(corpus, asked.select("qid", "v", "only", "scaled", m.cast("long").alias("m"), "terms", "ws"), avgdl))
    cells = scored.select(F.col("i").alias("i"), F.col("j").alias("j"), F.explode("qids").alias("qid")).distinct()
    left, done, times = asked.select("qid", "only", "k", "pool"), None, 1
    while True:
        of = Window.partitionBy("qid", "arm").orderBy(F.when(F.col("arm") == "dense", F.col("dist")).otherwise(-F.col("lex")), "id")
        top = candidates(scored, times, id_kind).join(left.select("qid"), "qid", "left_semi")
        top = checkpointed(top.withColumn("nth", F.row_number().over(of)).where(F.col("nth") <= F.col("m")))
        wanted = top.groupBy("qid", "id").agg(F.first("dist").alias("dist"), F.first("lex").alias("lex"))
        sent = wanted.join(cells, "qid").select("i", "j", "qid", "id", "dist", "lex")
        each = scored.select("i", "j", "ids", "qids", "dist", "lex").groupBy("i", "j").cogroup(sent.groupBy("i", "j")).applyInArrow(_counts, f"qid string, id {id_kind}, before_dense long, before_lexical long")
        ranks = checkpointed(each.groupBy("qid", "id").agg(F.sum("before_dense").alias("dense"), F.sum("before_lexical").alias("lexical")).join(wanted, ["qid", "id"]).join(left, "qid"))
        part = lambda value, rank: F.when(~F.isnan(value) & (F.col(rank) < F.col("pool")), 1.0 / (F.lit(RRF_K) + F.col(rank) + 1))
        dense, lexical = part("dist", "dense"), part("lex", "lexical")
        scores = ranks.select("qid", "id", "only", "k", F.round(F.coalesce(dense, F.lit(0.0)) + F.coalesce(lexical, F.lit(0.0)), 9).alias("score"))
        best = scores.where("score > 0").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")) - 1).where(F.col("rank") < F.col("k"))
        # What a filtered question's other documents score at most: nothing in a ranking that had no more of them.
        last = top.where("nth = m").join(ranks.select("qid", "id", "dense", "lexical"), ["qid", "id"]).select("qid", (1.0 / (F.lit(RRF_K) + F.when(F.col("arm") == "dense", F.col("dense")).otherwise(F.col("lexical")) + 1)).alias("most"))
        bound = last.groupBy("qid").agg(F.round(F.sum("most"), 9).alias("bound"))
        least = best.groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        open_ = left.where("only IS NOT NULL").join(bound, "qid").join(least, "qid", "left").where((F.coalesce("n", F.lit(0)) < F.col("k")) | (F.col("bound") >= F.col("least")))
        more = checkpointed(open_.select("qid", "only", "k", "pool"))
        found = checkpointed(best.join(more, "qid", "left_anti").select("qid", "id", "score", F.col("rank").cast("int").alias("rank")))
        done = found if done is None else done.unionByName(found)
        if not more.count():
            return done
        left, times = more, times * MORE
