"""Exact nearest neighbours and care of vector tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.vectors import norm, normalize, squared_distance

#: Bytes of the vectors of a part of the queries, and of the corpus.
PART_BYTES = 8 << 20
#: Distances that a task computes at once.
AT_ONCE = 1 << 22
NORM_SLACK = 1e-3


def distance_to(query: list[float], vector: str = "embedding", scaled: bool = True) -> Column:
    """Squared L2 from one query, to six places.

    The query is scaled to unit length, and so are stored vectors unless ``scaled`` says that they
    are. A zero vector stays zero.
    """
    q = np.asarray(query, np.float64)
    q = q / max(float(np.sqrt((q * q).sum())), 1e-12)
    stored = F.col(vector) if scaled else normalize(vector)
    return F.round(squared_distance(stored, F.array(*map(F.lit, q.tolist()))), 6)


def distances(vectors: DataFrame, query: list[float], id_col: str = "vec_id", vector: str = "embedding", scaled: bool = True) -> DataFrame:
    """(id, distance) of every row from one query, as ``distance_to`` has it. Null vectors are left out."""
    return vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), distance_to(query, vector, scaled).alias("distance"))


def nearest(vectors: DataFrame, query: list[float], n: int, id_col: str = "vec_id", vector: str = "embedding", scaled: bool = True) -> DataFrame:
    """(id, distance): the ``n`` rows nearest to one query, ties by id."""
    return distances(vectors, query, id_col, vector, scaled).orderBy("distance", "id").limit(n)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", query_id: str = "vec_id", vector: str = "embedding", drop_self: bool = False) -> DataFrame:
    """(qid, id, distance, rank): the ``k`` nearest of each query by squared L2 of unit vectors, ties by id.

    See ``grid`` for how queries and corpus meet. Null vectors are left out on both sides.
    """
    asked = queries.select(F.col(query_id).cast("long").alias("qid"), F.col(vector).cast("array<double>").alias("v"), F.lit(k).alias("keep"))
    corpus = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    ranked = grid(corpus, asked, drop_self).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k)


def grid(corpus: DataFrame, asked: DataFrame, drop_self: bool = False) -> DataFrame:
    """(qid, id, distance): of ``corpus`` (id, v) the nearest of each of ``asked`` (qid, v, keep), and more than those.

    Both sides are dealt to parts of bounded size; each part of the corpus is computed once and
    shuffled to the cells of its row of the grid, each part of the queries to those of its column.
    A cell passes on at most the best ``keep`` of each query, so what comes out can be cut to the
    best of all; a null ``keep`` asks for every row. Where ``corpus`` has ``passes`` (numbers of
    filters) and ``asked`` has ``only``, a query sees the rows that pass its filter, and all where
    ``only`` is null. Where ``asked`` has ``scaled`` and it is true, stored vectors are taken as they are.
    """
    own, theirs = corpus.where("v IS NOT NULL"), asked.where("v IS NOT NULL")
    first = theirs.select(F.size("v").alias("n")).first()
    rows = max(1, PART_BYTES // (8 * max(1, first.n if first else 1)))
    parts, columns = max(1, -(-own.count() // rows)), max(1, -(-theirs.count() // rows))
    own = own if "passes" in own.columns else own.withColumn("passes", F.lit(None).cast("array<int>"))
    for name, kind in (("only", "int"), ("scaled", "boolean")):
        theirs = theirs if name in theirs.columns else theirs.withColumn(name, F.lit(None).cast(kind))
    number = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    # Copies for each cell: as many as the other side has parts, so one where the queries are few.
    a = own.select("id", "v", "passes", number(parts, "id", "v").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"))
    b = theirs.select("qid", "v", "keep", "only", "scaled", number(columns, "qid", "v").alias("j"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i"))
    kinds = f"qid {dict(theirs.dtypes)['qid']}, id {dict(own.dtypes)['id']}, distance double"

    def cell(x: pa.Table, q: pa.Table) -> pa.Table:
        return _cell(x, q, drop_self)

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(cell, kinds)


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, as they are and scaled to unit length."""
    x = np.asarray(column.combine_chunks().flatten()).reshape(len(column), -1)
    return x, x / np.maximum(np.sqrt((x**2).sum(axis=1, keepdims=True)), 1e-12)


def _cell(own: pa.Table, asked: pa.Table, drop_self: bool) -> pa.Table:
    """The best rows of a part of the corpus for each query of a part of the queries."""
    if not own.num_rows or not asked.num_rows:
        return asked.select(["qid"]).slice(0, 0).append_column("id", pa.array([], own.schema.field("id").type)).append_column("distance", pa.array([], pa.float64()))
    found, far = [], []
    order = np.asarray(pc.sort_indices(own.column("id")))  # ties by id stay in their order
    own = own.take(pa.array(order))
    ids, (raw, unit), queries = own.column("id").combine_chunks(), _matrix(own.column("v")), _matrix(asked.column("v"))[1]
    passes = own.column("passes").combine_chunks()
    filled = pc.list_value_length(passes).fill_null(0)
    row, of = np.repeat(np.arange(len(passes)), np.asarray(filled)), np.asarray(passes.flatten())
    keep, only, scaled, qid = (asked.column(c).to_pylist() for c in ("keep", "only", "scaled", "qid"))
    counts = np.zeros(len(qid), np.int64)
    names, squares = np.asarray(ids), {True: (raw**2).sum(axis=1), False: (unit**2).sum(axis=1)}
    at_once = max(1, AT_ONCE // len(ids))
    for i, q in enumerate(queries):
        if i % at_once == 0:
            some = queries[i : i + at_once].T
            dots = {flag: (raw if flag else unit) @ some for flag in {bool(x) for x in scaled[i : i + at_once]}}
        flag = bool(scaled[i])
        d = np.round(np.maximum(0, (q**2).sum() + squares[flag] - 2 * dots[flag][:, i % at_once]), 6)
        if only[i] is not None:
            may = np.zeros(len(d), bool)
            may[row[of == only[i]]] = True
            d[~may] = np.inf
        if drop_self:
            d[names == qid[i]] = np.inf
        at = np.flatnonzero(np.isfinite(d))
        if keep[i] is not None and keep[i] < len(at):
            most = np.partition(d[at], keep[i] - 1)[keep[i] - 1]
            at = at[d[at] <= most]
            at = at[np.argsort(d[at], kind="stable")][: keep[i]]
        counts[i] = len(at)
        found.append(at.astype(np.int32))
        far.append(d[at])
    # One table of few buffers: a table for each query would hold more in objects than in rows.
    whole = asked.column("qid").combine_chunks().take(pa.array(np.repeat(np.arange(len(qid)), counts)))
    return pa.table([whole, ids.take(pa.array(np.concatenate(found))), pa.array(np.concatenate(far))], ["qid", "id", "distance"])


def integrity(vectors: DataFrame, meta: DataFrame, normalized: bool, vector: str = "embedding") -> DataFrame:
    """One row of what an index must hold: as many vectors as rows, mean norm 1, the flag set."""
    mean = vectors.where(F.col(vector).isNotNull()).agg(F.avg(norm(vector)).alias("mean_norm"))
    counts = vectors.agg(F.count("*").alias("n_vectors")).crossJoin(meta.agg(F.count("*").alias("n_rows"))).crossJoin(mean)  # three single rows
    checks = F.filter(
        F.array(
            F.when(F.col("n_vectors") != F.col("n_rows"), "count"),
            F.when((F.col("n_vectors") > 0) & (F.abs(F.col("mean_norm") - 1) > NORM_SLACK), "norm"),
            F.when(F.lit(not normalized), "flag"),
        ),
        lambda x: x.isNotNull(),
    )
    return counts.withColumn("problems", F.array_join(checks, ",")).withColumn("ok", F.col("problems") == "")


def assert_integrity(vectors: DataFrame, meta: DataFrame, normalized: bool, vector: str = "embedding") -> None:
    row = integrity(vectors, meta, normalized, vector).first()
    if not row.ok:
        raise ValueError(f"index integrity: {row.problems} (vectors {row.n_vectors}, rows {row.n_rows}, mean norm {row.mean_norm})")


def coherence(indexed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, status): ``phantom`` where only the index has it, ``unindexed`` where only the chunks have it."""
    a, b = indexed.select(key).distinct(), present.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("status", F.lit("phantom")).unionByName(b.join(a, key, "left_anti").withColumn("status", F.lit("unindexed")))


def prune(index: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The index without what is gone; vectors of the rest stay as they are."""
    return index.join(gone.select(key).distinct(), key, "left_anti")


def incremental(index: DataFrame, chunks: DataFrame, key: str, same_model: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows of the index to keep, chunks to embed).

    Another model rebuilds everything. If there are no chunks at all, nothing is pruned: an empty
    input must not wipe an index.
    """
    if not same_model:
        return index.where(F.lit(False)), chunks
    new = chunks.join(index.select(key).distinct(), key, "left_anti")
    if chunks.limit(1).count() == 0:
        return index, new
    return index.join(chunks.select(key).distinct(), key, "left_semi"), new


def incremental_by_hash(index: DataFrame, chunks: DataFrame, key: str = "book_id", digest: str = "sha256", same_model: bool = True) -> tuple[DataFrame, DataFrame]:
    """As ``incremental``, but a document with another content hash is embedded anew."""
    if not same_model:
        return index.where(F.lit(False)), chunks
    on = [key, digest]
    return index.join(chunks.select(*on).distinct(), on, "left_semi"), chunks.join(index.select(*on).distinct(), on, "left_anti")
