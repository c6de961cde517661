"""Whitening of embeddings from an exact covariance, by bit-sliced scatter.

Entries become whole numbers. In a block of rows each dimension is shifted to its least value, and
each bit of the shifted numbers is a plane: one bit a row, 64 rows in a word. The popcounts of the
planes of two dimensions ANDed, weighted by their bits, are the sum of products of the two; the
shifts are put back as whole numbers. Tasks add up their blocks, Spark adds up the tasks, and the
covariance is centred in whole numbers before its eigenvectors are taken. The driver holds a
matrix of dimensions by dimensions, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import table, tidy

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows of a block, a multiple of 64, and words that are ANDed at once.
BLOCK_ROWS, AT_ONCE = 4096, 1 << 20
#: Entries stay below this, so that 64 times an entry is exact and a square fits a decimal of 38 digits.
MOST_ENTRY = 2.0**46
_SUM = pa.decimal128(38, 0)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): rows whose vector has entries, all of them finite numbers."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(F.col(id_col).alias("id"), v.alias("v")).where((F.size("v") > 0) & ~bad)


def whole(rows: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix of whole numbers."""
    flat = np.asarray(rows.flatten())
    size = np.diff(np.asarray(rows.offsets))
    if len(size) and (size != size[0]).any():
        raise ValueError("vectors of several lengths")
    if (np.abs(flat) >= MOST_ENTRY).any():
        raise ValueError("an entry is too large to be whitened exactly")
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(len(size), -1)


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least value of each dimension, planes by dimension, bit and word of 64 rows) of whole numbers."""
    least = x.min(axis=0)
    y = (x - least).astype(np.uint64)
    bits = max(1, int(y.max()).bit_length())
    rows = np.zeros((-(-len(y) // 64) * 64, y.shape[1]), np.uint64)
    rows[: len(y)] = y
    planes = [np.packbits(((rows >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little") for b in range(bits)]
    return least, np.ascontiguousarray(np.stack(planes).transpose(2, 0, 1)).view(np.uint64)  # bytes of a dimension's plane are neighbours


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of a block of rows, exact, as Python's whole numbers."""
    least, planes = bit_planes(x)
    dims, bits, words = planes.shape
    flat = planes.reshape(dims * bits, words)
    ones = np.bitwise_count(flat).sum(axis=1, dtype=np.int64).reshape(dims, bits)
    weight = np.array([1 << b for b in range(bits)], object)
    small = 2 * bits + int(len(x)).bit_length() < 62
    kind = np.int64 if small else object
    pair = (weight[:, None] * weight[None]).astype(kind)
    y = (ones.astype(object) * weight).sum(axis=1)
    yy = np.zeros((dims, dims), object)
    step = max(1, AT_ONCE // (bits * bits * words))
    for i in range(dims):
        for j in range(i, dims, step):
            other = planes[j : j + step]
            counts = np.bitwise_count(planes[i][None, :, None] & other[:, None]).sum(axis=3, dtype=np.int64)
            yy[i, j : j + step] = (counts.astype(kind) * pair).sum(axis=(1, 2))
            yy[j : j + step, i] = yy[i, j : j + step]
    m = least.astype(object)
    return y + len(x) * m, yy + m[:, None] * y[None] + y[:, None] * m[None] + len(x) * m[:, None] * m[None]


@tidy
def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each dimension of what a task has seen: n, its sum, and its products with itself and the later ones."""
    n, total, products = 0, None, None
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK_ROWS):
            x = whole(batch.column(0).slice(i, BLOCK_ROWS))
            s, p = scatter(x)
            if total is not None and len(total) != len(s):
                raise ValueError("vectors of several lengths")
            n, total, products = n + len(x), s if total is None else total + s, p if products is None else products + p
    if n:
        dims = len(total)
        made = [pa.array([[Decimal(v) for v in products[i, i:]]], pa.list_(_SUM)) for i in range(dims)]
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array([Decimal(v) for v in total], _SUM), pa.concat_arrays(made)], ["i", "n", "s", "p"])


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: its size, exact sums, and components with their eigenvalues, the greatest first."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # a column for each component
    trace: float

    @property
    def weights(self) -> np.ndarray:
        """A column for each component, over the root of its eigenvalue; NaN where that is nought."""
        least = len(self.sums) * np.finfo(np.float64).eps * max(self.values[0], 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.values > least, self.vectors / np.sqrt(self.values), np.nan)


def fit(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> Whitening | None:
    """The whitening of all usable rows, or None where there are none. Raises where vectors differ in length.

    Repeated rows count as often as they are there. Row ids are not read.
    """
    parts = usable(vectors, id_col, vector).select("v").mapInArrow(_partial, "i int, n long, s decimal(38,0), p array<decimal(38,0)>")
    sums = parts.select("i", F.posexplode("p").alias("k", "p"), F.when(F.col("k") == 0, F.col("n")).alias("n"), F.when(F.col("k") == 0, F.col("s")).alias("s"))
    found = sums.groupBy("i", "k").agg(*(F.sum(c).cast("decimal(38,0)").alias(c) for c in ("p", "n", "s"))).toArrow().to_pylist()  # dimensions by dimensions
    if not found:
        return None
    dims = 1 + max(r["i"] for r in found)
    own = {r["i"]: r for r in found if r["k"] == 0}
    n = int(own[0]["n"])
    if any(int(r["n"]) != n for r in own.values()):
        raise ValueError("vectors of several lengths")
    total = [int(own[i]["s"]) for i in range(dims)]
    v = np.zeros((dims, dims))
    for r in found:
        i, j = r["i"], r["i"] + r["k"]
        v[i, j] = v[j, i] = float(Fraction(n * int(r["p"]) - total[i] * total[j], n * n))
    values, own_vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitening(n, total, values[order], own_vectors[:, order], float(np.trace(v)))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """((n x - S) as doubles, exact sums of its squares by row)."""
    most = max(abs(n * int(v) - s) for lim in (x.min(axis=0), x.max(axis=0)) for v, s in zip(lim, sums, strict=True))
    if most * most * x.shape[1] < 1 << 62:
        d = n * x - np.array(sums, np.int64)
        return d.astype(np.float64), (d * d).sum(axis=1).tolist()
    d = n * x.astype(object) - np.array(sums, object)
    return d.astype(np.float64), (d * d).sum(axis=1).tolist()


def identity_error(vectors: DataFrame, w: Whitening, id_col: str = "vec_id", vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity; components without variance don't count."""
    weights, n, sums = w.weights, w.n, w.sums
    alive = np.flatnonzero(np.isfinite(weights[0]))

    @tidy
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(alive) + 1, len(alive)))
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                z = deviations(whole(batch.column(0).slice(i, BLOCK_ROWS)), n, sums)[0] / n @ weights[:, alive]
                total[:-1] += z.T @ z
                total[-1] += z.sum(axis=0)
        at, of = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(at.ravel(), pa.int32()), pa.array(of.ravel(), pa.int32()), pa.array(total.ravel())], ["a", "b", "x"])

    if not len(alive):
        return 0.0
    out = np.zeros((len(alive) + 1, len(alive)))
    for r in usable(vectors, id_col, vector).select("v").mapInArrow(products, "a int, b int, x double").groupBy("a", "b").agg(F.sum("x").alias("x")).collect():  # components by components
        out[r.a, r.b] = r.x / n
    return float(np.abs(out[:-1] - out[-1][:, None] * out[-1][None] - np.eye(len(alive))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id_col, n, deviation, whitened, explained, identity_error) of each usable row: arrays have an entry for each component.

    Rows with a null or empty vector, or with an entry that is null or not finite, go. Ids are
    carried as they are, null or repeated; other columns are not read. Where no row is usable
    there are no rows. A component without variance has null in whitened and 0 in explained.
    ``deviation`` is the exact sum over dimensions of (n x - S) squared.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    w = fit(vectors, components, id_col, vector)
    if w is None:
        return vectors.sparkSession.createDataFrame([], schema)
    weights, n, sums, error = w.weights, w.n, w.sums, identity_error(vectors, w, id_col, vector)
    share = [max(0.0, float(e)) / w.trace if w.trace > 0 else 0.0 for e in w.values]

    @tidy
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                d, exact = deviations(whole(part.column(1)), n, sums)
                z = pa.array((d / n @ weights).ravel(), from_pandas=True)  # NaN is null
                ends = pa.array(np.arange(len(d) + 1, dtype=np.int32) * len(share))
                shares = pa.ListArray.from_arrays(ends, pa.array(np.tile(share, len(d))))
                made = [part.column(0), pa.array([n] * len(d), pa.int64()), pa.array([Decimal(x) for x in exact], _SUM), pa.ListArray.from_arrays(ends, z), shares, pa.array([error] * len(d))]
                yield pa.RecordBatch.from_arrays(made, [id_col, "n", "deviation", "whitened", "explained", "identity_error"])

    return usable(vectors, id_col, vector).mapInArrow(project, schema)


def op13_bitsliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"), "identity_error")
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
