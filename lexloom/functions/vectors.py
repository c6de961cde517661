"""Vectors as arrays: norms, scaling, squared distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import col

#: Norms are taken to be at least this, so that a zero vector stays zero.
LEAST_NORM = 1e-12


def norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def normalize(v) -> Column:
    """To unit length, in double precision; a zero vector stays zero."""
    scale = F.greatest(norm(v), F.lit(LEAST_NORM))
    return F.get(F.transform(F.array(scale), lambda s: F.transform(col(v), lambda x: x.cast("double") / s)), F.lit(0))


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
