"""Functions from columns to columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(value) -> Column:
    """A column by name, or the column itself."""
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
