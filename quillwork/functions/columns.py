"""Small column helpers shared by the plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flat(c: Column, digits: int) -> Column:
    """Rounded half up by ``floor``, which engines agree on where ``round`` differs at ties."""
    s = float(10**digits)
    return F.floor(c * s + 0.5) / s


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b`` as double, NULL where ``b`` is 0 or NULL."""
    return F.when(b != 0, a.cast("double") / b)


def first_filled(*cols: Column) -> Column:
    """The first text that is not NULL and not empty after trimming."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in cols))


def n_if(cond: Column) -> Column:
    """Number of rows where ``cond`` holds."""
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def sorted_set(c: Column, sep: str = "|") -> Column:
    """Aggregate: distinct non-NULL values in order, joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), sep)
