"""Column helpers with explicit treatment of missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def holds(condition: Column) -> Column:
    """The condition, with unknown as false: comparisons with missing values do not hold."""
    return F.coalesce(condition, F.lit(False))


def at_least(c: Column, floor: float) -> Column:
    """The larger of both; a missing value stays missing."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(float(floor))))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))
