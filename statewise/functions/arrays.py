"""Small helpers for array columns of a pattern's values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def active_indices(values: Column, least: float) -> Column:
    """Places (from 0) whose value is over `least`, in order."""
    marked = F.transform(values, lambda v, i: F.when(v > least, i))
    return F.filter(marked, lambda i: i.isNotNull())


def active_names(values: Column, names: list[str], least: float) -> Column:
    """Names of the places whose value is over `least`, in order."""
    table = F.array(*map(F.lit, names))
    return F.transform(active_indices(values, least), lambda i: F.get(table, i))


def share_active(values: Column, least: float) -> Column:
    """Share of places whose value is over `least`; null for an empty array."""
    return F.try_divide(F.size(F.filter(values, lambda v: v > least)), F.size(values))
