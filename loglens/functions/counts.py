"""Byte counts as 64-bit numbers: sums and differences that never fail and never wrap.

A sum beyond 64 bits (9.2 exabytes) stays at the largest number instead of ending the job.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG = 9223372036854775807


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def byte_sum(col) -> Column:
    """Sum of non-negative counts; NULL only without any."""
    c = _c(col)
    return F.when(F.count(c) > 0, F.coalesce(F.try_sum(c), F.lit(MAX_LONG)))


def add_bytes(a, b) -> Column:
    """``a + b`` of non-negative counts; NULL if one is."""
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_add(a, b), F.lit(MAX_LONG)))


def byte_difference(a, b) -> Column:
    """``abs(a - b)``; NULL if one is."""
    a, b = _c(a), _c(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(F.try_subtract(F.greatest(a, b), F.least(a, b)), F.lit(MAX_LONG)))
