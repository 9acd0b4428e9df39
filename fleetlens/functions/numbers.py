"""Exact integer arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a, b) -> Column:
    """Integer quotient of non-negative values; large values keep every digit."""
    a = a if isinstance(a, Column) else F.lit(a)
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))
