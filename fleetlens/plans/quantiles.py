"""Exact order statistics without a per-group buffer.

Rows are numbered in sorted order (``OrderedGroups.numbered``: spills, and cuts hot groups), then an
ordinary aggregation picks the wanted positions.  Spark's ``percentile`` would keep every distinct
value of a group in one task's memory instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.ordered import OrderedGroups


PLACES = 1 << 20


def spread(value: Column, *ties: str) -> Column:
    """An order for whole-numbered ``value`` that also sets equal values apart, by a hash of ``ties``.

    A hot key whose values are all alike can then be cut too.  Different values never change places;
    above 2**33 the double keeps fewer places per value, so sort by the value after it.
    """
    return value.cast("double") * PLACES + F.pmod(F.xxhash64(*ties), F.lit(PLACES))


def ranked(df: DataFrame, keys: Sequence[str], value: str, row_floor: int | None = None,
           like: OrderedGroups | None = None) -> DataFrame:
    """``df`` plus ``_pos`` (0-based, ascending by value) and ``_n`` per key."""
    return OrderedGroups(df, keys, [value], row_floor=row_floor, like=like).numbered()


def at_index(value: str, index: Callable[[Column], Column]) -> Column:
    """Aggregate: the value at a 0-based position computed from the group size."""
    return F.max(F.when(F.col("_pos") == index(F.col("_n")), F.col(value)))


def quantile(value: str, p: float) -> Column:
    """Aggregate: linear-interpolated quantile (the usual definition of numeric packages)."""
    spot = (F.col("_n") - 1) * F.lit(float(p))
    low = F.max(F.when(F.col("_pos") == F.floor(spot), F.col(value)))
    high = F.max(F.when(F.col("_pos") == F.ceil(spot), F.col(value)))
    return low + (high - low) * F.max(spot - F.floor(spot))
