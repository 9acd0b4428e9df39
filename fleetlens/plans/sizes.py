"""Broadcast only what has been measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``max_rows`` rows, else leave the choice to AQE."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
