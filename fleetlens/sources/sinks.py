"""Report writers.  All write from the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Rank x group matrix as CSV with a header; ranks stay in order across part files."""
    matrix.repartitionByRange("rank").sortWithinPartitions("rank").write.csv(path, header=True)


def write_topology(ranks: DataFrame, path: str) -> None:
    ranks.write.json(path)


def append_outbox(notifications: DataFrame, path: str) -> None:
    """Append to the notification outbox; delivery is done elsewhere."""
    notifications.write.mode("append").partitionBy("channel").parquet(path)


def payload(df: DataFrame) -> DataFrame:
    """Each row as one JSON payload."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("payload"))
