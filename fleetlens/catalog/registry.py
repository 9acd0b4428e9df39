"""Registered queries: a Spark callable each, and SQL with the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; the nudge settles exact halves the same way everywhere."""
    return df.select(*[F.round(F.col(c) + 1e-9, digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def add(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise KeyError(name)

    def run(spark: SparkSession, sf: str) -> DataFrame:
        # times without a zone are UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return rounded(query(spark, sf))
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = "WITH " + sql.strip()
