"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and measurements; clusters bring their own."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("fleetlens")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(partitions)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
