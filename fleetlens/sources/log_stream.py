"""Call logs as a stream: every file that appears is read once, into calls and a quarantine.

Files are taken when they appear and are expected to be complete (rotated logs); lines appended to a file
later are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetlens.functions.parsing import parse_calls, truncated, unparsed_calls
from fleetlens.sources.logs import LOG_SUFFIX


def follow_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of the log files below a folder, with their file."""
    raw = (spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).text(path))
    return (raw.select(F.translate("value", "�", "").alias("value"), F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_name").alias("_name")).where(F.col("_name").rlike(LOG_SUFFIX)).drop("_name"))


def land(lines: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write calls (with ``cut``: is the hash unreliable?) and refused lines as two tables.

    A micro-batch writes the partition of its number, so one that comes again after a failure replaces what
    it wrote before, and each line is landed exactly once.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            calls = parse_calls(rows.withColumn("cut", truncated(F.col("value"))))
            calls.write.mode("overwrite").parquet(f"{out}/calls/batch={number}")
            unparsed_calls(rows).write.mode("overwrite").parquet(f"{out}/refused/batch={number}")
        finally:
            rows.unpersist()

    return (lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def landed(spark: SparkSession, out: str, table: str = "calls") -> DataFrame:
    """The landed ``calls`` or ``refused`` lines."""
    return spark.read.parquet(f"{out}/{table}").drop("batch")
