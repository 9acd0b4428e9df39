"""Call logs as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.parsing import parse_calls, rank_of_file

LOG_SUFFIX = r"(?i)\.(log|txt|out|err)(\.gz|\.bz2)?$"


def discover_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of all log files below the paths; gzip and bzip2 files are read through.

    Undecodable bytes are dropped.  Columns: value, file.
    """
    raw = spark.read.option("recursiveFileLookup", True).text(paths)
    return (raw.select(F.translate("value", "�", "").alias("value"),
                       F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_name").alias("_name"))
            .where(F.col("_name").rlike(LOG_SUFFIX)).drop("_name"))


def file_name(path):
    return F.element_at(F.split(path, "/"), -1)


def read_calls(spark: SparkSession, paths: str | Sequence[str], rank_from: str = "line"
               ) -> DataFrame:
    """Typed calls of all log files.  ``rank_from='file'`` takes the rank from the file name and
    drops files without one."""
    calls = parse_calls(discover_lines(spark, paths))
    if rank_from == "file":
        calls = (calls.withColumn("rank", rank_of_file(file_name(F.col("file"))))
                 .where(F.col("rank") >= 0))
    return calls


def file_checks(lines: DataFrame, world_size: int, path: str = "file") -> DataFrame:
    """Is there one file per rank, and any file at all?"""
    files = lines.select(path).distinct().agg(F.count(F.lit(1)).alias("files"))
    return files.select("files", F.lit(world_size).alias("world_size"),
                        (F.col("files") == world_size).alias("one_per_rank"),
                        (F.col("files") > 0).alias("any_file"))


def land_calls(calls: DataFrame, path: str) -> None:
    """Land parsed calls as parquet so that later jobs prune columns and push filters down."""
    calls.write.mode("errorifexists").partitionBy("save_count").parquet(path)
