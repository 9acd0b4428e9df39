"""Link logs: the text format and the rotated CSV telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.parsing import parse_links, signed64

# Header of the telemetry files
TELEMETRY_COLUMNS = ("Time", "Group", "FromRank", "ToRank", "DevIndex", "Func", "FuncTimes",
                     "SrcIP", "DstIP", "Bandwidth", "SendWrCounter", "RemainWrDataSize",
                     "Timestamp")
TELEMETRY_SCHEMA = ("Time STRING, `Group` STRING, FromRank INT, ToRank INT, DevIndex INT,"
                    " Func INT, FuncTimes BIGINT, SrcIP STRING, DstIP STRING, Bandwidth INT,"
                    " SendWrCounter INT, RemainWrDataSize INT, Timestamp BIGINT")


def read_links(spark: SparkSession, path) -> DataFrame:
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.log")
             .text(path))
    return parse_links(lines)


def read_telemetry(spark: SparkSession, path, glob: str = "*_Port*_[AB].log") -> DataFrame:
    """Telemetry rows once each (files rotate and overlap); group hash as signed 64 bit."""
    raw = (spark.read.schema(TELEMETRY_SCHEMA).option("header", True)
           .option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(path))
    return raw.dropDuplicates().withColumn("group_hash", signed64(F.col("Group")))


def large_transfers(sends: DataFrame, bytes_above: int = 16, size: str = "size") -> DataFrame:
    """Tiny control transfers say nothing about link speed."""
    return sends.where(F.col(size) > bytes_above)
