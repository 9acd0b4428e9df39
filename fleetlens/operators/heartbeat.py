"""Clients that fell silent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.params import AlertLimits
from fleetlens.plans.ordered import OrderedGroups


def silences(beats: DataFrame, limits: AlertLimits = AlertLimits(), row_floor: int | None = None,
             as_of: int | None = None) -> DataFrame:
    """Gaps above the timeout: offline once the timeout has passed, back with the next beat.

    Clients still silent at ``as_of`` (microseconds; the newest beat of any client, if not given)
    have no return.
    """
    if as_of is None:
        as_of = beats.agg(F.max("us")).first()[0] or 0
    beats = beats.where(F.col("us") <= as_of)
    rows = beats.select("client_id", "us").distinct()
    groups = OrderedGroups(rows, ["client_id"], ["us"], halo=1, row_floor=row_floor,
                           sizes_from=beats)
    out = groups.trim(groups.rows().withColumn("last_us", F.lag("us").over(groups.window())))
    gone = beats.groupBy("client_id").agg(F.max("us").alias("last_us"), F.lit(None).cast("bigint").alias("us"))
    out = out.select("client_id", "last_us", "us").unionByName(gone)
    gap = F.coalesce(F.col("us"), F.lit(as_of)) - F.col("last_us")
    return (out.where(gap > limits.heartbeat_timeout_s * 1_000_000)
            .select("client_id", "last_us",
                    (F.col("last_us") + limits.heartbeat_timeout_s * 1_000_000).alias("offline_us"),
                    F.col("us").alias("back_us"), (gap / 1e6).alias("silent_s")))


def connection_events(beats: DataFrame, limits: AlertLimits = AlertLimits(),
                      row_floor: int | None = None) -> DataFrame:
    """First contact and every return (recovered), every silence (offline)."""
    first = beats.groupBy("client_id").agg(F.min("us").alias("us")).select(
        "client_id", "us", F.lit("recovered").alias("event"))
    pair = F.array(F.struct(F.col("offline_us").alias("us"), F.lit("offline").alias("event")),
                   F.struct(F.col("back_us").alias("us"), F.lit("recovered").alias("event")))
    rest = (silences(beats, limits, row_floor).select("client_id", F.explode(pair).alias("_e"))
            .select("client_id", "_e.us", "_e.event").where("us IS NOT NULL"))
    return first.unionByName(rest)
