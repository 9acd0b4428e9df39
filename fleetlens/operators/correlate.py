"""As-of joins: every row with the newest row of another table at or before its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.calls import lookup
from fleetlens.params import SLOW_SECONDS, SLOW_SECONDS_DEFAULT
from fleetlens.plans.ordered import OrderedGroups


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str],
          row_floor: int | None = None) -> DataFrame:
    """``left`` with ``values`` and ``as_of_<time>`` of its newest match; null where nothing came before.

    Both tables go through one sort by key and time, in which the newest right row is carried along, so no row
    is made per pair, and a key with a large share of the rows is cut into pieces.  Right rows of equal time
    count as one, with the largest values.  Rows without time match nothing.
    """
    keys, values = list(keys), list(values)
    mine = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    theirs = right.where(F.col(time).isNotNull()).select(
        *keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(time).alias("_t"), *values).alias("_found"))
    both = mine.where("_t IS NOT NULL").unionByName(theirs, allowMissingColumns=True)
    groups = OrderedGroups(both, keys, ["_t", "_side"], row_floor=row_floor)
    rows = groups.finish(groups.running(groups.trim(groups.rows(), keep_piece=True), F.col("_found"), "_last"))
    out = rows.where("_side = 1").select("_row", "_last").unionByName(
        mine.where("_t IS NULL").select("_row"), allowMissingColumns=True)
    return out.select("_row.*", F.col("_last._t").alias(f"as_of_{time}"), *[F.col(f"_last.{v}").alias(v) for v in values])


def slow_calls(calls: DataFrame, row_floor: int | None = None) -> DataFrame:
    """Calls that came later after the one before on their stream than their function may take."""
    groups = OrderedGroups(calls, ["rank", "stream"], ["ts_ns", "event_id"], halo=1, row_floor=row_floor)
    rows = groups.trim(groups.rows().withColumn("_before", F.lag("ts_ns").over(groups.window())))
    limit = F.coalesce(lookup(SLOW_SECONDS, F.col("function")), F.lit(SLOW_SECONDS_DEFAULT))
    return rows.withColumn("gap_s", (F.col("ts_ns") - F.col("_before")) / 1e9).drop("_before").where(F.col("gap_s") > limit)


def link_before_slow_calls(calls: DataFrame, links: DataFrame, row_floor: int | None = None) -> DataFrame:
    """Slow calls with the rate of their rank's link just before: was the network slow, or the rank?

    ``links`` has rank, ts_ns and rate_gbps.
    """
    slow = slow_calls(calls, row_floor).select("rank", "stream", "function", "op_count", "event_id", "ts_ns", "gap_s")
    return as_of(slow, links, ["rank"], "ts_ns", ["rate_gbps"], row_floor)
