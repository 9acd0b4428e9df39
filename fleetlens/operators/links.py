"""Link speed: transfer rates per flow, sliding bandwidth and compaction of send telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.calls import arrow, link_function
from fleetlens.plans.ordered import OrderedGroups

FLOW = ["grp", "func_name", "func_times", "channel", "flow", "ip_flow"]
DEVICE = ["nic", "dev"]
WINDOW_SENDS = 50
GBIT_FACTOR = 0.93 * 8


def with_flows(transfers: DataFrame) -> DataFrame:
    """Function name and the two flow keys."""
    return (transfers.withColumn("func_name", link_function(F.col("func")))
            .withColumn("flow", arrow(F.col("from_rank"), F.col("to_rank")))
            .withColumn("ip_flow", arrow(F.col("src_ip"), F.col("dst_ip"))))


def flow_rates(transfers: DataFrame) -> DataFrame:
    """Gb/s per flow: total bits over total nanoseconds, 0 when no time passed."""
    return (with_flows(transfers).groupBy(*FLOW)
            .agg(F.sum("bytes_sent").alias("bytes"), F.sum("nsec").alias("nsec"),
                 F.count(F.lit(1)).alias("sends"))
            .withColumn("rate_gbps", F.when(F.col("nsec") > 0, F.col("bytes") * 8 / F.col("nsec"))
                        .otherwise(0.0)))


def _lowest():
    return F.min(F.struct(F.round("rate_gbps", 9).alias("rate"), *FLOW))


def group_rates(transfers: DataFrame) -> DataFrame:
    """Average (over flows) and lowest rate per group; row ``-1`` is the whole network."""
    rates = flow_rates(transfers)
    per = (rates.groupBy("grp").agg(F.sum("rate_gbps").alias("_sum"),
                                    F.count(F.lit(1)).alias("flows"), _lowest().alias("_low")))
    # one row per group feeds the network row
    network = per.agg(F.sum("_sum").alias("_sum"), F.sum("flows").alias("flows"),
                      F.min("_low").alias("_low")).select(F.lit(-1).cast("bigint").alias("grp"),
                                                          "_sum", "flows", "_low")
    return per.unionByName(network).select(
        "grp", "flows", (F.col("_sum") / F.col("flows")).alias("avg_gbps"),
        F.col("_low.rate").alias("lowest_gbps"), F.col("_low.flow").alias("lowest_flow"),
        F.col("_low.ip_flow").alias("lowest_ip_flow"))


def flow_details(transfers: DataFrame) -> DataFrame:
    return flow_rates(transfers).select(
        *FLOW, (F.col("bytes") / F.col("sends")).alias("avg_bytes"),
        (F.col("nsec") / F.col("sends")).alias("avg_nsec"),
        F.col("rate_gbps").alias("avg_gbps"))


def slowest_flows(transfers: DataFrame, k: int = 1) -> DataFrame:
    """The k slowest flows of each group; ``place <= k`` cuts before the shuffle."""
    slow = Window.partitionBy("grp").orderBy(F.round("rate_gbps", 9), *FLOW[1:])
    return (flow_rates(transfers).withColumn("place", F.row_number().over(slow))
            .where(F.col("place") <= k))


def sliding_bandwidth(sends: DataFrame, window: int = WINDOW_SENDS, row_floor: int | None = None
                      ) -> DataFrame:
    """Gb/s over the last ``window`` sends of a device, emitted once the window is full.

    A change of ``func_times`` empties the window: no change may lie inside the frame.
    """
    groups = OrderedGroups(sends, DEVICE, ["rn"], halo=window, row_floor=row_floor)
    w = groups.window()
    frame = w.rowsBetween(-(window - 1), 0)
    rows = groups.rows().withColumn(
        "_cut", (F.col("func_times") != F.lag("func_times").over(w)).cast("int"))
    rows = rows.withColumns({
        "_full": F.count(F.lit(1)).over(frame),
        "_cuts_in": F.coalesce(F.max("_cut").over(w.rowsBetween(-(window - 2), 0)), F.lit(0)),
        "_bytes": F.sum("size").over(frame), "_first": F.first("size").over(frame),
        "_since": F.first("t_ns").over(frame)})
    rows = groups.trim(rows).where((F.col("_full") == window) & (F.col("_cuts_in") == 0) &
                                   (F.col("t_ns") > F.col("_since")))
    rate = (F.col("_bytes") - F.col("_first")) * GBIT_FACTOR / (F.col("t_ns") - F.col("_since"))
    return rows.select(*DEVICE, "rn", "func_times", F.floor(rate).cast("bigint").alias("gbps"))


def compact_sends(sends: DataFrame, row_floor: int | None = None) -> DataFrame:
    """Neighbouring sends of one device with equal ``func_times`` merged into one."""
    groups = OrderedGroups(sends, DEVICE, ["rn"], halo=1, row_floor=row_floor)
    before = F.lag("func_times").over(groups.window())
    rows = groups.rows().withColumn(
        "_new", (before.isNull() | (before != F.col("func_times"))).cast("bigint"))
    rows = groups.trim(rows, keep_piece=True)
    rows = groups.finish(groups.running(rows, F.col("_new"), "run", "sum"))
    return (rows.groupBy(*DEVICE, "run", "func_times")
            .agg(F.sum("size").alias("size"), F.max("t_ns").alias("t_ns"),
                 F.count(F.lit(1)).alias("sends")))
