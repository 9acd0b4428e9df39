"""Which rank is slow inside its comparison group?

Two detectors: the parallel one compares ranks inside GLOBAL / TP / DP groups per operation number
and group hash; the group-hash one compares ranks inside one communicator per function and
operation number.  Times are epoch nanoseconds, so sums of lags are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import topology as tg
from fleetlens.params import Topology
from fleetlens.plans.durable import cut_lineage
from fleetlens.plans.ordered import OrderedGroups, attach
from fleetlens.plans.quantiles import quantile
from fleetlens.plans.sizes import bounded

GROUP = ["group_type", "gid", "op_count", "group_hash"]


def hashed(calls: DataFrame) -> DataFrame:
    """Calls that belong to a communicator; hash 0 is a valid hash."""
    return calls.where(F.col("group_hash").isNotNull())


def latest_per_rank(calls: DataFrame) -> DataFrame:
    """Latest time per (rank, op_count, hash): the map-side combine before groups fan out."""
    return (hashed(calls).groupBy("rank", "op_count", "group_hash")
            .agg(F.max("ts_ns").alias("ts_ns")))


def comparison_types(t: Topology) -> Column:
    """Array of (group_type, gid) a rank takes part in."""
    r = F.col("rank")

    def kind(name, gid):
        return F.struct(F.lit(name).alias("group_type"), gid.cast("int").alias("gid"))
    return F.array(kind("GLOBAL", F.lit(0)), kind("TP", tg.tp_group(r, t)),
                   kind("DP", tg.dp_group(r, t)))


def comparison_members(calls: DataFrame, t: Topology) -> DataFrame:
    """One row per group and member rank, with its latest time."""
    return (latest_per_rank(calls)
            .select("rank", "op_count", "group_hash", "ts_ns",
                    F.explode(comparison_types(t)).alias("_c"))
            .select(F.col("_c.group_type"), F.col("_c.gid"), "op_count", "group_hash", "rank",
                    "ts_ns"))


def expected_members(calls: DataFrame, t: Topology) -> DataFrame:
    """Ranks seen in the data per (type, gid); a GLOBAL group needs the whole world."""
    seen = calls.select("rank").distinct()
    per = (seen.select("rank", F.explode(comparison_types(t)).alias("_c"))
           .groupBy(F.col("_c.group_type").alias("group_type"), F.col("_c.gid").alias("gid"))
           .agg(F.count(F.lit(1)).alias("expected")))
    return per.where((F.col("group_type") != "GLOBAL") | (F.col("expected") == t.world_size))


def global_hashes(calls: DataFrame, t: Topology) -> DataFrame:
    """Hashes used by every rank of the world."""
    return (hashed(calls).select("group_hash", "rank").distinct().groupBy("group_hash")
            .agg(F.count(F.lit(1)).alias("ranks")).where(F.col("ranks") == t.world_size))


def global_calls(calls: DataFrame, t: Topology) -> DataFrame:
    """Calls on globally present hashes (semi join; the hash list is measured before broadcast)."""
    return calls.join(bounded(global_hashes(calls, t).select("group_hash")), "group_hash",
                      "left_semi")


def complete_groups(calls: DataFrame, t: Topology) -> DataFrame:
    """Groups in which every expected member took part."""
    sizes = (comparison_members(calls, t).groupBy(*GROUP)
             .agg(F.count(F.lit(1)).alias("members")))
    # at most 2 * ranks + 1 rows
    want = bounded(expected_members(calls, t))
    return (sizes.join(want, ["group_type", "gid"])
            .where(F.col("members") == F.col("expected")))


def judged_members(calls: DataFrame, t: Topology) -> DataFrame:
    """Members of complete groups of two or more; ``place`` 1 is the slowest (ties: highest rank).

    A group holds each rank once, so a window partition is at most the world size.
    """
    late = Window.partitionBy(*GROUP).orderBy(F.col("ts_ns").desc(), F.col("rank").desc())
    every = Window.partitionBy(*GROUP)
    want = bounded(expected_members(calls, t))
    return (comparison_members(calls, t)
            .withColumn("place", F.row_number().over(late))
            .withColumn("next_ns", F.lead("ts_ns").over(late))
            .withColumn("members", F.count(F.lit(1)).over(every))
            .join(want, ["group_type", "gid"])
            .where((F.col("members") == F.col("expected")) & (F.col("members") > 1))
            .drop("expected"))


def slow_picks(calls: DataFrame, t: Topology) -> DataFrame:
    """Slowest rank and its lag per comparison group."""
    return (judged_members(calls, t).where(F.col("place") == 1)
            .select(*GROUP, F.col("rank").alias("slowest_rank"), "members",
                    (F.greatest(F.col("ts_ns") - F.col("next_ns"), F.lit(0)) / 1e9)
                    .alias("lag_s")))


def member_stats(calls: DataFrame, t: Topology) -> DataFrame:
    """Participations, picks and lag per (type, group id, rank); GLOBAL ids are the hashes."""
    pick = F.col("place") == 1
    gid = F.when(F.col("group_type") == "GLOBAL", F.col("group_hash")).otherwise(F.col("gid"))
    return (judged_members(calls, t)
            .groupBy("group_type", gid.cast("bigint").alias("group_id"), "rank")
            .agg(F.count(F.lit(1)).alias("participations"),
                 F.sum(pick.cast("bigint")).alias("picks"),
                 F.sum(F.when(pick, F.greatest(F.col("ts_ns") - F.col("next_ns"), F.lit(0)))
                       .otherwise(0)).alias("lag_ns")))


def normalised_picks(calls: DataFrame, t: Topology, compat: bool = False) -> DataFrame:
    """Picks minus the smallest count of the group, summed per rank and type.

    ``compat`` takes the smallest count among ranks that were picked at all, which hides a rank
    that is alone in being slow; the default includes participants that were never picked.
    """
    stats = member_stats(calls, t)
    if compat:
        stats = stats.where(F.col("picks") > 0)
    group = Window.partitionBy("group_type", "group_id")
    return (stats.withColumn("_net", F.col("picks") - F.min("picks").over(group))
            .groupBy("rank", "group_type")
            .agg(F.sum("_net").alias("normalised"), F.sum("picks").alias("picks")))


def pick_rates(calls: DataFrame, t: Topology) -> DataFrame:
    """Raw picks, participations, rate in percent and cumulative lag per rank and type."""
    return (member_stats(calls, t).groupBy("rank", "group_type")
            .agg(F.sum("picks").alias("picks"), F.sum("participations").alias("participations"),
                 F.sum("lag_ns").alias("_lag"))
            .select("rank", "group_type", "picks", "participations",
                    F.when(F.col("participations") > 0,
                           100.0 * F.col("picks") / F.col("participations")).otherwise(0.0)
                    .alias("rate_pct"), (F.col("_lag") / 1e9).alias("lag_s")))


def comparison_totals(calls: DataFrame, t: Topology) -> DataFrame:
    """Groups formed and groups judged per type."""
    formed = (comparison_members(calls, t).groupBy(*GROUP)
              .agg(F.count(F.lit(1)).alias("members")))
    want = bounded(expected_members(calls, t))
    ok = (F.col("members") == F.col("expected")) & (F.col("members") > 1)
    return (formed.join(want, ["group_type", "gid"], "left").groupBy("group_type")
            .agg(F.count(F.lit(1)).alias("groups_formed"),
                 F.sum(F.coalesce(ok.cast("bigint"), F.lit(0))).alias("groups_judged"),
                 F.max("members").alias("largest_group")))


# ---- group hash detector ------------------------------------------------------------------

HASH_GROUP = ["group_hash", "function", "op_count"]


def hash_groups(calls: DataFrame) -> DataFrame:
    """Slowest entry per (hash, function, op_count) with two or more entries (ties: lowest rank).

    One aggregation with map-side combine; no group is ever materialised.
    """
    return (hashed(calls).groupBy(*HASH_GROUP)
            .agg(F.count(F.lit(1)).alias("entries"),
                 F.max(F.struct("ts_ns", (-F.col("rank")).alias("_r"))).alias("_top"))
            .where(F.col("entries") >= 2)
            .select(*HASH_GROUP, "entries", (-F.col("_top._r")).alias("slowest_rank"),
                    F.col("_top.ts_ns").alias("slowest_ns")))


def hash_slow_counts(calls: DataFrame) -> DataFrame:
    return (hash_groups(calls).groupBy("group_hash", F.col("slowest_rank").alias("rank"))
            .agg(F.count(F.lit(1)).alias("slow_count")))


def group_numbers(calls: DataFrame) -> DataFrame:
    """Display numbers 1..n by hash text.

    Communicators are numbered among those whose text begins alike, then follow all that begin with
    less.  Hashes are numbers, so their first four characters take some 12 000 values at most,
    however many communicators there are: only these reach one task.
    """
    text = F.col("group_hash").cast("string")
    each = hashed(calls).select("group_hash").distinct().withColumn("_head", F.substring(text, 1, 4))
    earlier = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    heads = each.groupBy("_head").agg(F.count(F.lit(1)).alias("_n")).select(
        "_head", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_head").orderBy(text))
    return (each.withColumn("_at", place).join(heads, "_head")
            .select("group_hash", (F.col("_before") + F.col("_at")).cast("int").alias("group_id")))


def memberships(calls: DataFrame) -> DataFrame:
    """``group_hash, rank, slow_count, compared``: a row per member of a communicator, from one scan.

    Calls are first combined per rank and operation, so a group of an operation has a row per rank; there the
    latest (ties: lowest rank) is marked if the operation has two or more entries.
    """
    each = hashed(calls).groupBy(*HASH_GROUP, "rank").agg(F.count(F.lit(1)).alias("_n"), F.max("ts_ns").alias("_ts"))
    group = Window.partitionBy(*HASH_GROUP)
    judged = F.sum("_n").over(group) >= 2
    last = F.row_number().over(group.orderBy(F.desc("_ts"), "rank")) == 1
    return (each.select("group_hash", "rank", judged.alias("_judged"), last.alias("_last"))
            .groupBy("group_hash", "rank").agg(F.count_if(F.col("_judged") & F.col("_last")).alias("slow_count"),
                                               F.bool_or("_judged").alias("compared")))


def slow_matrix(calls: DataFrame) -> DataFrame:
    """Normalised slow count per participating rank and group (long form, non-participants absent)."""
    members = cut_lineage(memberships(calls))  # a row per member, read three times
    compared = members.where("compared").select("rank").distinct()
    lowest = F.min("slow_count").over(Window.partitionBy("group_hash"))
    return (members.withColumn("normalised", F.col("slow_count") - lowest)
            .join(compared, "rank", "left_semi").join(group_numbers(members), "group_hash")
            .select("rank", "group_hash", "group_id", "slow_count", "normalised"))


def slow_matrix_maps(calls: DataFrame) -> DataFrame:
    """A row per rank with a map from group number to normalised slow count, for any number of communicators."""
    entry = F.struct("group_id", "normalised")
    return slow_matrix(calls).groupBy("rank").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("groups"))


def slow_matrix_wide(calls: DataFrame) -> DataFrame:
    """Rank x group matrix with a column for every group; a cell is null where the rank is no member
    of the group.  Group numbers are consecutive, so their maximum names the columns; for thousands of
    communicators take ``slow_matrix`` or ``slow_matrix_maps``."""
    long = slow_matrix(calls)
    groups = long.agg(F.max("group_id")).first()[0] or 0
    wide = (long.groupBy("rank").pivot("group_id", list(range(1, groups + 1)))
            .agg(F.first("normalised")))
    return wide.select("rank", *[F.col(str(i)).alias(f"g{i}") for i in range(1, groups + 1)])


def hash_rank_totals(calls: DataFrame, compat: bool = False, row_floor: int | None = None
                     ) -> DataFrame:
    """Slow picks, participations, rate and cumulative lead over the median, per rank.

    ``compat`` multiplies each group's count by the number of its compared entries.
    """
    base = calls.agg(F.min("ts_ns")).scalar()
    entries = hashed(calls).select(*HASH_GROUP, "rank", (F.col("ts_ns") - base).alias("ts_ns"))
    pairs = (entries.groupBy(*HASH_GROUP, "rank").agg(F.count(F.lit(1)).alias("_n")))
    sized = hash_groups(entries)
    hot = OrderedGroups(entries, HASH_GROUP, ["ts_ns"], row_floor=row_floor)
    parts = (attach(pairs, sized.select(*HASH_GROUP, "entries"), HASH_GROUP)
             .groupBy("rank").agg(F.count(F.lit(1)).alias("participations")))
    middle = (hot.numbered().groupBy(*HASH_GROUP)
              .agg(quantile("ts_ns", 0.5).alias("_median")))
    lead = (sized.join(middle, HASH_GROUP)
            .groupBy(F.col("slowest_rank").alias("rank"))
            .agg(F.count(F.lit(1)).alias("slow_count"),
                 (F.sum(F.col("slowest_ns") - F.col("_median")) / 1e9).alias("slow_time_s")))
    if compat:
        per_hash = sized.groupBy("group_hash").agg(F.count(F.lit(1)).alias("_entries"))
        swollen = (sized.groupBy("group_hash", F.col("slowest_rank").alias("rank"))
                   .agg(F.count(F.lit(1)).alias("_c")).join(per_hash, "group_hash")
                   .groupBy("rank").agg(F.sum(F.col("_c") * F.col("_entries")).alias("_swollen")))
        lead = lead.join(swollen, "rank").withColumn("slow_count", F.col("_swollen")).drop("_swollen")
    out = parts.join(lead, "rank", "left")
    slow = F.coalesce("slow_count", F.lit(0))
    return out.select("rank", slow.alias("slow_count"), "participations",
                      (100.0 * slow / F.col("participations")).alias("rate_pct"),
                      F.coalesce("slow_time_s", F.lit(0.0)).alias("slow_time_s"))


def top_slow_ranks(calls: DataFrame, k: int = 3) -> DataFrame:
    return (hash_slow_counts(calls).groupBy("rank").agg(F.sum("slow_count").alias("slow_count"))
            .where("slow_count > 0").orderBy(F.col("slow_count").desc(), "rank").limit(k))


def slowest_ranks(calls: DataFrame) -> DataFrame:
    """All ranks tied at the largest number of picks."""
    totals = hash_slow_counts(calls).groupBy("rank").agg(F.sum("slow_count").alias("slow_count"))
    return totals.where(F.col("slow_count") == totals.agg(F.max("slow_count")).scalar())


def group_breakdown(calls: DataFrame) -> DataFrame:
    """Functions and payload sizes seen per communicator, with call counts."""
    return (hashed(calls).groupBy("group_hash", "function", "data_size")
            .agg(F.count(F.lit(1)).alias("calls"), F.min("rank").alias("first_rank")))


def set_sizes(calls: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct operation numbers and ranks per hash; ``approx`` for a sketch instead."""
    if approx:
        return calls.groupBy("group_hash").agg(
            F.approx_count_distinct("op_count").alias("op_counts"),
            F.approx_count_distinct("rank").alias("ranks"))
    seen = calls.select("group_hash", F.explode(F.array(
        F.struct(F.lit(True).alias("op"), F.col("op_count").cast("long").alias("x")),
        F.struct(F.lit(False).alias("op"), F.col("rank").cast("long").alias("x")))).alias("v"))
    # deduplicated values, so the second step only counts; a null hash is a group too
    return (seen.select("group_hash", "v.*").where("x IS NOT NULL").distinct().groupBy("group_hash")
            .agg(F.count_if("op").alias("op_counts"), F.count_if(~F.col("op")).alias("ranks")))
