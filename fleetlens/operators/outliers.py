"""Outlier tests on groups keyed by stream pointer: Grubbs for small groups, else index quartiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import topology as tg
from fleetlens.functions.calls import lookup
from fleetlens.functions.numbers import div
from fleetlens.params import GRUBBS_CRITICAL, Topology
from fleetlens.plans.ordered import OrderedGroups, attach
from fleetlens.plans.quantiles import at_index

GROUP = ["group_type", "gid", "op_count", "stream"]


def stream_groups(calls: DataFrame, t: Topology) -> DataFrame:
    """Every call once per TP, PP and DP group of its rank (no per-rank dedupe)."""
    r = F.col("rank")

    def kind(name, gid):
        return F.struct(F.lit(name).alias("group_type"), gid.cast("int").alias("gid"))
    kinds = F.array(kind("TP", tg.tp_group(r, t)), kind("PP", tg.pp_stage(r, t)),
                    kind("DP", tg.dp_group(r, t)))
    return (calls.select("op_count", "stream", "rank", "ts_ns", F.explode(kinds).alias("_c"))
            .select("_c.group_type", "_c.gid", "op_count", "stream", "rank", "ts_ns"))


def stream_group_sizes(calls: DataFrame, t: Topology) -> DataFrame:
    """Groups by type and size class."""
    sizes = stream_groups(calls, t).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))
    band = (F.when(F.col("n") == 1, "single").when(F.col("n") < 4, "tiny")
            .when(F.col("n") <= 30, "grubbs").otherwise("large"))
    return sizes.groupBy("group_type", band.alias("size_class")).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("members"))


def _fence(q1: Column, q3: Column) -> Column:
    return q3 + 1.5 * (q3 - q1)


def _summary(calls: DataFrame, t: Topology, row_floor: int | None) -> DataFrame:
    """Statistics per group, and how many of its calls lie above its quartile fence.

    Rows of a group are sorted once; the quartiles are values at positions, so a window over the same sorted
    rows carries the fence to each of them.  Only rows of groups that were cut into pieces meet their
    fence by a second look.
    """
    base = calls.agg(F.min("ts_ns")).scalar()
    rows = (stream_groups(calls, t)
            .withColumn("_x", (F.col("ts_ns") - base) / 1e9))
    groups = OrderedGroups(rows, GROUP, ["ts_ns"], row_floor=row_floor)
    slow = F.max(F.struct("ts_ns", (-F.col("rank")).alias("_r")))
    numbered = groups.numbered()
    x = F.round("_x", 9)
    above = []
    if not groups.split:
        whole = Window.partitionBy(*GROUP)
        q1, q3 = (at_index("_x", at).over(whole) for at in (lambda n: div(n, 4), lambda n: div(3 * n, 4)))
        numbered = numbered.withColumn("_fence", F.round(_fence(q1, q3), 9))
        above = [F.count_if(x > F.col("_fence")).alias("_above")]
    stats = (numbered.groupBy(*GROUP).agg(
        F.max("_n").alias("n"), F.avg("_x").alias("mean_s"), F.stddev_samp("_x").alias("std_s"),
        F.max("_x").alias("max_s"), slow.alias("_slow"),
        at_index("_x", lambda n: div(n, 4)).alias("q1_s"),
        at_index("_x", lambda n: div(3 * n, 4)).alias("q3_s"), *above)
        .where(F.col("n") >= 2)
        .withColumn("slowest_rank", -F.col("_slow._r")).drop("_slow"))
    if not groups.split:
        return stats
    fences = stats.withColumn("_fence", F.round(_fence(F.col("q1_s"), F.col("q3_s")), 9))
    needs = fences.where((F.col("n") >= 4) & (F.round("max_s", 9) > F.col("_fence")))
    counts = (attach(rows.select(*GROUP, "_x"), needs.select(*GROUP, "_fence"), GROUP, groups.hot_keys)
              .where(x > F.col("_fence")).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_above")))
    return stats.join(counts, GROUP, "left").fillna(0, ["_above"])


def _g() -> Column:
    return (F.col("max_s") - F.col("mean_s")) / F.col("std_s")


def _grubbs_hit() -> Column:
    return F.coalesce((F.col("n").between(4, 30)) & (F.round(F.col("std_s"), 9) > 0) &
                      (F.round(_g(), 9) > F.col("critical")), F.lit(False))


def grubbs(calls: DataFrame, t: Topology, row_floor: int | None = None) -> DataFrame:
    """Maximum-residual test for groups of 4 to 30 members."""
    stats = _summary(calls, t, row_floor)
    crit = lookup(GRUBBS_CRITICAL, F.col("n").cast("int"))
    return (stats.where(F.col("n").between(4, 30)).withColumn("critical", crit)
            .where(F.round("std_s", 9) > 0)
            .select(*GROUP, "n", "slowest_rank", _g().alias("g"), "critical",
                    _grubbs_hit().alias("is_outlier")))


def judged_groups(calls: DataFrame, t: Topology, row_floor: int | None = None) -> DataFrame:
    """Verdict per group: below 4 members only the slowest; else Grubbs, then quartiles.

    Groups of 4 or more without an outlier are dropped, as they were not slow.
    """
    crit = lookup(GRUBBS_CRITICAL, F.col("n").cast("int"))
    fence = _fence(F.col("q1_s"), F.col("q3_s"))
    judged = _summary(calls, t, row_floor).withColumn("critical", crit).withColumn("_grubbs", _grubbs_hit())
    method = (F.when(F.col("n") < 4, "max").when(F.col("_grubbs"), "grubbs").otherwise("iqr"))
    return (judged.where((F.col("n") < 4) | F.col("_grubbs") | (F.col("_above") > 0))
            .select(*GROUP, "n", method.alias("method"), "slowest_rank",
                    (F.col("n") >= 4).alias("is_outlier"),
                    F.when(F.col("n") < 4, 0).when(F.col("_grubbs"), 1)
                    .otherwise(F.col("_above")).cast("bigint").alias("outliers"),
                    F.when(F.col("n") < 4, 0.0).when(
                        F.col("_grubbs"), F.col("mean_s") + F.col("critical") * F.col("std_s"))
                    .otherwise(fence).alias("threshold_s")))


TYPES = ("TP", "PP", "DP")


def _wide(scores: DataFrame) -> DataFrame:
    wide = scores.groupBy("rank").pivot("group_type", list(TYPES)).agg(F.sum("score"))
    return wide.select("rank", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in TYPES])


def _scores(calls: DataFrame, t: Topology, row_floor: int | None) -> DataFrame:
    return (judged_groups(calls, t, row_floor).where("is_outlier")
            .groupBy(F.col("slowest_rank").alias("rank"), "group_type")
            .agg(F.count(F.lit(1)).alias("score")))


def slow_scores(calls: DataFrame, t: Topology, row_floor: int | None = None) -> DataFrame:
    """Groups per type whose outlier the rank is."""
    return _wide(_scores(calls, t, row_floor))


def normalised_scores(calls: DataFrame, t: Topology, compat: bool = False,
                      row_floor: int | None = None) -> DataFrame:
    """Scores minus the smallest per type, over all ranks seen (``compat``: over scoring ranks)."""
    names = [c.lower() for c in TYPES]
    scores = _wide(_scores(calls, t, row_floor))
    if not compat:
        everyone = calls.select("rank").distinct()
        scores = everyone.join(scores, "rank", "left").fillna(0, names)
    # one row per rank and type
    long = scores.unpivot("rank", names, "group_type", "score")
    low = F.min("score").over(Window.partitionBy("group_type"))
    net = long.withColumn("score", F.col("score") - low)
    return net.groupBy("rank").pivot("group_type", names).agg(F.sum("score"))
