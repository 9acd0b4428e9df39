"""Call pace and call intervals: per-rank scores, patterns, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.calls import lookup, slow_limit
from fleetlens.operators.hang import last_batch
from fleetlens.plans.ordered import OrderedGroups, attach
from fleetlens.plans.quantiles import quantile, spread

SERIES = ["function", "rank", "stream"]


def _by_time(calls: DataFrame, keys: list[str], row_floor: int | None) -> OrderedGroups:
    order = [c for c in ("ts_ns", "op_count", "event_id") if c in calls.columns]
    return OrderedGroups(calls, keys, order, halo=1, row_floor=row_floor)


def intervals(calls: DataFrame, keys: list[str], row_floor: int | None = None) -> DataFrame:
    """Seconds since the previous call of the same key (null for its first call)."""
    return _gaps(_by_time(calls, keys, row_floor))


def _gaps(groups: OrderedGroups) -> DataFrame:
    out = groups.rows().withColumn(
        "gap_s", (F.col("ts_ns") - F.lag("ts_ns").over(groups.window())) / 1e9)
    return groups.trim(out)


def gaps_by_length(gaps: DataFrame, keys: list[str], like: OrderedGroups,
                   row_floor: int | None = None, sizes_from: DataFrame | None = None) -> OrderedGroups:
    """Gaps per key, shortest first.  A regular stream has equal gaps, so where a key is hot they are
    set apart by their calls; the order among equal gaps changes no quantile."""
    order = ["gap_s"]
    if like.split:
        ties = [c for c in ("ts_ns", "op_count", "event_id", "rank", "stream") if c in gaps.columns]
        gaps = gaps.withColumn("_order", spread(F.rint(F.col("gap_s") * 1e9), *ties))
        order = ["_order", "gap_s"]
    return OrderedGroups(gaps, keys, order, row_floor=row_floor, sizes_from=sizes_from, like=like)


# ---- per-rank pace ------------------------------------------------------------------------

def rank_pace(calls: DataFrame, row_floor: int | None = None) -> DataFrame:
    """Pace metrics of each rank on its last batch; score = 70 % frequency + 30 % consistency."""
    batch = last_batch(calls)
    calls_of = _by_time(batch, ["rank"], row_floor)
    gaps = _gaps(calls_of)
    span = batch.groupBy("rank").agg(
        F.count(F.lit(1)).alias("total_calls"),
        ((F.max("ts_ns") - F.min("ts_ns")) / 1e9).alias("duration_s"))
    stats = (gaps_by_length(gaps.where(F.col("gap_s").isNotNull()), ["rank"], calls_of, row_floor)
             .numbered().groupBy("rank").agg(F.avg("gap_s").alias("mean_s"),
                                  F.stddev_pop("gap_s").alias("std_s"),
                                  F.max("gap_s").alias("max_s"),
                                  quantile("gap_s", 0.95).alias("p95_s")))
    out = span.join(stats, "rank", "left").fillna(0.0, ["mean_s", "std_s", "max_s", "p95_s"])
    cps = F.when(F.col("duration_s") > 0, F.col("total_calls") / F.col("duration_s")).otherwise(0.0)
    cv = F.when(F.col("mean_s") > 0, F.col("std_s") / F.col("mean_s")).otherwise(0.0)
    steady = F.when(F.col("mean_s") > 0, F.greatest(F.lit(0.0), 100.0 - cv * 100.0)).otherwise(0.0)
    score = F.least(F.lit(10.0) * F.col("calls_per_s"), F.lit(100.0)) * 0.7 + steady * 0.3
    return (out.withColumn("calls_per_s", cps).withColumn("cv", cv)
            .withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))))


def robust_slow_ranks(calls: DataFrame, row_floor: int | None = None) -> DataFrame:
    """Vote of score, pace and jitter against median and MAD; two of three make a rank slow.

    The statistics run over one row per rank, so exact ``percentile`` buffers are bounded.
    """
    pace = rank_pace(calls, row_floor).select(
        "rank", *[F.round(c, 9).alias(c) for c in ("score", "calls_per_s", "cv")])
    names = ("score", "calls_per_s", "cv")
    # two one-row subqueries: middle and tails, then the deviation from the middle
    mid = pace.agg(F.struct(
        *[F.median(c).alias(c) for c in names], F.count(F.lit(1)).alias("n"),
        F.percentile("score", F.lit(0.1)).alias("p_score"),
        F.percentile("calls_per_s", F.lit(0.1)).alias("p_calls"),
        F.percentile("cv", F.lit(0.9)).alias("p_cv"))).scalar()
    dev = pace.agg(F.struct(*[F.median(F.abs(F.col(c) - mid[c])).alias(c) for c in names])).scalar()
    few = mid["n"] < 5
    s, f, v = (F.col(c) for c in names)
    low_s = (s < mid["p_score"]) | (~few & (s < mid["score"] - F.greatest(
        3.0 * dev["score"], F.lit(5.0))))
    low_f = (f < mid["p_calls"]) | (~few & (f < mid["calls_per_s"] - F.greatest(
        3.0 * dev["calls_per_s"], 0.1 * mid["calls_per_s"])))
    high_v = (v > mid["p_cv"]) | (~few & (v > mid["cv"] + F.greatest(3.0 * dev["cv"], F.lit(0.2))))
    hits = low_s.cast("int") + low_f.cast("int") + high_v.cast("int")
    return (pace.withColumn("hits", hits).withColumn("is_slow", F.col("hits") >= 2)
            .select("rank", "hits", "is_slow"))


def simple_slow_ranks(calls: DataFrame) -> DataFrame:
    """Ranks whose mean + std of call times lies above the 95th percentile of all ranks."""
    base = calls.agg(F.min("ts_ns")).scalar()
    x = (F.col("ts_ns") - base) / 1e9
    scores = calls.withColumn("_x", x).groupBy("rank").agg(
        F.round(F.avg("_x") + F.stddev_pop("_x"), 6).alias("score_s"))
    return scores.where(F.col("score_s") > scores.agg(
        F.percentile("score_s", F.lit(0.95))).scalar())


# ---- interval patterns --------------------------------------------------------------------

def _series_stats(calls: DataFrame, row_floor: int | None):
    calls_of = _by_time(calls, SERIES, row_floor)
    gaps = _gaps(calls_of).where(F.col("gap_s").isNotNull())
    # gaps per series = calls - 1, so the calls themselves tell which series are hot
    groups = gaps_by_length(gaps, SERIES, calls_of, row_floor, sizes_from=calls)
    stats = groups.numbered().groupBy(*SERIES).agg(
        F.max("_n").alias("gaps"), F.avg("gap_s").alias("mean_s"),
        F.stddev_pop("gap_s").alias("std_s"), F.min("gap_s").alias("min_s"),
        F.max("gap_s").alias("max_s"), F.sum("gap_s").alias("duration_s"),
        *[quantile("gap_s", p / 100).alias(f"p{p}_s") for p in (25, 50, 75, 95, 99)])
    return gaps, stats, groups.hot_keys


def pattern_of(gaps: Column, mean: Column, std: Column) -> Column:
    cv = F.when(mean > 0, std / mean).otherwise(F.lit(float("inf")))
    return (F.when(gaps < 3, "insufficient_data").when(cv < 0.1, "regular")
            .when(cv < 0.3, "moderately_regular").when(cv < 0.5, "irregular")
            .otherwise("highly_irregular"))


def time_patterns(calls: DataFrame, row_floor: int | None = None) -> DataFrame:
    """Interval statistics and regularity class of every (function, rank, stream)."""
    return _time_patterns(_series_stats(calls, row_floor)[1])


def _time_patterns(stats: DataFrame) -> DataFrame:
    return stats.select(
        *SERIES, "mean_s", "std_s", "min_s", "max_s", "p50_s", "p95_s", "p99_s",
        (F.col("gaps") + 1).alias("call_count"), "duration_s",
        pattern_of(F.col("gaps"), F.col("mean_s"), F.col("std_s")).alias("pattern_type"))


def severity_of(z: Column) -> Column:
    return (F.when(z > 5, "critical").when(z > 4, "high").when(z > 3, "medium").otherwise("low"))


def interval_anomalies(calls: DataFrame, row_floor: int | None = None) -> DataFrame:
    """Intervals beyond three sigmas, or outside the quartile fences (once per call)."""
    return _interval_anomalies(*_series_stats(calls, row_floor))


def _interval_anomalies(gaps: DataFrame, stats: DataFrame, hot: list) -> DataFrame:
    usable = stats.where("gaps >= 3").select(*SERIES, "mean_s", "std_s", "p25_s", "p75_s")
    z = F.when(F.col("std_s") > 0, (F.col("gap_s") - F.col("mean_s")) / F.col("std_s")).otherwise(0.0)
    fence = 1.5 * (F.col("p75_s") - F.col("p25_s"))
    by_z = F.round(F.abs(z), 9) > 3
    outside = ((F.round("gap_s", 9) < F.round(F.col("p25_s") - fence, 9)) |
               (F.round("gap_s", 9) > F.round(F.col("p75_s") + fence, 9)))
    return (attach(gaps, usable, SERIES, hot).withColumn("z_score", z)
            .withColumn("method", F.when(by_z, "z_score").when(outside, "iqr"))
            .where(F.col("method").isNotNull())
            .select(*SERIES, "ts_ns", "method", severity_of(F.abs(F.col("z_score"))).alias("severity"),
                    F.col("mean_s").alias("expected_s"), F.col("gap_s").alias("actual_s"), "z_score"))


def missing_calls(calls: DataFrame, expected: str = "median", row_floor: int | None = None
                  ) -> DataFrame:
    """Series with under 80 % of the calls their usual interval implies.

    ``expected='mean'`` compares with the mean interval, which by construction never fires.
    """
    return _missing_calls(_series_stats(calls, row_floor)[1], expected)


def _missing_calls(stats: DataFrame, expected: str) -> DataFrame:
    step = F.col("p50_s") if expected == "median" else F.col("mean_s")
    want = F.when(step > 0, F.floor(F.round(F.col("duration_s") / step, 6)) + 1).otherwise(1)
    return (stats.where("gaps >= 3").withColumn("expected_calls", want.cast("bigint"))
            .withColumn("call_count", F.col("gaps") + 1)
            .where(F.col("call_count") < 0.8 * F.col("expected_calls"))
            .select(*SERIES, "call_count", "expected_calls", F.lit("medium").alias("severity")))


def all_anomalies(calls: DataFrame, row_floor: int | None = None) -> DataFrame:
    """(series, anomaly type, severity, time) of interval outliers and missing calls."""
    return _all_anomalies(calls, _series_stats(calls, row_floor))


def _all_anomalies(calls: DataFrame, series) -> DataFrame:
    found = _interval_anomalies(*series).select(
        *SERIES, F.lit("interval_outlier").alias("anomaly_type"), "severity", "ts_ns")
    ends = calls.groupBy(*SERIES).agg(F.max("ts_ns").alias("ts_ns"))
    gone = (_missing_calls(series[1], "median").join(ends, SERIES)
            .select(*SERIES, F.lit("missing_call").alias("anomaly_type"), "severity", "ts_ns"))
    return found.unionByName(gone)


def timing_histogram(calls: DataFrame, row_floor: int | None = None) -> DataFrame:
    """Counts of pattern types, anomaly types and severities in one table."""
    series = _series_stats(calls, row_floor)
    kinds = _time_patterns(series[1]).groupBy(
        F.lit("pattern").alias("facet"), F.col("pattern_type").alias("name")).agg(
        F.count(F.lit(1)).alias("n"))
    # one pass: every anomaly counts once as a type and once as a severity
    both = F.array(F.struct(F.lit("anomaly").alias("facet"), F.col("anomaly_type").alias("name")),
                   F.struct(F.lit("severity").alias("facet"), F.col("severity").alias("name")))
    marks = (_all_anomalies(calls, series).select(F.explode(both).alias("_b"))
             .groupBy("_b.facet", "_b.name").agg(F.count(F.lit(1)).alias("n")))
    return kinds.unionByName(marks)


def top_anomalies(calls: DataFrame, k: int = 10, row_floor: int | None = None) -> DataFrame:
    """The k most severe anomalies, newest first inside a severity."""
    weight = lookup({"critical": 4, "high": 3, "medium": 2, "low": 1}, F.col("severity"))
    return (all_anomalies(calls, row_floor).orderBy(weight.desc(), F.col("ts_ns").desc(), *SERIES,
                                                    "anomaly_type").limit(k))


def slow_calls(calls: DataFrame, row_floor: int | None = None) -> DataFrame:
    """Calls whose interval on their (rank, stream) exceeds the limit of their function."""
    return (intervals(calls, ["rank", "stream"], row_floor)
            .withColumn("limit_s", slow_limit(F.col("function")))
            .where(F.col("gap_s") > F.col("limit_s")))
