"""Live detectors built on event-time sessions and windows; all state stays in the JVM.

A silence is the end of a session: ``session_window`` with the idle limit as its gap closes exactly
when the watermark has passed the last event by that limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import div
from fleetlens.operators import rules as R


def _gap(seconds: float) -> str:
    """Gap text.  A session still takes in an event exactly at its end, so only a silence longer
    than the gap ends it."""
    return f"{round(seconds * 1_000_000)} microseconds"


def stream_hangs(calls: DataFrame, idle_s: float = 300.0, delay: str = "0 seconds") -> DataFrame:
    """Streams silent for longer than the limit, as soon as the watermark shows it.

    ``calls`` has rank, stream, function, op_count and an event time ``ts``.
    """
    last = F.max_by(F.struct("function", "op_count"), "ts")
    return (calls.withWatermark("ts", delay)
            .groupBy("rank", "stream", F.session_window("ts", _gap(idle_s)).alias("_s"))
            .agg(F.max("ts").alias("last_ts"), last.alias("_l"))
            .select("rank", "stream", F.col("_l.function").alias("function"),
                    F.col("_l.op_count").alias("op_count"),
                    F.unix_micros("last_ts").alias("last_us")))


def offline_clients(beats: DataFrame, timeout_s: float = 1200.0, delay: str = "0 seconds"
                    ) -> DataFrame:
    """One row per silence above the timeout; ``online_us`` is when the client (re)appeared."""
    return (beats.withWatermark("ts", delay)
            .groupBy("client_id", F.session_window("ts", _gap(timeout_s)).alias("_s"))
            .agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
            .select("client_id", F.unix_micros("_a").alias("online_us"),
                    F.unix_micros("_b").alias("last_us")))


def flush_batches(calls: DataFrame, idle_s: float = 3.0, delay: str | None = "0 seconds"
                  ) -> DataFrame:
    """Flush batches per rank re-derived from idle time: a pause of ``idle_s`` or more ends one.

    Works on tables (``delay=None``) too.
    """
    idle = _gap(idle_s - 1e-6)
    rows = calls.withWatermark("ts", delay) if delay is not None else calls
    return (rows.groupBy("rank", F.session_window("ts", idle).alias("_s"))
            .agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"), F.count(F.lit(1)).alias("calls"))
            .select("rank", F.unix_micros("_a").alias("first_us"),
                    F.unix_micros("_b").alias("last_us"), "calls"))


def deduplicated(calls: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Repeated deliveries of a call dropped while within the watermark."""
    return (calls.withWatermark("ts", delay)
            .dropDuplicatesWithinWatermark(["rank", "stream", "op_count", "ts"]))


def firing_ticks(samples: DataFrame, rule: R.Rule, clock: R.Clock, equal: dict | None = None,
                 delay: str = "0 seconds") -> DataFrame:
    """Ticks at which a threshold rule fires: every tick of its hold breached.

    Newest sample per tick, then a sliding window over the hold; a full window of breaches fires.
    The rule's own matchers apply, ``equal`` adds to them.  Rules on rates, ratios or excluded labels
    cannot be evaluated this way and are refused.
    """
    metric, matchers, differ = getattr(rule.vector, "selects", (None, {}, ()))
    if metric is None or differ or rule.by_instance:
        raise ValueError(f"{rule.rule_id} is no bare threshold")
    step = f"{clock.step_s} seconds"
    hold = clock.ticks(rule.hold_s) + 1
    rows = samples.where(F.col("metric") == metric)
    for key, value in (matchers | (equal or {})).items():
        rows = rows.where(F.col("labels")[key] == value)
    ticks = (rows.withWatermark("ts", delay)
             .groupBy(R.series_key(F.col("labels")).alias("series"), F.window("ts", step).alias("_w"))
             .agg(F.max_by("value", "ts").alias("value"))
             .where(rule.breach(F.col("value"))))
    held = (ticks.groupBy("series", F.window(F.window_time("_w"), f"{hold * clock.step_s} seconds",
                                             step).alias("_h"))
            .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == hold))
    end = F.unix_micros("_h.end")
    return held.select("series", (div(end, clock.step_s * 1_000_000) - 1).alias("tick"))
