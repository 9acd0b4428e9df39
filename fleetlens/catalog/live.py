"""Streaming queries, drained over the whole table, and their batch meaning in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog import fixtures as X
from fleetlens.catalog.fixtures import COMM_SQL, HEART_SQL, samples_sql
from fleetlens.catalog.alerting import LIFE_SQL
from fleetlens.catalog.linking import BAND_SQL
from fleetlens.catalog.registry import add
from fleetlens.catalog.ruling import CLOCK, _instant_sql
from fleetlens.functions.numbers import div
from fleetlens.operators import rules as R
from fleetlens.plans.durable import scratch_path
from fleetlens.streaming import bandwidth, detectors, lifecycle, silence
from fleetlens.streaming.run import drain, drain_clock, parquet_stream


def _event_stream(s, d):
    return X.events_of(parquet_stream(s, f"{d}/events.parquet"))


def _call_stream(s, d):
    return X.calls_of(_event_stream(s, d), "ts").withColumn("ts", F.col("ts").cast("timestamp"))


add("x1_live_stream_hangs", lambda s, d: drain(detectors.stream_hangs(_call_stream(s, d), 300.0), "hangs"),
    COMM_SQL + """, n AS (SELECT rank, stream, function, op_count, ts_ns // 1000 AS last_us,
 lead(ts_ns // 1000) OVER (PARTITION BY rank, stream ORDER BY ts_ns) AS next_us,
 max(ts_ns // 1000) OVER () AS now_us FROM comm_ops)
SELECT rank, stream, function, op_count, last_us FROM n
WHERE coalesce(next_us, now_us) - last_us > 300000000""")


# by the clock every stream and client has long been silent, whatever the newest event is
add("x1_clock_stream_hangs", lambda s, d: drain_clock(silence.hung_streams(_call_stream(s, d), 300.0), "clock_hangs"),
    COMM_SQL + """, n AS (SELECT rank, stream, function, op_count, ts_ns // 1000 AS last_us,
 lead(ts_ns // 1000) OVER (PARTITION BY rank, stream ORDER BY ts_ns) AS next_us FROM comm_ops)
SELECT rank, stream, function, op_count, last_us FROM n WHERE next_us IS NULL OR next_us - last_us > 300000000""")

add("x3_clock_connections", lambda s, d: drain_clock(silence.connection_events(_event_stream(s, d).select(
    (F.col("user_id") % 8).alias("client_id"), F.col("ts").cast("timestamp").alias("ts"))), "connections"),
    HEART_SQL + """, n AS (SELECT client_id, us, lag(us) OVER (PARTITION BY client_id ORDER BY us) AS b FROM heartbeats),
st AS (SELECT *, sum(CASE WHEN b IS NULL OR us - b > 1200000000 THEN 1 ELSE 0 END)
 OVER (PARTITION BY client_id ORDER BY us) AS run FROM n),
runs AS (SELECT client_id, min(us) AS a, max(us) + 1200000000 AS z FROM st GROUP BY client_id, run)
SELECT client_id, a AS us, 'recovered' AS event FROM runs UNION ALL SELECT client_id, z, 'offline' FROM runs""")


def _polls(s, d):
    e = _event_stream(s, d).where("event_type = 'error'")
    return e.select(F.concat(F.lit("fp"), "user_id").alias("fingerprint"), F.col("tick").alias("poll"))


add("x2_live_lifecycle", lambda s, d: drain(lifecycle.live_states(_polls(s, d), 3, 60), "lifecycle"),
    LIFE_SQL + " SELECT fingerprint, poll, state FROM life")

add("x3_live_offline_clients", lambda s, d: drain(detectors.offline_clients(_event_stream(s, d).select(
    (F.col("user_id") % 8).alias("client_id"), F.col("ts").cast("timestamp").alias("ts"))), "offline"),
    HEART_SQL + """, n AS (SELECT client_id, us, lag(us) OVER (PARTITION BY client_id ORDER BY us) AS b,
 lead(us) OVER (PARTITION BY client_id ORDER BY us) AS f, max(us) OVER () AS now_us FROM heartbeats),
st AS (SELECT *, sum(CASE WHEN b IS NULL OR us - b > 1200000000 THEN 1 ELSE 0 END)
 OVER (PARTITION BY client_id ORDER BY us) AS run FROM n)
SELECT client_id, min(us) AS online_us, max(us) AS last_us FROM st GROUP BY client_id, run
HAVING max(now_us) - max(us) > 1200000000""")


def _live_samples(s, d):
    return X.samples_of(_event_stream(s, d), "DCGM_FI_DEV_GPU_TEMP")


add("x4_live_rule_ticks", lambda s, d: drain(detectors.firing_ticks(
    _live_samples(s, d), R.RULES["GPU_0101"], CLOCK), "rule"),
    samples_sql("DCGM_FI_DEV_GPU_TEMP") + _instant_sql(0) + """
, b AS (SELECT series, tick FROM v WHERE value > 85)
SELECT b.series, b.tick FROM b JOIN b p ON b.series = p.series AND p.tick = b.tick - 1
WHERE (b.tick + 1) * 300000000 <= (SELECT max(us) FROM s0)""")


def _sends(s, d):
    return parquet_stream(s, X.telemetry_table(s, d, scratch_path(s, "sends")))


add("x5_live_bandwidth", lambda s, d: drain(bandwidth.live_bandwidth(_sends(s, d)), "bandwidth"), BAND_SQL)

_FLUSH = COMM_SQL + """, n AS (SELECT rank, ts_ns // 1000 AS us, lag(ts_ns // 1000) OVER (PARTITION BY rank
 ORDER BY ts_ns) AS b, max(ts_ns // 1000) OVER () AS now_us FROM comm_ops),
st AS (SELECT *, sum(CASE WHEN b IS NULL OR us - b >= 600000000 THEN 1 ELSE 0 END)
 OVER (PARTITION BY rank ORDER BY us) AS run FROM n)
SELECT rank, min(us) AS first_us, max(us) AS last_us, count(*) AS calls FROM st GROUP BY rank, run"""
add("x6_flush_batches", lambda s, d: detectors.flush_batches(
    X.comm_ops(s, d).withColumn("ts", F.timestamp_micros(div(F.col("ts_ns"), 1000))),
    600.0, None), _FLUSH)
add("x6_live_flush_batches", lambda s, d: drain(detectors.flush_batches(
    _call_stream(s, d), 600.0), "flush"),
    _FLUSH + " HAVING max(now_us) - max(us) >= 600000000")

add("x7_live_deduplication", lambda s, d: drain(detectors.deduplicated(_call_stream(s, d).withColumn(
    "copy", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).drop("copy")), "dedupe").select(
        "rank", "stream", "op_count", "event_id"),
    COMM_SQL + " SELECT rank, stream, op_count, event_id FROM comm_ops")
