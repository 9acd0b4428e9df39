"""Hang, pace, interval, sequence and role queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.fixtures import COMM_SQL, SEQ_SQL, call_sequences, comm_ops
from fleetlens.catalog.registry import add
from fleetlens.operators import hang as H
from fleetlens.operators import roles as R
from fleetlens.operators import sequences as S
from fleetlens.operators import timing as T
from fleetlens.plans.ordered import OrderedGroups


def _last_sql(base: str, table: str) -> str:
    return base + f""", batch AS (SELECT c.* FROM {table} c
 JOIN (SELECT rank, max(save_count) AS save_count FROM {table} GROUP BY 1) USING (rank, save_count)),
ord AS (SELECT *, row_number() OVER (PARTITION BY rank, stream
  ORDER BY ts_ns DESC, op_count DESC, event_id DESC) AS place,
  lead(ts_ns) OVER (PARTITION BY rank, stream ORDER BY ts_ns DESC, op_count DESC, event_id DESC)
  AS before_ns FROM batch),
last AS (SELECT rank, stream, function, op_count, ts_ns, before_ns FROM ord WHERE place = 1)"""


LAST_SQL = _last_sql(COMM_SQL, "comm_ops")
LAST_SEQ_SQL = _last_sql(SEQ_SQL, "call_sequences")

add("p1_last_batch", lambda s, d: H.last_batch(comm_ops(s, d)).groupBy("rank", "save_count").agg(
    F.count(F.lit(1)).alias("calls"), F.min("ts_ns").alias("first_ns")), LAST_SQL + """
SELECT rank, save_count, count(*) AS calls, min(ts_ns) AS first_ns FROM batch GROUP BY 1, 2""")

add("w1_numbered_calls", lambda s, d: OrderedGroups(
    comm_ops(s, d), ["rank", "stream"], ["ts_ns", "op_count", "event_id"]).numbered("seq", None)
    .select("rank", "stream", "event_id", (F.col("seq") + 1).cast("bigint").alias("seq")),
    COMM_SQL + """
SELECT rank, stream, event_id, row_number() OVER (PARTITION BY rank, stream
 ORDER BY ts_ns, op_count, event_id) AS seq FROM comm_ops""")

add("w2_last_calls", lambda s, d: H.last_calls(comm_ops(s, d)), LAST_SQL + " SELECT * FROM last")

add("w3_stream_hangs", lambda s, d: H.stream_hangs(comm_ops(s, d)), LAST_SQL + """
, idle AS (SELECT *, ((SELECT max(ts_ns) FROM comm_ops) - ts_ns) / 1e9 AS idle_s FROM last)
SELECT rank, stream, function, op_count, round(idle_s + 1e-9, 6) AS idle_s,
 CASE WHEN idle_s > 600 THEN 'high' ELSE 'medium' END AS severity FROM idle WHERE idle_s > 300""")

add("w4_collective_hangs", lambda s, d: H.collective_hangs(comm_ops(s, d)), LAST_SQL + """
SELECT rank, stream, function, op_count, round((ts_ns - before_ns) / 1e9 + 1e-9, 6) AS gap_s,
 'high' AS severity FROM last WHERE function IN ('AllReduce', 'AllGather', 'Broadcast')
 AND (ts_ns - before_ns) / 1e9 > 120""")

_SYNC = """SELECT op_count, count(*) AS streams, min(rank) AS first_rank, max(rank) AS last_rank,
 string_agg(DISTINCT function, ',' ORDER BY function) AS functions, count(*) = 1 AS is_unique
FROM last GROUP BY 1"""
add("a28_sync_comparison", lambda s, d: H.sync_comparison(comm_ops(s, d)), LAST_SQL + _SYNC)
add("a28_sync_comparison_numbered", lambda s, d: H.sync_comparison(call_sequences(s, d)),
    LAST_SEQ_SQL + _SYNC.replace("SELECT op_count", "SELECT CAST(op_count AS BIGINT) AS op_count"))
add("a28_sync_ranks", lambda s, d: H.sync_ranks(comm_ops(s, d)), LAST_SQL + """
SELECT op_count, function, count(*) AS streams,
 array_to_string(list_sort(list(DISTINCT rank)), ',') AS ranks FROM last
WHERE op_count IN (SELECT op_count FROM last GROUP BY 1 HAVING count(*) > 1) GROUP BY 1, 2""")
add("a28_hang_candidate", lambda s, d: H.hang_candidate(call_sequences(s, d)), LAST_SEQ_SQL + """
, solo AS (SELECT op_count FROM last GROUP BY 1 HAVING count(*) = 1)
SELECT rank, stream, function, CAST(op_count AS BIGINT) AS op_count FROM last
WHERE op_count = (SELECT min(op_count) FROM solo)""")

# ---- pace ---------------------------------------------------------------------------------

PACE_SQL = LAST_SQL + """, gp AS (SELECT rank, (ts_ns - lag(ts_ns) OVER (PARTITION BY rank
  ORDER BY ts_ns, op_count, event_id)) / 1e9 AS gap_s FROM batch),
span AS (SELECT rank, count(*) AS total_calls, (max(ts_ns) - min(ts_ns)) / 1e9 AS duration_s
 FROM batch GROUP BY 1),
ps AS (SELECT rank, avg(gap_s) AS mean_s, stddev_pop(gap_s) AS std_s, max(gap_s) AS max_s,
 quantile_cont(gap_s, 0.95) AS p95_s FROM gp WHERE gap_s IS NOT NULL GROUP BY 1),
base AS (SELECT rank, total_calls, duration_s, coalesce(mean_s, 0) AS mean_s,
 coalesce(std_s, 0) AS std_s, coalesce(max_s, 0) AS max_s, coalesce(p95_s, 0) AS p95_s,
 CASE WHEN duration_s > 0 THEN total_calls / duration_s ELSE 0 END AS calls_per_s,
 CASE WHEN mean_s > 0 THEN std_s / mean_s ELSE 0 END AS cv FROM span LEFT JOIN ps USING (rank)),
pace AS (SELECT *, greatest(0, least(100, least(100, 10 * calls_per_s) * 0.7
 + CASE WHEN mean_s > 0 THEN greatest(0, 100 - cv * 100) ELSE 0 END * 0.3)) AS score FROM base)"""

add("a2_rank_pace", lambda s, d: T.rank_pace(comm_ops(s, d)), PACE_SQL + """
SELECT rank, total_calls, round(duration_s + 1e-9, 6) AS duration_s, round(mean_s + 1e-9, 6) AS mean_s,
 round(std_s + 1e-9, 6) AS std_s, round(max_s + 1e-9, 6) AS max_s, round(p95_s + 1e-9, 6) AS p95_s,
 round(calls_per_s + 1e-9, 6) AS calls_per_s, round(cv + 1e-9, 6) AS cv, round(score + 1e-9, 6) AS score FROM pace""")

add("a3_robust_slow_ranks", lambda s, d: T.robust_slow_ranks(comm_ops(s, d)), PACE_SQL + """
, p AS (SELECT rank, round(score, 9) AS s, round(calls_per_s, 9) AS f, round(cv, 9) AS v FROM pace),
m AS (SELECT median(s) AS ms, median(f) AS mf, median(v) AS mv, quantile_cont(s, 0.1) AS ps,
 quantile_cont(f, 0.1) AS pf, quantile_cont(v, 0.9) AS pv, count(*) AS n FROM p),
dd AS (SELECT median(abs(s - ms)) AS ds, median(abs(f - mf)) AS df, median(abs(v - mv)) AS dv
 FROM p, m),
h AS (SELECT rank,
 CAST(s < ps OR (n >= 5 AND s < ms - greatest(3 * ds, 5)) AS INT)
 + CAST(f < pf OR (n >= 5 AND f < mf - greatest(3 * df, 0.1 * mf)) AS INT)
 + CAST(v > pv OR (n >= 5 AND v > mv + greatest(3 * dv, 0.2)) AS INT) AS hits FROM p, m, dd)
SELECT rank, hits, hits >= 2 AS is_slow FROM h""")

add("a4_simple_slow_ranks", lambda s, d: T.simple_slow_ranks(comm_ops(s, d)), COMM_SQL + """
, x AS (SELECT rank, (ts_ns - (SELECT min(ts_ns) FROM comm_ops)) / 1e9 AS x FROM comm_ops),
sc AS (SELECT rank, round(avg(x) + stddev_pop(x), 6) AS score_s FROM x GROUP BY 1)
SELECT rank, score_s FROM sc WHERE score_s > (SELECT quantile_cont(score_s, 0.95) FROM sc)""")

# ---- intervals ----------------------------------------------------------------------------

_S = "function, rank, stream"
GAP_SQL = COMM_SQL + f""", gp AS (SELECT {_S}, ts_ns, (ts_ns - lag(ts_ns) OVER (PARTITION BY {_S}
  ORDER BY ts_ns, op_count, event_id)) / 1e9 AS gap_s FROM comm_ops),
gs AS (SELECT {_S}, count(gap_s) AS gaps, avg(gap_s) AS mean_s, stddev_pop(gap_s) AS std_s,
 min(gap_s) AS min_s, max(gap_s) AS max_s, sum(gap_s) AS duration_s,
 quantile_cont(gap_s, 0.25) AS p25_s, quantile_cont(gap_s, 0.5) AS p50_s,
 quantile_cont(gap_s, 0.75) AS p75_s, quantile_cont(gap_s, 0.95) AS p95_s,
 quantile_cont(gap_s, 0.99) AS p99_s FROM gp WHERE gap_s IS NOT NULL GROUP BY ALL),
kind AS (SELECT *, CASE WHEN gaps < 3 THEN 'insufficient_data' WHEN mean_s <= 0 THEN 'highly_irregular'
 WHEN std_s / mean_s < 0.1 THEN 'regular' WHEN std_s / mean_s < 0.3 THEN 'moderately_regular'
 WHEN std_s / mean_s < 0.5 THEN 'irregular' ELSE 'highly_irregular' END AS pattern_type FROM gs),
sc AS (SELECT {_S}, ts_ns, mean_s, gap_s, CASE WHEN std_s > 0 THEN (gap_s - mean_s) / std_s ELSE 0 END AS z,
 round(gap_s, 9) < round(p25_s - 1.5 * (p75_s - p25_s), 9)
 OR round(gap_s, 9) > round(p75_s + 1.5 * (p75_s - p25_s), 9) AS outside
 FROM gp JOIN gs USING ({_S}) WHERE gap_s IS NOT NULL AND gaps >= 3),
an AS (SELECT *, CASE WHEN round(abs(z), 9) > 3 THEN 'z_score' ELSE 'iqr' END AS method,
 CASE WHEN abs(z) > 5 THEN 'critical' WHEN abs(z) > 4 THEN 'high' WHEN abs(z) > 3 THEN 'medium'
 ELSE 'low' END AS severity FROM sc WHERE round(abs(z), 9) > 3 OR outside),
miss AS (SELECT {_S}, gaps + 1 AS call_count, CAST(CASE WHEN p50_s > 0
 THEN floor(round(duration_s / p50_s, 6)) + 1 ELSE 1 END AS BIGINT) AS expected_calls FROM gs
 WHERE gaps >= 3),
gone AS (SELECT * FROM miss WHERE call_count < 0.8 * expected_calls),
allan AS (SELECT {_S}, 'interval_outlier' AS anomaly_type, severity, ts_ns FROM an
 UNION ALL SELECT {_S}, 'missing_call', 'medium', e.ts_ns FROM gone
 JOIN (SELECT {_S}, max(ts_ns) AS ts_ns FROM comm_ops GROUP BY ALL) e USING ({_S}))"""

add("w5_intervals", lambda s, d: T.intervals(comm_ops(s, d), ["rank", "stream"]).select(
    "rank", "stream", "event_id", "gap_s"), COMM_SQL + """
SELECT rank, stream, event_id, round((ts_ns - lag(ts_ns) OVER (PARTITION BY rank, stream
 ORDER BY ts_ns, op_count, event_id)) / 1e9 + 1e-9, 6) AS gap_s FROM comm_ops""")

add("a18_time_patterns", lambda s, d: T.time_patterns(comm_ops(s, d)), GAP_SQL + f"""
SELECT {_S}, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in (
    'mean_s', 'std_s', 'min_s', 'max_s', 'p50_s', 'p95_s', 'p99_s', 'duration_s'))},
 gaps + 1 AS call_count, pattern_type FROM kind""")

add("w6_interval_anomalies", lambda s, d: T.interval_anomalies(comm_ops(s, d)), GAP_SQL + f"""
SELECT {_S}, ts_ns, method, severity, round(mean_s + 1e-9, 6) AS expected_s, round(gap_s + 1e-9, 6) AS actual_s,
 round(z + 1e-9, 6) AS z_score FROM an""")

add("w7_quartile_only_anomalies", lambda s, d: T.interval_anomalies(comm_ops(s, d))
    .where("method = 'iqr'").select("function", "rank", "stream", "ts_ns", "severity"), GAP_SQL + f"""
SELECT {_S}, ts_ns, severity FROM an WHERE method = 'iqr'""")

add("j7_anomaly_methods", lambda s, d: T.interval_anomalies(comm_ops(s, d)).groupBy("method", "rank")
    .agg(F.count(F.lit(1)).alias("n")),
    GAP_SQL + " SELECT method, rank, count(*) AS n FROM an GROUP BY 1, 2")

add("w8_missing_calls", lambda s, d: T.missing_calls(comm_ops(s, d)), GAP_SQL + f"""
SELECT {_S}, call_count, expected_calls, 'medium' AS severity FROM gone""")

add("a19_timing_histogram", lambda s, d: T.timing_histogram(comm_ops(s, d)), GAP_SQL + """
SELECT 'pattern' AS facet, pattern_type AS name, count(*) AS n FROM kind GROUP BY 1, 2
UNION ALL SELECT 'anomaly', anomaly_type, count(*) FROM allan GROUP BY 1, 2
UNION ALL SELECT 'severity', severity, count(*) FROM allan GROUP BY 1, 2""")

add("o1_top_anomalies", lambda s, d: T.top_anomalies(comm_ops(s, d)), GAP_SQL + f"""
SELECT {_S}, anomaly_type, severity, ts_ns FROM allan ORDER BY CASE severity WHEN 'critical' THEN 4
 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, ts_ns DESC, {_S}, anomaly_type LIMIT 10""")

add("f7_slow_calls", lambda s, d: T.slow_calls(comm_ops(s, d)).select(
    "event_id", "function", "gap_s", "limit_s"), COMM_SQL + """
, gp AS (SELECT event_id, function, (ts_ns - lag(ts_ns) OVER (PARTITION BY rank, stream
 ORDER BY ts_ns, op_count, event_id)) / 1e9 AS gap_s, CASE function WHEN 'AllReduce' THEN 5
 WHEN 'AllGather' THEN 8 WHEN 'Broadcast' THEN 3 WHEN 'Send' THEN 15 WHEN 'Recv' THEN 15 ELSE 10 END
 AS limit_s FROM comm_ops)
SELECT event_id, function, round(gap_s + 1e-9, 6) AS gap_s, limit_s FROM gp WHERE gap_s > limit_s""")

# ---- sequences ----------------------------------------------------------------------------

_ST = "rank, stream, save_count"
ISLAND_SQL = SEQ_SQL + f""", fl AS (SELECT *, CASE WHEN lag(op_count) OVER w IS NULL
  OR op_count <> lag(op_count) OVER w + 1 THEN 1 ELSE 0 END AS brk FROM call_sequences
 WINDOW w AS (PARTITION BY {_ST} ORDER BY op_count, ts_ns, event_id)),
isl AS (SELECT *, sum(brk) OVER (PARTITION BY {_ST} ORDER BY op_count, ts_ns, event_id) AS island_no
 FROM fl),
pos AS (SELECT *, min(op_count) OVER (PARTITION BY {_ST}, island_no) AS start_op,
 row_number() OVER i - 1 AS idx, ts_ns - lag(ts_ns) OVER i AS gap FROM isl
 WINDOW i AS (PARTITION BY {_ST}, island_no ORDER BY op_count, ts_ns, event_id)),
fc AS (SELECT {_ST}, start_op, island_no, idx - 1 AS gap_idx, ts_ns, gap / 1e9 AS actual_s,
 CAST(sum(gap) OVER t AS DOUBLE) / count(gap) OVER t / 1e9 AS predicted_s FROM pos
 WINDOW t AS (PARTITION BY {_ST}, island_no ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
raw AS (SELECT *, CASE WHEN actual_s = 0 THEN abs(actual_s - predicted_s)
 ELSE abs(actual_s - predicted_s) / abs(actual_s) END AS deviation FROM fc WHERE gap_idx >= 0),
dev AS (SELECT *, round(deviation, 9) AS dev9 FROM raw),
hit AS (SELECT * FROM dev WHERE gap_idx >= 10 AND dev9 > 2)"""

add("w9_sequences", lambda s, d: S.sequences(call_sequences(s, d)), ISLAND_SQL + f"""
SELECT {_ST}, CAST(start_op AS BIGINT) AS start_op, count(*) AS length,
 CAST(max(op_count) AS BIGINT) AS end_op, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns
FROM pos GROUP BY {_ST}, start_op, island_no HAVING count(*) >= 2""")

add("w10_forecast_anomalies", lambda s, d: S.forecast_anomalies(call_sequences(s, d)).drop("island_no"),
    ISLAND_SQL + f"""
SELECT {_ST}, CAST(start_op AS BIGINT) AS start_op, gap_idx, ts_ns, round(actual_s + 1e-9, 6) AS actual_s,
 round(predicted_s + 1e-9, 6) AS predicted_s, round(deviation + 1e-9, 6) AS deviation FROM hit""")

add("w11_lag_regression", lambda s, d: S.linear_forecast(call_sequences(s, d)))

# one lag and no penalty: the least-squares line that SQL knows too
add("w11_one_lag_line", lambda s, d: S.linear_forecast(call_sequences(s, d), lags=1, penalty=0.0),
    ISLAND_SQL + f"""
, ends AS (SELECT {_ST}, island_no, 7 * count(*) // 10 AS train FROM fc WHERE gap_idx >= 0
 GROUP BY {_ST}, island_no),
lagged AS (SELECT *, lag(actual_s) OVER (PARTITION BY {_ST}, island_no ORDER BY gap_idx) AS before_s
 FROM fc JOIN ends USING ({_ST}, island_no) WHERE gap_idx >= 0),
span AS (SELECT {_ST}, island_no, min(actual_s) AS lo, max(actual_s) AS hi FROM lagged
 WHERE gap_idx < train GROUP BY {_ST}, island_no),
scaled AS (SELECT *, CASE WHEN hi > lo THEN (before_s - lo) / (hi - lo) ELSE before_s END AS x,
 CASE WHEN hi > lo THEN (actual_s - lo) / (hi - lo) ELSE actual_s END AS y
 FROM lagged JOIN span USING ({_ST}, island_no) WHERE gap_idx >= 1),
line AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM scaled WHERE gap_idx < train),
said AS (SELECT *, CASE WHEN hi > lo THEN (a + b * x) * (hi - lo) + lo ELSE a + b * x END AS p
 FROM scaled, line WHERE gap_idx >= train)
SELECT {_ST}, CAST(start_op AS BIGINT) AS start_op, gap_idx, ts_ns, round(actual_s + 1e-9, 6) AS actual_s,
 round(p + 1e-9, 6) AS predicted_s, round(CASE WHEN actual_s = 0 THEN abs(p)
 ELSE abs(actual_s - p) / abs(actual_s) END + 1e-9, 6) AS deviation FROM said""")

add("w12_sequence_rollup", lambda s, d: S.sequence_rollup(call_sequences(s, d)), ISLAND_SQL + """
, lv AS (SELECT 'sequence' AS level, rank, stream, save_count, CAST(start_op AS BIGINT) AS start_op,
  deviation, gap_idx FROM hit
 UNION ALL SELECT 'stream', rank, stream, NULL, NULL, deviation, gap_idx FROM hit
 UNION ALL SELECT 'rank', rank, NULL, NULL, NULL, deviation, gap_idx FROM hit)
SELECT level, rank, stream, save_count, start_op, count(*) AS anomalies,
 round(max(deviation) + 1e-9, 6) AS max_deviation, min(gap_idx) AS first_idx, max(gap_idx) AS last_idx
FROM lv GROUP BY 1, 2, 3, 4, 5""")

add("w13_preset_sweep", lambda s, d: S.preset_sweep(call_sequences(s, d)), ISLAND_SQL + """
, pre(lags, threshold) AS (VALUES (5, CAST(1.0 AS DOUBLE)), (10, 2.0), (15, 3.0), (8, 2.5))
SELECT lags, threshold, count(*) AS anomalies, round(max(dev9) + 1e-9, 6) AS max_deviation
FROM dev JOIN pre ON gap_idx >= lags AND dev9 > threshold GROUP BY 1, 2""")

add("c1_stream_roles", lambda s, d: R.stream_roles(comm_ops(s, d)), COMM_SQL + """
, tr AS (SELECT rank, stream, count(DISTINCT op_count) AS op_counts, max(data_size) < 1024 AS is_barrier,
 bool_and(contains(lower(function), 'send') OR contains(lower(function), 'recv')) AS is_pp,
 bool_and(contains(lower(function), 'reduce') OR contains(lower(function), 'allgather')) AS red
 FROM comm_ops GROUP BY 1, 2),
ch AS (SELECT rank, arg_min(stream, (-op_counts, stream)) AS tp, arg_min(stream, (op_counts, stream)) AS dp
 FROM tr WHERE red GROUP BY 1)
SELECT tr.rank, stream, op_counts, is_barrier, is_pp, coalesce(tp = stream, false) AS is_tp,
 coalesce(dp = stream, false) AS is_dp FROM tr LEFT JOIN ch USING (rank)""")
