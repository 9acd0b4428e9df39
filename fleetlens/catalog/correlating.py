"""Missing calls, late operations, completed hashes, as-of joins and followed logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog import fixtures as X
from fleetlens.catalog.fixtures import COMM_SQL, LINE_SQL
from fleetlens.catalog.ingest import _PER_RANK, _per_rank, _written_lines
from fleetlens.catalog.registry import add
from fleetlens.operators import correlate, hang
from fleetlens.operators.repair import repair_hashes
from fleetlens.plans.durable import scratch_path
from fleetlens.sources import log_stream

add("a28_missing_calls", lambda s, d: hang.missing_calls(X.comm_ops(s, d)), COMM_SQL + """
, o AS (SELECT DISTINCT group_hash, rank, op_count FROM comm_ops),
ranks AS (SELECT group_hash, rank, max(op_count) AS last_op FROM o GROUP BY 1, 2),
grid AS (SELECT DISTINCT o.group_hash, r.rank, r.last_op, o.op_count FROM o JOIN ranks r USING (group_hash)),
gap AS (SELECT group_hash, rank, last_op, min(op_count) AS op_count, count(*) AS missing
 FROM grid ANTI JOIN o USING (group_hash, rank, op_count) GROUP BY 1, 2, 3)
SELECT group_hash, rank, op_count, (SELECT min(function) FROM comm_ops c WHERE c.group_hash = g.group_hash
 AND c.op_count = g.op_count) AS function, missing, last_op FROM gap g""")

add("w4_operation_gaps", lambda s, d: hang.operation_gaps(X.comm_ops(s, d)), COMM_SQL + """
, b AS (SELECT * FROM comm_ops QUALIFY save_count = max(save_count) OVER (PARTITION BY rank)),
n AS (SELECT *, row_number() OVER w AS p, lead(ts_ns) OVER w AS before_ns FROM b
 WINDOW w AS (PARTITION BY rank, stream ORDER BY ts_ns DESC, op_count DESC, event_id DESC)),
g AS (SELECT *, (ts_ns - before_ns) / 1e9 AS gap_s, CASE WHEN function IN ('Send', 'Recv', 'SendRecv') THEN 180.0
 ELSE 60.0 END AS limit_s FROM n WHERE p = 1 AND function NOT IN ('AllReduce', 'AllGather', 'Broadcast'))
SELECT rank, stream, function, op_count, round(gap_s + 1e-9, 6) AS gap_s, CAST(limit_s AS DOUBLE) AS limit_s
FROM g WHERE gap_s > limit_s""")


def _cut_calls(s, d):
    """Long hashes; where k < 12 only their first one to four characters were logged."""
    k, text = F.col("k"), F.col("_h").cast("string")
    calls = X.calls_of(X._events(s, d), "k").withColumn("_h", F.col("group_hash") * 1_000_037)
    some = F.substring(text, F.lit(1), 1 + k % 4).try_cast("bigint")
    return calls.withColumns({"cut": k < 12, "group_hash": F.when(k < 12, some).otherwise(F.col("_h"))}).drop("_h")


add("s14_completed_hashes", lambda s, d: repair_hashes(_cut_calls(s, d)).select("event_id", "group_hash", "repair"),
    COMM_SQL + """
, x AS (SELECT c.event_id, c.rank, c.function, c.op_count, c.group_hash * 1000037 AS h, CASE WHEN k < 12 THEN coalesce(CAST(
  try_cast(substr(CAST(c.group_hash * 1000037 AS VARCHAR), 1, CAST(1 + k % 4 AS INT)) AS BIGINT) AS VARCHAR), '') END AS p
 FROM comm_ops c JOIN e USING (event_id)),
a AS (SELECT DISTINCT rank, function, op_count, p FROM x WHERE p IS NOT NULL),
w AS (SELECT DISTINCT function, op_count, h FROM x WHERE p IS NULL),
m AS (SELECT DISTINCT rank, h FROM x WHERE p IS NULL),
c AS (SELECT a.rank, a.function, a.op_count, a.p, w.h, m.rank IS NOT NULL AS mine FROM a JOIN w
 ON w.function = a.function AND w.op_count = a.op_count AND starts_with(CAST(w.h AS VARCHAR), a.p)
 LEFT JOIN m ON m.rank = a.rank AND m.h = w.h),
n AS (SELECT rank, function, op_count, p, count(*) FILTER (mine) AS n1, min(h) FILTER (mine) AS h1, count(*) AS n2,
 min(h) AS h2 FROM c GROUP BY 1, 2, 3, 4),
v AS (SELECT x.event_id, x.p, x.h, CASE WHEN n1 > 0 THEN n1 ELSE coalesce(n2, 0) END AS n,
 CASE WHEN n1 > 0 THEN h1 ELSE h2 END AS said FROM x LEFT JOIN n USING (rank, function, op_count, p))
SELECT event_id, CASE WHEN p IS NULL THEN h WHEN n = 1 THEN said END AS group_hash, CASE WHEN p IS NULL THEN 'kept'
 WHEN n = 1 THEN 'repaired' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS repair FROM v""")


def _link_samples(s, d):
    """Link rates per rank and second, spread over the month of the calls."""
    at = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 613) % 2_592_000
    return s.read.parquet(f"{d}/lineitem.parquet").select(
        (F.col("l_suppkey") % 8).cast("int").alias("rank"), ((1_704_067_200 + at) * 1_000_000_000).alias("ts_ns"),
        (F.col("l_quantity").cast("bigint") * 4096).alias("b"), (F.floor("l_extendedprice") + 1).alias("n")).groupBy(
            "rank", "ts_ns").agg((F.sum("b") * 8 / F.sum("n")).alias("rate_gbps"))


add("link_before_slow_calls", lambda s, d: correlate.link_before_slow_calls(X.comm_ops(s, d), _link_samples(s, d)).drop(
    "op_count"), COMM_SQL + """
, links AS (SELECT CAST(l_suppkey % 8 AS INT) AS rank,
  (1704067200 + (l_orderkey * 7919 + l_linenumber * 613) % 2592000) * 1000000000 AS ts_ns,
  sum(CAST(l_quantity AS BIGINT) * 4096) * 8 / sum(CAST(floor(l_extendedprice) AS BIGINT) + 1) AS rate_gbps
 FROM lineitem GROUP BY 1, 2),
g AS (SELECT *, (ts_ns - lag(ts_ns) OVER (PARTITION BY rank, stream ORDER BY ts_ns, event_id)) / 1e9 AS gap_s FROM comm_ops),
slow AS (SELECT * FROM g WHERE gap_s > CASE function WHEN 'AllReduce' THEN 5 WHEN 'AllGather' THEN 8 WHEN 'Broadcast' THEN 3
 WHEN 'Send' THEN 15 WHEN 'Recv' THEN 15 ELSE 10 END)
SELECT s.rank, stream, function, event_id, s.ts_ns, round(gap_s + 1e-9, 6) AS gap_s, l.ts_ns AS as_of_ts_ns,
 round(rate_gbps + 1e-9, 6) AS rate_gbps FROM slow s ASOF LEFT JOIN links l ON s.rank = l.rank AND s.ts_ns >= l.ts_ns""")


def _landed(s, d, table):
    """Call logs followed as a stream of a few files at a time."""
    root = scratch_path(s, "followed")
    lines = log_stream.follow_lines(s, _written_lines(s, d, None), 3)
    log_stream.land(lines, f"{root}/out", f"{root}/state").awaitTermination()
    return log_stream.landed(s, f"{root}/out", table)


add("s1_followed_logs", lambda s, d: _per_rank(_landed(s, d, "calls")), _PER_RANK)
add("s3_followed_refused", lambda s, d: _landed(s, d, "refused").select("value"),
    LINE_SQL + " SELECT value FROM call_lines WHERE k >= 93")
