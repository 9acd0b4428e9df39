"""Sink queries: write a report below the shared folder, read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog import fixtures as X
from fleetlens.catalog.alerting import ROUTE_SQL, routed
from fleetlens.catalog.comparing import HASH_SQL
from fleetlens.catalog.fixtures import COMM_SQL, TOPOLOGY as T
from fleetlens.catalog.registry import add
from fleetlens.catalog.timing import GAP_SQL
from fleetlens.operators import compare, timing, topology
from fleetlens.plans.durable import scratch_path
from fleetlens.sources import sinks


def _report(s, d):
    path = scratch_path(s, "report")
    sinks.write_report(timing.time_patterns(X.comm_ops(s, d)), path, ("pattern_type",))
    return s.read.parquet(path).select("function", "rank", "stream", "call_count", "pattern_type")


add("k1_report_table", _report, GAP_SQL + """
SELECT function, rank, stream, gaps + 1 AS call_count, pattern_type FROM kind""")


def _matrix(s, d):
    path = scratch_path(s, "matrix")
    matrix = compare.slow_matrix_wide(X.comm_ops(s, d))
    sinks.write_matrix(matrix, path)
    return s.read.schema(matrix.schema).csv(path, header=True)


add("k2_matrix_csv", _matrix, HASH_SQL + " SELECT rank, " + ", ".join(
    f"max(CASE WHEN group_id = {i} THEN normalised END) AS g{i}" for i in range(1, 6))
    + " FROM matrix GROUP BY 1")


def _long_matrix(s, d):
    path = scratch_path(s, "long-matrix")
    matrix = compare.slow_matrix(X.comm_ops(s, d))
    sinks.write_matrix(matrix, path)
    return s.read.schema(matrix.schema).csv(path, header=True)


# a line per rank and group, for any number of communicators
add("k2_long_matrix_csv", _long_matrix, HASH_SQL + " SELECT rank, group_hash, group_id, slow_count, normalised FROM matrix")


def _topology(s, d):
    path = scratch_path(s, "topology")
    sinks.write_topology(topology.topology_table(X.comm_ops(s, d), T), path)
    return s.read.schema("rank INT, tp_group INT, pp_stage INT, dp_group INT, is_last_pp BOOLEAN").json(path)


add("k3_topology_json", _topology, COMM_SQL + """
SELECT DISTINCT rank, rank // 2 AS tp_group, rank // 4 AS pp_stage, (rank // 4) * 2 + rank % 2 AS dp_group,
 rank // 4 = 1 AS is_last_pp FROM comm_ops""")


def _outbox(s, d):
    path = scratch_path(s, "outbox")
    sinks.append_outbox(routed(s, d).select("channel", "fingerprint", "poll", "state"), path)
    return s.read.parquet(path).groupBy("channel", "state").agg(F.count(F.lit(1)).alias("notifications"))


add("k4_outbox", _outbox, ROUTE_SQL + """
SELECT channel, state, count(*) AS notifications FROM routed GROUP BY 1, 2""")
