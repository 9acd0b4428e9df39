"""Operators give the same rows whether their hot keys are cut or not."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetlens.catalog import fixtures as X
from fleetlens.operators import alerts, compare, heartbeat, links, outliers, sequences, timing

SF = "/root/testdata/sf0.001"
T = X.TOPOLOGY

CASES = {
    "pace": lambda s, f: timing.rank_pace(X.comm_ops(s, SF), f),
    "patterns": lambda s, f: timing.time_patterns(X.comm_ops(s, SF), f),
    "anomalies": lambda s, f: timing.interval_anomalies(X.comm_ops(s, SF), f),
    "missing": lambda s, f: timing.missing_calls(X.comm_ops(s, SF), row_floor=f),
    "sequences": lambda s, f: sequences.sequences(X.call_sequences(s, SF), f),
    "forecast": lambda s, f: sequences.island_gaps(X.call_sequences(s, SF), f).drop("island_no"),
    "judged": lambda s, f: outliers.judged_groups(X.comm_ops(s, SF).withColumn(
        "op_count", F.lit(1).cast("bigint")), T, f),
    "hash_totals": lambda s, f: compare.hash_rank_totals(X.comm_ops(s, SF).withColumn(
        "op_count", F.lit(1).cast("bigint")), row_floor=f),
    "bandwidth": lambda s, f: links.sliding_bandwidth(X.link_telemetry(s, SF), row_floor=f),
    "compact": lambda s, f: links.compact_sends(X.link_telemetry(s, SF), f),
    "lifecycle": lambda s, f: alerts.lifecycle(X.alert_polls(s, SF).withColumn(
        "fingerprint", F.lit("one")), row_floor=f),
    "recurrences": lambda s, f: alerts.history_recurrences(X.alert_store(s, SF).withColumn(
        "fingerprint", F.lit("one")), f),
    "silences": lambda s, f: heartbeat.silences(X.heartbeats(s, SF), row_floor=f),
}


@pytest.mark.parametrize("name", CASES)
def test_cut_equals_uncut(spark, name):
    def rows(floor):
        df = CASES[name](spark, floor)
        df = df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
        return sorted(map(str, df.collect()))
    assert rows(15) == rows(None)


def test_send_times_beyond_32_bits(spark, tmp_path):
    """A device with more sends than an INT holds times 5000."""
    n = 430_000
    spark.range(n).selectExpr("0L AS l_suppkey", "1.0D AS l_quantity", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS l_shipdate",
                              "id AS l_orderkey", "1 AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    last = X.link_telemetry(spark, str(tmp_path)).orderBy("rn").tail(1)[0]
    assert (last["rn"], last["t_ns"], last["func_times"]) == (n, n * 5000 + 100, n // 200)
