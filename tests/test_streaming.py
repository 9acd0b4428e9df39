"""Streams over several micro-batches equal their batch twins."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from fleetlens.catalog import fixtures as X
from fleetlens.operators import alerts, heartbeat, links
from fleetlens.params import AlertLimits
from fleetlens.streaming import bandwidth, detectors, lifecycle, silence
from fleetlens.streaming.run import drain, drain_clock, parquet_stream

SF = "/root/testdata/sf0.001"


def split(df, order, folder, parts=4):
    """Write the rows as consecutive files, one micro-batch each."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = (high - low) / parts
    for i in range(parts):
        upper = F.lit(True) if i == parts - 1 else F.col(order) < low + (i + 1) * width
        piece = df.where((F.col(order) >= low + i * width) & upper)
        piece.coalesce(1).write.mode("append").parquet(folder)
    return folder


def same(a, b):
    assert a.columns == b.columns
    left, right = sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
    assert left == right and left


def test_lifecycle(spark, tmp_path):
    polls = X.alert_polls(spark, SF).select("fingerprint", "poll").cache()
    path = split(polls, "poll", f"{tmp_path}/polls")
    stream = parquet_stream(spark, path, 1)
    got = drain(lifecycle.live_states(stream, 3, 60), "t").distinct()
    same(got.select("fingerprint", "poll", "state"), alerts.lifecycle(polls))


def test_bandwidth(spark, tmp_path):
    sends = X.link_telemetry(spark, SF).cache()
    path = split(sends, "rn", f"{tmp_path}/sends")
    got = drain(bandwidth.live_bandwidth(parquet_stream(spark, path, 1)), "t")
    same(got, links.sliding_bandwidth(sends).select(*got.columns))


def test_flush_batches_close_with_the_watermark(spark, tmp_path):
    calls = X.comm_ops(spark, SF).select("rank", F.timestamp_micros(
        F.expr("ts_ns div 1000")).alias("ts")).cache()
    path = split(calls, "ts", f"{tmp_path}/calls")
    got = drain(detectors.flush_batches(parquet_stream(spark, path, 1), 600.0), "t")
    whole = detectors.flush_batches(calls, 600.0, None)
    last = calls.agg(F.unix_micros(F.max("ts"))).first()[0]
    same(got, whole.where(F.lit(last) - F.col("last_us") >= 600_000_000))


@pytest.mark.parametrize("limit", [300.0, 1200.0])
def test_silence_limits_are_exclusive(spark, tmp_path, limit):
    us = [0, int(limit * 1e6), int(2 * limit * 1e6) + 1, int(9 * limit * 1e6)]
    beats = spark.createDataFrame([("c", u + 1_000_000) for u in us], "client_id STRING, us BIGINT").select(
        "client_id", F.timestamp_micros("us").alias("ts"))
    beats.write.parquet(f"{tmp_path}/b")
    got = drain(detectors.offline_clients(parquet_stream(spark, f"{tmp_path}/b"), limit), "t")
    assert sorted(r["last_us"] - 1_000_000 for r in got.collect()) == us[1:3]


BEAT = "client_id STRING, us BIGINT"


def test_a_source_that_goes_quiet_is_reported(spark, tmp_path):
    """All clients stop at once and no file follows; a pause inside the data is reported, too."""
    now = int(time.time() * 1e6)
    ago = {"a": [60, 50, 20, 19, 18], "b": [18], "c": [40, 39, 38]}  # seconds before now
    beats = spark.createDataFrame([(c, now - int(s * 1e6)) for c, all_s in ago.items() for s in all_s] + [("d", None)], BEAT)
    rows = beats.select("client_id", F.timestamp_micros("us").alias("ts"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/b")
    limit = 20.0
    start = time.time()
    got = drain_clock(silence.silences(parquet_stream(spark, f"{tmp_path}/b", 1), ["client_id"], limit), "quiet",
                      done=lambda t: t.count() >= 4, limit_s=120)
    assert time.time() - start < 110
    want = [("a", 60, 50), ("a", 20, 18), ("b", 18, 18), ("c", 40, 38)]
    assert sorted(map(tuple, got.collect())) == sorted((c, now - a * 1_000_000, now - z * 1_000_000) for c, a, z in want)
    batch = heartbeat.silences(beats.where("us IS NOT NULL"), AlertLimits(heartbeat_timeout_s=20), as_of=now + 10**9)
    assert sorted((r.client_id, r.last_us) for r in batch.collect()) == sorted((r.client_id, r.last_us) for r in got.collect())


def test_silences_over_several_batches(spark, tmp_path):
    """Runs that go on in a later file, a return after a silence that was told, and late events."""
    second = 1_000_000
    files = [[("a", 10), ("a", 15), ("b", 10)], [("a", 18), ("b", 60)], [("a", 16), ("b", 5), ("b", 62), ("c", 70)]]
    for i, rows in enumerate(files):
        spark.createDataFrame([(c, t * second) for c, t in rows], BEAT).select(
            "client_id", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/b")
        time.sleep(1.1)  # the source takes files in the order of their times
    got = drain_clock(silence.silences(parquet_stream(spark, f"{tmp_path}/b", 1), ["client_id"], 20.0), "batches")
    rows = sorted((r.client_id, r.online_us // second, r.last_us // second) for r in got.collect())
    # by the clock all are long silent after every batch: each end is told once, whatever follows it
    assert rows == [("a", 10, 15), ("a", 10, 18), ("b", 10, 10), ("b", 60, 60), ("b", 60, 62), ("c", 70, 70)]
    assert len(set(rows)) == len(rows)


@pytest.mark.parametrize("rule_id", ["NODE_0101", "NODE_0104", "NODE_0102", "K8S_0102"])
def test_live_rules_equal_the_batch(spark, tmp_path, rule_id):
    """Rates with resets, sums, ratios and excluded labels over several micro-batches, with samples out of order."""
    import random

    from fleetlens.operators import rules as R
    from fleetlens.streaming.rule_state import firing
    rng, rule, clock, rows = random.Random(rule_id), R.RULES[rule_id], R.Clock(), []
    for metric, equal, _ in rule.vector.parts:
        for instance in ("i1", "i2"):
            for extra in ({}, {"cpu": "c1"}, {"mode": "user", "phase": "Running"}):
                value = 0.0
                for i in range(120):
                    bad, value = i % 60 < 40, 0.0 if rng.random() < 0.02 else value + rng.random() * (1 if rule_id == "NODE_0101" else 12)
                    if rng.random() < 0.1:
                        continue
                    level = value if metric.endswith("_total") else rng.choice((1.0, 2.0) if bad else (90.0, 100.0))
                    if rule_id == "NODE_0101" and not bad:
                        level = value = value + 15.0
                    if metric == R.MEMORY[1]:
                        level = 100.0
                    rows.append((metric, {"instance": instance, **equal, **extra}, int((30_000 + 15 * i + rng.random() * 14) * 1e6), level))
    rows.sort(key=lambda r: r[2])
    schema = "metric STRING, labels MAP<STRING,STRING>, us BIGINT, value DOUBLE"
    samples = spark.createDataFrame(rows, schema)
    for i in range(4):
        part = rows[i * len(rows) // 4:(i + 1) * len(rows) // 4]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/s")
        time.sleep(1.1)
    got = drain(firing(parquet_stream(spark, f"{tmp_path}/s", 1), rule, clock, "30 seconds"), "live")
    ended = (rows[-1][2] // 1000 - 30_000) // 15_000
    runs = R.evaluate(rule, samples, clock).select("series", F.explode(F.sequence("fired_tick", "end_tick")).alias("tick"))
    want = sorted((r.series, r.tick) for r in runs.where(F.col("tick") < ended).collect())
    assert sorted((r.series, r.tick) for r in got.collect()) == want and want


def test_large_batches_are_taken_bucket_by_bucket(spark, tmp_path):
    """Several chunks in any order of one device and one alert; buckets much smaller than the batch."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        sends = X.link_telemetry(spark, SF).where("nic = 'n1' AND dev = 1").cache()
        sends.repartition(3).write.parquet(f"{tmp_path}/sends")
        got = drain(bandwidth.live_bandwidth(parquet_stream(spark, f"{tmp_path}/sends"), bucket=64), "t")
        same(got, links.sliding_bandwidth(sends).select(*got.columns))
        polls = spark.range(0, 900).where("id % 7 < 4 OR id % 100 < 20").select(
            F.lit("f").alias("fingerprint"), F.col("id").alias("poll"))
        polls.union(polls).repartition(3).write.parquet(f"{tmp_path}/polls")
        got = drain(lifecycle.live_states(parquet_stream(spark, f"{tmp_path}/polls"), 3, 60, bucket=64), "t")
        same(got.select("fingerprint", "poll", "state"), alerts.lifecycle(polls))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
