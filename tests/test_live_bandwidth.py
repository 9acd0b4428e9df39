"""Sends of a device in buckets: windows inside them and across their ends."""

from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.operators import links
from fleetlens.streaming import bandwidth
from fleetlens.streaming.run import drain, parquet_stream

SENDS = "nic STRING, dev INT, size BIGINT, func_times BIGINT, t_ns BIGINT, rn BIGINT"


def some_sends(rng, n):
    """Numbers with gaps of every length, sends without size or time, and changes of function numbers."""
    rows, rn, t = [], 0, 1_700_000_000_000_000_001
    for i in range(n):
        rn += rng.choice((1, 1, 1, 2, 40, 300))
        t += rng.choice((0, 1000, 7001))
        rows.append((rn, None if rng.random() < 0.02 else rng.randrange(1, 10**6), None if rng.random() < 0.01 else i // 90,
                     None if rng.random() < 0.02 else t))
    return [("n" if n % 2 else None, 1, size, ft, t_ns, rn) for rn, size, ft, t_ns in rows]


@pytest.mark.parametrize("window,bucket", [(50, 64), (50, 100_000), (3, 7), (1, 5)])
def test_buckets_equal_the_batch(spark, tmp_path, window, bucket):
    """F1: also over several micro-batches and with nulls, where the last sends could not be kept before."""
    rng = random.Random(window * bucket)
    rows = some_sends(rng, 701) + some_sends(rng, 400)
    path = f"{tmp_path}/sends"
    for low, high in ((0, 3), (3, 20_000), (20_000, 10**9)):
        part = [r for r in rows if low <= r[-1] < high]
        rng.shuffle(part)
        spark.createDataFrame(part, SENDS).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # the source takes files in the order of their times
    got = drain(bandwidth.live_bandwidth(parquet_stream(spark, path, 1), window, bucket), "t")
    want = links.sliding_bandwidth(spark.createDataFrame(rows, SENDS), window).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and (window == 1 or got.count() > 50)


def test_a_bucket_sends_its_ends_to_the_device():
    """all sends of a device went through its state before"""
    key = pa.scalar("n"), pa.scalar(1, pa.int32()), pa.scalar(0, pa.int64())
    rn = np.random.default_rng(1).permutation(5000)
    table = pa.table({"rn": rn, "func_times": rn // 200, "size": rn, "t_ns": rn * 10})
    (row,) = bandwidth._edges(50)(key, table).to_pylist()
    sends = bandwidth.Sends.unpacked(row["sends"])
    assert list(sends.values[0]) == [*range(49), *range(4951, 5000)] and sends.valid.all()
    inside = bandwidth._rates_inside(50)(key, table)
    assert inside.num_rows == 25 * 151 and inside.column("rn")[0].as_py() == 49
