"""Samples of the rules in packs: odd rows, stretches, one pass."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import rule_pass
from fleetlens.operators import rules as R

SAMPLES = "metric STRING, labels MAP<STRING,STRING>, us BIGINT, value DOUBLE"
IDS = ("GPU_0103", "NODE_0101", "NODE_0103", "NODE_0104", "K8S_0101", "IPMI_0105")


def odd_samples(rng):
    """Samples that come twice, values and times that are null, labels in any order, none, or with null and odd text."""
    rows = []
    for metric in sorted({m for i in IDS for m in R.RULES[i].metrics}):
        for labels in ({"instance": "i1", "x": "a"}, {"instance": 'i"2\n', "x": "ü"}, {"instance": None}, {}, None):
            if labels is None and metric in (*R.NET, *R.DISK):
                continue  # rule by rule, a join of the two sides finds no series without labels
            if metric == "node_cpu_seconds_total" and labels is not None:
                labels = {**labels, "mode": "idle"}
            value = 0.0
            for i in range(130):
                bad, value = i % 65 < 40, 0.0 if rng.random() < 0.02 else value + rng.choice((0.0, 0.25, 12.0))
                counter = metric.endswith("_total") and not metric.startswith("DCGM")
                level = value if counter else 0.0 if bad else 300.0
                if metric == R.DISK[1]:
                    level = 300.0
                # rule by rule, a null behind a sample of a ratio or counter counts otherwise
                if rng.random() < 0.03 and not counter and metric not in R.DISK:
                    level = rng.choice((None, float("nan")))
                pairs = list((labels or {}).items())
                rng.shuffle(pairs)
                us = None if rng.random() < 0.01 else int((9000 + 15 * i + 400 * (i // 70) + rng.random() * 14) * 1e6)
                rows += [(metric, None if labels is None else dict(pairs), us, level)] * rng.choice((0, 1, 1, 1, 2))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("ticks", [None, 20, 37])
def test_odd_rows_in_stretches(spark, ticks):
    samples = spark.createDataFrame(odd_samples(random.Random(5)), SAMPLES).repartition(3).cache()
    rules = [R.RULES[i] for i in IDS]

    def shape(df):
        return sorted(str((r.id, r.series, r.ip, r.start_tick, r.fired_tick, r.end_tick, r.ticks, round(r.peak, 6), r.summary))
                      for r in df.collect())
    want = sorted(x for rule in rules for x in shape(R.evaluate(rule, samples)))
    got = shape(rule_pass.evaluate_all(samples, R.Clock(), rules, ticks))
    assert got == want and len({x.split(",")[0] for x in got}) == len(IDS)


def test_samples_are_read_once(spark):
    """a pass before counted them"""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(value):
        read.add(1)
        return value
    rows = [("up", {"job": "ipmi-exporter", "instance": "i"}, t * 15_000_000, 0.0) for t in range(50)]
    samples = spark.createDataFrame(rows, SAMPLES).withColumn("value", seen("value"))
    (run,) = rule_pass.evaluate_all(samples).collect()
    assert (run.id, run.ip, run.start_tick, run.ticks) == ("IPMI_0109", "i", 0, 69) and read.value == 50


def test_packs():
    """a row per label set and stretch is shuffled, not a row per sample"""
    def batch(us, metric):
        n = len(us)
        return pa.RecordBatch.from_pydict({"metric": [metric] * n, "labels": [f'{{"i":"{i % 2}"}}' for i in range(n)],
                                           "us": pa.array(us, pa.int64()), "value": pa.array([float(i) for i in range(n)])})
    pack = rule_pass._packer(10, 100, 20, frozenset(["gauge"]))
    us = np.arange(1980)  # ticks 0 to 197
    (out,) = pack(iter([batch(us[::-1], "counter"), batch(us, "gauge")]))
    packs = {}
    for r in out.to_pylist():
        packs.setdefault((r["metric"], r["labels"], r["stretch"]), []).append(r["samples"])
    assert out.num_rows == 16 and len(packs) == 12  # the third stretch has what it looks back at
    for (metric, _, stretch), some in packs.items():
        low, high = ((0, 99), (81, 197), (181, 197))[stretch]
        each = 1 if metric == "gauge" else 5
        assert list(rule_pass._Series(some, 10).tick) == [t for t in range(low, high + 1) for _ in range(each)]


def test_rates_equal_the_table_of_sides(spark):
    """The values of a stretch and ``side_values``, also where a counter begins again or is null"""
    rng, clock, value, rows = random.Random(8), R.Clock(), 0.0, []
    for i in range(200):
        value = 1.0 if rng.random() < 0.05 else value + rng.random()
        if rng.random() > 0.2:
            rows.append((R.RESTARTS, {"instance": "i"}, int((600 + 15 * i + rng.random() * 14) * 1e6), value if rng.random() > 0.05 else None))
    samples = spark.createDataFrame(rows, SAMPLES)
    met = rule_pass.met_samples(samples, [R.RULES["K8S_0101"]], clock)
    want = {r.tick: r.value for r in rule_pass.side_values(met, clock).collect()}
    one = rule_pass._Series([b"".join(np.array(c, t).tobytes() for c, t in (
        ([r[2] for r in rows], np.int64), ([r[3] or 0.0 for r in rows], float), ([r[3] is not None for r in rows], bool)))], 15_000_000)
    ticks = np.arange(min(want) - 3, max(want) + 30)
    rate, has = one.rate(ticks, clock.ticks(clock.range_s), clock)
    assert list(ticks[has]) == sorted(want) and np.allclose(rate[has], [want[t] for t in sorted(want)], atol=1e-9)
