"""Rates over several ticks, sample age, and holds against plain arithmetic."""

from __future__ import annotations

import random

import pytest

from fleetlens.operators import rules as R


def brute_rate(samples, end, span):
    """Rate at ``end`` over ``span`` seconds with resets and extrapolation to the range's ends."""
    inside = [(t, v) for t, v in samples if end - span <= t < end]
    if len(inside) < 2 or inside[0][0] == inside[-1][0]:
        return None
    rise = sum(b if b < a else b - a for (_, a), (_, b) in zip(inside, inside[1:]))
    first, last = inside[0], inside[-1]
    width = last[0] - first[0]
    mean = width / (len(inside) - 1)
    head, tail = first[0] - (end - span), end - last[0]
    head = mean / 2 if head >= 1.1 * mean else head
    if rise > 0 and first[1] >= 0:
        head = min(head, width * first[1] / rise)
    tail = mean / 2 if tail >= 1.1 * mean else tail
    return rise * (width + head + tail) / width / span


def frame(spark, rows, metric="c"):
    return spark.createDataFrame([(metric, {"instance": "i", "s": s}, int(t * 1e6), float(v))
                                  for s, t, v in rows],
                                 "metric STRING, labels MAP<STRING,STRING>, us BIGINT, value DOUBLE")


def test_rate_over_twenty_ticks(spark):
    rng = random.Random(3)
    rows, value = [], 0.0
    for i in range(120):
        if rng.random() < 0.2:
            continue  # lost scrape
        value = 1.0 if rng.random() < 0.04 else value + rng.random() * 5
        rows.append(("a", 3000 + 15 * i + rng.random() * 10, value))
    got = {r["tick"]: r["value"] for r in R.rate(frame(spark, rows), R.Clock(), "c").collect()}
    plain = [(t, v) for _, t, v in rows]
    plain = [(int(t * 1e6) / 1e6, v) for t, v in plain]
    last_tick = int(rows[-1][1] // 15)
    for tick in range(200, last_tick + 1):
        want = brute_rate(plain, (tick + 1) * 15, 300)
        if want is None:
            assert tick not in got
        else:
            assert got[tick] == pytest.approx(want), tick


def test_old_samples_stay_valid_for_the_lookback(spark):
    rows = [("a", 0.0, 1.0), ("a", 45.0, 2.0)]
    got = R.instant(frame(spark, rows), R.Clock(15, 300, 60), "c").orderBy("tick").collect()
    assert [(r["tick"], r["value"]) for r in got] == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 2.0), (4, 2.0),
                                                     (5, 2.0), (6, 2.0)]


def test_hold_needs_an_unbroken_run(spark):
    rule = R.RULES["GPU_0103"]  # one minute: four steps of 15 s after the first breach
    hot = [("a", 15 * i, 1) for i in range(5)] + [("b", 15 * i, 1 if i != 2 else 0) for i in range(5)]
    got = R.evaluate(rule, frame(spark, hot, rule.metrics[0]), R.Clock(15, 300, 15)).collect()
    assert [(r["start_tick"], r["fired_tick"], r["ticks"]) for r in got] == [(0, 4, 5)]
    assert got[0]["severity"] == "P1" and got[0]["alert_type"] == "HARD_WARE"


def test_twenty_rules():
    assert len(R.RULES) == 20


@pytest.mark.parametrize("row_floor", [None, 60])
def test_one_pass_equals_each_rule(spark, row_floor):
    """Rules of every kind on samples about 15 s apart: lost scrapes, resets, breaches of every length, other labels."""
    from fleetlens.operators.rule_pass import evaluate_all
    rng = random.Random(11)
    ids = ("GPU_0104", "NODE_0101", "NODE_0103", "NODE_0104", "K8S_0101", "K8S_0102", "IPMI_0101", "IPMI_0105")
    rules = [R.RULES[i] for i in (ids if row_floor is None else ids[1:4])]
    rows = []
    for metric in sorted({m for r in rules for m in r.metrics}):
        counter = metric.endswith("_total") and not metric.startswith("DCGM")
        sides = [part for r in R.RULES.values() for part in r.vector.parts if part[0] == metric]
        for instance in ("i1", "i2", None):
            for extra in [dict(p[1]) for p in sides] + [{"job": "other", "mode": "user", "phase": "Running"}, {"phase": "Failed"}]:
                labels, value = {"instance": instance, "metric": metric, **extra}, 0.0
                for i in range(90):
                    if rng.random() < 0.1:
                        continue
                    bad = i % 45 < rng.choice((2, 6, 30))
                    if counter:
                        value = 0.5 if rng.random() < 0.02 else value + (rng.random() * (20 if bad else 0.4))
                    else:
                        value = rng.choice((0.0, 90.0, 400.0)) if bad else rng.choice((1.0, 12.0, 300.0))
                    rows.append((metric, {k: v for k, v in labels.items() if k != "metric" and v is not None},
                                 int((3000 + 15 * i + rng.random() * 14) * 1e6), value))
    samples = spark.createDataFrame(rows, "metric STRING, labels MAP<STRING,STRING>, us BIGINT, value DOUBLE").cache()

    def shape(df):
        return sorted((r.id, r.series or "", r.ip or "", r.start_tick, r.fired_tick, r.end_tick, r.ticks, round(r.peak, 6), r.severity)
                      for r in df.collect())
    want = [x for rule in rules for x in shape(R.evaluate(rule, samples, R.Clock()))]
    got = shape(evaluate_all(samples, R.Clock(), rules, row_floor))
    assert got == sorted(want) and len({x[0] for x in got}) >= len(rules) - 2
    assert evaluate_all(samples.limit(0), R.Clock(), rules).count() == 0
