"""Work that is done once: a parsing pass, a fitted table, a count of keys, a live tick."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fleetlens.catalog import fixtures as X
from fleetlens.functions.parsing import parse_calls, parse_links, parse_short_calls
from fleetlens.operators import rule_pass, sequences
from fleetlens.operators.rules import RULES, Clock
from fleetlens.streaming.rule_state import RuleProcessor

SF = "/root/testdata/sf0.001"


def test_a_line_meets_its_pattern_once(spark):
    """F7"""
    lines = spark.createDataFrame([("x",), (None,)], "value string")
    for parse in (parse_links, parse_calls, parse_short_calls):
        plan = parse(lines)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") == 1
        assert parse(lines).count() == 0


def test_regression_reads_its_table_of_lags(spark):
    """F8"""
    files = sequences.linear_forecast(X.call_sequences(spark, SF)).inputFiles()
    assert files and all("fleetlens-round" in f for f in files)


def test_bounds_of_the_rule_pass(spark):
    """F3"""
    rows = [("up", {"job": "ipmi-exporter", "instance": "i"}, t * 15_000_000, 0.0) for t in (0, 0, 1, 100)]
    samples = spark.createDataFrame(rows, "metric string, labels map<string,string>, us bigint, value double")
    met = rule_pass.met_samples(samples, RULES.values(), Clock())
    assert tuple(rule_pass.most_rows(met, Clock())) == (4, 80, 80)
    assert tuple(rule_pass.most_rows(met.where(F.lit(False)), Clock())) == (0, 0, 0)


def test_live_ticks_do_not_depend_on_where_they_are_cut():
    """all ticks of a stretch at once, and stretch by stretch"""
    clock, rng = Clock(), np.random.default_rng(3)
    n = 3000
    us = np.sort(rng.integers(0, n * 15_000_000, n))
    us[n // 2:] += 100 * 15_000_000  # a silence longer than the range
    value = np.cumsum(rng.integers(0, 9, n)).astype(float)
    rule = RULES["K8S_0101"]
    kept = pd.DataFrame({"side": "a", "member": "m", "us": us, "value": value})
    one = RuleProcessor(rule.vector.kind, rule.breach.test, clock.ticks(rule.hold_s), clock)
    end = int(us[-1]) // one.step + 1
    (whole, rates), _ = one._evaluate(kept, 0, end, None)
    assert len(whole) > 100
    run, due, ticks = None, 0, []
    for stop in [*range(7, end, 7), end]:
        now = kept[(kept["us"] >= (due - one.reach + 1) * one.step) & (kept["us"] < stop * one.step)]
        (some, _), run = one._evaluate(now, due, stop, run)
        ticks += list(some)
        due = stop
    assert ticks == list(whole)
    for tick, rate in list(zip(whole, rates))[::50]:
        seen = kept[(us >= (tick - one.reach + 1) * one.step) & (us < (tick + 1) * one.step)]
        t0, t1 = seen["us"].iloc[0] / 1e6, seen["us"].iloc[-1] / 1e6
        rise, span, stop = seen["value"].iloc[-1] - seen["value"].iloc[0], t1 - t0, (tick + 1) * 15
        gap = span / (len(seen) - 1)
        head, tail = t0 - (stop - 300), stop - t1
        head = min(gap / 2 if head >= gap * 1.1 else head, span * seen["value"].iloc[0] / rise)
        tail = gap / 2 if tail >= gap * 1.1 else tail
        assert np.isclose(rate, rise * (span + head + tail) / span / 300)
