"""Metric rules evaluated live: rates with counter resets, ratios, sums and averages by instance.

A processor per rule and series (per instance, where the rule averages over one) keeps the samples of the last
range and the run of breaching ticks.  An event-time timer evaluates a tick once the watermark has
passed its end, so out-of-order samples within the watermark's delay count; what the batch evaluation finds for
a tick is what is found here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.operators.rule_pass import RATES, SIDES
from fleetlens.operators.rules import Clock, Rule, _instance_series, series_key

OUT = "series STRING, tick BIGINT, value DOUBLE"
COLUMNS = ["side", "member", "us", "value"]
#: ticks whose samples are held at once
BUCKET = 1 << 12


def counter_rates(us: np.ndarray, value: np.ndarray, begin: np.ndarray, end: np.ndarray, range_s: int
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Per-second increase of a counter's samples in ranges from ``begin`` to ``end`` (without it), extrapolated to the
    ranges' ends, and which ranges have one."""
    i, j = np.searchsorted(us, begin), np.searchsorted(us, end) - 1  # first and last sample of each range
    has = j > i
    i, j = np.where(has, i, 0), np.where(has, j, 0)
    has &= us[i] != us[j]
    step = np.diff(value)
    step = np.append(np.where(step < 0, value[1:], step), 0.0)
    rise = np.where(has, np.add.reduceat(step, np.stack([i, j], 1).ravel())[::2], 0.0)
    t0, t1, stop = us[i] / 1e6, us[j] / 1e6, end / 1e6
    span = np.where(has, t1 - t0, 1.0)
    gap = span / np.maximum(j - i, 1)
    head, tail = t0 - (stop - range_s), stop - t1
    head = np.where(head >= gap * 1.1, gap / 2, head)
    zero = (rise > 0) & (value[i] >= 0)
    head = np.where(zero, np.minimum(head, span * value[i] / np.where(zero, rise, 1.0)), head)
    tail = np.where(tail >= gap * 1.1, gap / 2, tail)
    return rise * (span + head + tail) / span / range_s, has


def _last(us: np.ndarray, value: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Newest value of each range, and which ranges have one."""
    at = np.searchsorted(us, end) - 1
    has = (at >= 0) & (us[np.maximum(at, 0)] >= begin)
    return np.where(has, value[np.maximum(at, 0)], 0.0), has


def _samples(*columns) -> pd.DataFrame:
    side, member, us, value = map(list, columns) if columns else ([], [], [], [])
    return pd.DataFrame({"side": pd.Series(side, dtype=object), "member": pd.Series(member, dtype=object),
                         "us": pd.Series(us, dtype="int64"), "value": pd.Series(value, dtype="float64")})


def _lists(samples: pd.DataFrame) -> tuple:
    return (samples["side"].tolist(), samples["member"].tolist(), [int(x) for x in samples["us"]],
            [float(x) for x in samples["value"]])


def _frame(series, tick, value) -> pd.DataFrame:
    return pd.DataFrame({"series": pd.Series(series, dtype=object), "tick": pd.Series(tick, dtype="int64"),
                         "value": pd.Series(value, dtype="float64")})


class RuleProcessor(StatefulProcessor):
    """State: samples (side, series, time, value) that a later tick can need, the next tick to evaluate, and the
    first tick of the current run of breaches.

    New samples wait in buckets of ``bucket`` ticks, kept as map state, until the watermark comes; the ticks of a
    bucket are evaluated together, so time is linear in the samples and memory is bounded by a bucket.
    """

    def __init__(self, kind: str, test: tuple, hold: int, clock: Clock, bucket: int = BUCKET):
        self.kind, self.test, self.hold, self.bucket = kind, test, hold, bucket
        self.step, self.range_s = clock.step_s * 1_000_000, clock.range_s
        self.reach = clock.ticks(clock.range_s if kind in RATES else clock.lookback_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        arrays = "side ARRAY<STRING>, member ARRAY<STRING>, us ARRAY<BIGINT>, value ARRAY<DOUBLE>"
        self.kept = handle.getValueState("kept", f"{arrays}, due BIGINT, run BIGINT, parts BIGINT")
        self.waiting = handle.getMapState("waiting", "bucket BIGINT, part BIGINT", arrays)

    def _read(self) -> tuple[pd.DataFrame, int | None, int | None, int]:
        if not self.kept.exists():
            return _samples(), None, None, 0
        *columns, due, run, parts = self.kept.get()
        return _samples(*columns), due, run, parts

    def _write(self, kept: pd.DataFrame, due: int | None, run: int | None, parts: int) -> None:
        self.kept.update((*_lists(kept), due, run, parts))

    def handleInputRows(self, key, rows, timerValues):
        kept, due, run, parts = self._read()
        for chunk in rows:
            for bucket, part in chunk[COLUMNS].groupby(chunk["us"] // (self.step * self.bucket)):
                self.waiting.updateValue((int(bucket), parts), _lists(part))
                parts += 1
            first = int(chunk["us"].min()) // self.step
            if due is None or first < due:  # no tick from ``first`` on was evaluated: the watermark is behind it
                due = first
                self.handle.registerTimer((due + 1) * self.step // 1000)
        self._write(kept, due, run, parts)
        yield _frame([], [], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        kept, due, run, parts = self._read()
        passed = timerValues.getCurrentWatermarkInMs() * 1000 // self.step  # ticks below this one have ended
        held: dict[int, list[int]] = {}
        for bucket, part in self.waiting.keys():
            held.setdefault(int(bucket), []).append(int(part))
        ready = sorted(b for b in held if b * self.bucket < passed)
        starts = [b * self.bucket for b in ready[1:]] + [passed]
        if due is not None and due < passed:
            # what is kept from earlier buckets answers the ticks before the next bucket
            steps = [(None, min(passed, ready[0] * self.bucket) if ready else passed), *zip(ready, starts)]
            for bucket, end in steps:
                if bucket is not None:
                    names = [(bucket, part) for part in sorted(held[bucket])]
                    kept = pd.concat([kept, *(_samples(*self.waiting.getValue(n)) for n in names)], ignore_index=True)
                    kept = kept.sort_values("us", kind="stable")
                    for n in names:
                        self.waiting.removeKey(n)
                if end > due:
                    out, run = self._evaluate(kept, due, end, run)
                    due = end
                    yield _frame([key[0]] * len(out[0]), *out)
                    kept = kept[kept["us"] >= (due - self.reach + 1) * self.step]
            later = [b * self.bucket for b in held if b not in ready]
            if kept.empty:
                due, run = min(later, default=None), None
            elif int(kept["us"].iloc[0]) // self.step > due:  # nothing can be said before the next sample's tick
                due, run = int(kept["us"].iloc[0]) // self.step, None
        if due is not None:
            self.handle.registerTimer((due + 1) * self.step // 1000)
        self._write(kept, due, run, parts)
        yield _frame([], [], [])

    def _evaluate(self, kept: pd.DataFrame, due: int, end: int, run: int | None
                  ) -> tuple[tuple[np.ndarray, np.ndarray], int | None]:
        """Firing ticks of ``due`` to ``end`` (without it) with their values, and the run that goes on at ``end``."""
        own = np.unique(kept["us"].to_numpy(np.int64) // self.step)
        ticks = np.unique((own[:, None] + np.arange(self.reach)).ravel())  # the others have no sample in reach
        ticks = ticks[(ticks >= due) & (ticks < end)]
        if not len(ticks):
            return (ticks, np.zeros(0)), None
        value, known = self._values(kept, ticks)
        ok = known & self._breach(value)
        follows = np.concatenate([[run is not None and ticks[0] == due], ok[:-1] & (np.diff(ticks) == 1)])
        opened = np.where(follows, np.iinfo(np.int64).min, ticks)
        if follows[0]:
            opened[0] = run
        since = np.maximum.accumulate(opened)
        fires = ok & (ticks - since >= self.hold)
        goes_on = ok[-1] and ticks[-1] == end - 1
        return (ticks[fires], value[fires]), int(since[-1]) if goes_on else None

    def _values(self, kept: pd.DataFrame, ticks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value per tick, and where there is one."""
        none = np.zeros(len(ticks)), np.zeros(len(ticks), bool)
        begin, end = (ticks - self.reach + 1) * self.step, (ticks + 1) * self.step
        sides = {s: part for s, part in kept.groupby("side")}
        if self.kind not in RATES:
            last = [_last(part["us"].to_numpy(np.int64), part["value"].to_numpy(float), begin, end)
                    for s in SIDES if (part := sides.get(s)) is not None]
            if self.kind == "now":
                return last[0] if last else none
            if len(last) < 2:
                return none
            (a, has_a), (b, has_b) = last
            known = has_a & has_b & (b != 0)
            return (1 - a / np.where(known, b, 1.0)) * 100, known
        first = {s: none for s in SIDES}
        total, count = np.zeros(len(ticks)), np.zeros(len(ticks), np.int64)
        for (s, _), one in kept.groupby(["side", "member"]):
            rate, has = counter_rates(one["us"].to_numpy(np.int64), one["value"].to_numpy(float), begin, end, self.range_s)
            value, known = first[s]
            first[s] = np.where(known, value, rate), known | has
            if s == "a":
                total, count = total + np.where(has, rate, 0.0), count + has
        (a, has_a), (b, has_b) = (first[s] for s in SIDES)
        if self.kind == "cpu_pct":
            return 100 - total / np.maximum(count, 1) * 100, has_a
        return (a + b, has_a & has_b) if self.kind == "rate_sum" else (a, has_a)

    def _breach(self, value: np.ndarray) -> np.ndarray:
        sign, x, y = self.test
        if sign == "outside":
            return (value < x) | (value > y)
        return {">": np.greater, "=": np.equal, "<>": np.not_equal}[sign](value, x)

    def close(self) -> None:
        pass


def firing(samples: DataFrame, rule: Rule, clock: Clock = Clock(), delay: str = "0 seconds",
           bucket: int = BUCKET) -> DataFrame:
    """Ticks (with their value) at which a rule of any kind fires, as the watermark shows them.

    ``samples`` has metric, labels, us, value and the event time ``ts`` of ``us``.
    """
    labels, side = F.col("labels"), F.lit(None).cast("string")
    for name, (metric, equal, differ) in zip(SIDES, rule.vector.parts):
        fits = F.col("metric") == metric
        for key, value in equal.items():
            fits = fits & F.coalesce(labels[key] == value, F.lit(False))
        for key, value in differ:
            fits = fits & (F.coalesce(labels[key], F.lit("")) != value)
        side = F.when(fits, name).otherwise(side)
    member = series_key(labels)
    key = _instance_series(labels["instance"]) if rule.by_instance else member
    rows = samples.withWatermark("ts", delay).select(
        key.alias("series"), side.alias("side"), member.alias("member"), "us", "value", "ts").where("side IS NOT NULL")
    processor = RuleProcessor(rule.vector.kind, rule.breach.test, clock.ticks(rule.hold_s), clock, bucket)
    return rows.groupBy("series").transformWithStateInPandas(processor, OUT, "Append", "EventTime")
