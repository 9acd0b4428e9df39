"""All metric rules in one pass over the samples.

The samples of a label set are packed first, a stretch of ``SPAN`` ticks in a row, where they are read.  The rules are a
small table that every pack meets by a broadcast join on its metric, so samples are shuffled once, as packs, whatever
the number of rules.  A value needs no sample older than the range or the lookback: packs take along what the next
stretch needs of them, and a task evaluates a stretch of a rule's series (of an instance, where the rule averages
over one) by itself: both sides of a ratio or sum, or all series of the instance.  Runs of breaching ticks that touch an
end of their stretch are joined to their neighbours; runs that last longer than the rule's hold fire.
Results equal ``rules.evaluate`` rule by rule.

``side_values`` is the same evaluation up to the values of every side, as a table for inspection.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.numbers import div
from fleetlens.operators.rules import RULES, Clock, Rule, _instance_series, series_key
from fleetlens.plans.ordered import OrderedGroups

RATES = ("rate", "rate_sum", "cpu_pct")
SIDES = ("a", "b")
SERIES = ["rule_id", "side", "series"]
#: ticks of a series that are evaluated at once
SPAN = 1 << 13
#: samples that a task packs at once
HELD = 1 << 19
PACK = "metric STRING, labels STRING, stretch BIGINT, samples BINARY"
RUN = "rule_id STRING, series STRING, ip STRING, stretch BIGINT, start_tick BIGINT, end_tick BIGINT, ticks BIGINT, peak DOUBLE"


def rule_sides(spark: SparkSession, rules: Iterable[Rule], clock: Clock) -> DataFrame:
    """A row per rule and side of its expression."""
    rows = []
    for rule in rules:
        sign, x, y = rule.breach.test
        for side, (metric, equal, differ) in zip(SIDES, rule.vector.parts):
            rows.append((rule.rule_id, side, metric, equal, [list(d) for d in differ], rule.vector.kind, rule.by_instance, sign,
                         x, y, clock.ticks(rule.hold_s)))
    return spark.createDataFrame(rows, "rule_id string, side string, metric string, equal map<string,string>,"
                                 " differ array<array<string>>, kind string, by_instance boolean, sign string,"
                                 " x double, y double, hold int")


def _label(key: Column) -> Column:
    return F.coalesce(F.try_element_at("labels", key), F.lit(""))


def _rate_value(clock: Clock) -> Column:
    """Per-second increase over the range, extrapolated to its ends."""
    n, rise, v0 = F.col("range_n"), F.col("range_rise"), F.col("f.v0")
    end = (F.col("tick") + 1) * clock.step_s
    t0, t1 = F.col("f.t0") / 1e6, F.col("t1") / 1e6
    span, head, tail = t1 - t0, t0 - (end - clock.range_s), end - t1
    gap = span / F.nullif(n - 1, F.lit(0))
    head = F.when(head >= gap * 1.1, gap / 2).otherwise(head)
    zero = F.when((rise > 0) & (v0 >= 0), span * v0 / F.nullif(rise, F.lit(0.0)))
    tail = F.when(tail >= gap * 1.1, gap / 2).otherwise(tail)
    value = rise * (span + F.least(head, F.coalesce(zero, head)) + tail) / F.nullif(span, F.lit(0.0)) / clock.range_s
    return F.when((n >= 2) & (F.col("t1") > F.col("f.t0")), value)


def _met(rows: DataFrame, rules: Iterable[Rule], clock: Clock) -> DataFrame:
    """Rows with ``metric`` and ``labels`` beside the rules and sides that they count for."""
    sides = rule_sides(rows.sparkSession, rules, clock)
    # most rules have no matcher, and a lambda is slow
    equal = (F.size("equal") == 0) | F.forall(F.map_entries("equal"), lambda e: _label(e["key"]) == e["value"])
    differ = (F.size("differ") == 0) | F.forall("differ", lambda d: _label(d[0]) != d[1])
    # a row per rule and side
    return rows.join(F.broadcast(sides), "metric").where(equal & differ).withColumns(
        {"series": series_key(F.col("labels")), "instance": F.col("labels")["instance"]})


def met_samples(samples: DataFrame, rules: Iterable[Rule], clock: Clock) -> DataFrame:
    """Samples with the rules and sides that they count for."""
    return _met(samples, rules, clock).select(
        *SERIES, "instance", "kind", "us", "value", div(F.col("us"), clock.step_s * 1_000_000).alias("tick"))


def _output_series() -> Column:
    return F.when(F.col("kind") == "cpu_pct", _instance_series(F.col("instance"))).otherwise(F.col("series"))


def most_rows(met: DataFrame, clock: Clock) -> Row:
    """What no key has more of, from one pass: ``samples`` and ``grid`` rows of a side's series, and ``output`` rows of a
    rule's series.  A sample answers ``reach`` ticks at most, and a series' ticks lie between its first and its last."""
    reach = max(clock.ticks(clock.range_s), clock.ticks(clock.lookback_s))

    def ticks(n, first, last):
        return F.least(n * reach, last - first + reach)  # least leaves nulls out
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    sizes = met.groupBy(*SERIES, _output_series().alias("_out")).agg(
        F.count(F.lit(1)).alias("n"), F.min("tick").alias("lo"), F.max("tick").alias("hi"))
    per = sizes.groupBy("rule_id", "_out").agg(
        F.max("n").alias("samples"), F.max(ticks(n, lo, hi)).alias("grid"),
        ticks(F.sum("n"), F.min("lo"), F.max("hi")).alias("output"))
    return per.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("samples", "grid", "output")]).first()


def side_values(met: DataFrame, clock: Clock, row_floor: int | None = None, most: Row | None = None) -> DataFrame:
    """``rule_id, side, series, instance, kind, tick, value`` of every side of every rule on the tick grid."""
    ticks = clock.ticks(clock.range_s)
    most = most_rows(met, clock) if most is None else most
    groups = OrderedGroups(met, SERIES, ["us"], halo=1, row_floor=row_floor, most=most["samples"])
    w = groups.window()
    before, from_tick = F.lag("value").over(w), F.lag("tick").over(w)
    rise = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    steps = groups.trim(groups.rows().withColumns({"_rise": F.coalesce(rise, F.lit(0.0)), "_from": from_tick}))
    inside = F.col("_from").eqNullSafe(F.col("tick"))
    buckets = steps.groupBy(*SERIES, "tick").agg(
        F.first("kind").alias("kind"), F.max("instance").alias("instance"), F.max_by("value", "us").alias("value"),
        F.count(F.lit(1)).alias("n"), F.min("us").alias("t0"), F.max("us").alias("t1"), F.min_by("value", "us").alias("v0"),
        F.sum(F.when(inside, F.col("_rise")).otherwise(0.0)).alias("own"), F.sum("_rise").alias("rise"))
    sums = OrderedGroups(buckets, SERIES, ["tick"], row_floor=row_floor, like=groups)
    rows = sums.trim(sums.rows(), keep_piece=True)
    rows = sums.running(sums.running(rows, F.col("n"), "cn", "sum"), F.col("rise"), "cr", "sum")
    buckets = sums.finish(rows)
    # a bucket also answers the ticks behind it, until the next one or its reach
    is_rate = F.col("kind").isin(*RATES)
    reach = F.when(is_rate, clock.ticks(clock.range_s)).otherwise(clock.ticks(clock.lookback_s))
    back = OrderedGroups(buckets.withColumn("_back", -F.col("tick")), SERIES, ["_back"], halo=1, row_floor=row_floor, like=groups)
    rows = back.trim(back.rows().withColumn("_next", F.lag("tick").over(back.window())))
    last = F.least(F.col("tick") + reach - 1, F.col("_next") - 1)  # least leaves nulls out
    dense = (rows.withColumn("_at", F.explode(F.sequence("tick", last))).withColumn("_own", F.col("_at") == F.col("tick"))
             .withColumnRenamed("tick", "_bucket").withColumnRenamed("_at", "tick").drop("_back", "_next"))
    grid = OrderedGroups(dense, SERIES, ["tick"], halo=ticks, row_floor=row_floor, most=most["grid"])
    first = F.min(F.when(F.col("_own") & is_rate, F.struct("tick", "t0", "v0", "n", "own", "cn", "cr"))).over(
        grid.window().rangeBetween(-(ticks - 1), 0))
    dense = grid.trim(grid.rows().withColumn("f", first)).withColumns({
        "range_n": F.col("cn") - F.col("f.cn") + F.col("f.n"), "range_rise": F.col("cr") - F.col("f.cr") + F.col("f.own")})
    return dense.select(*SERIES, "instance", "kind", "tick",
                        F.when(is_rate, _rate_value(clock)).otherwise(F.col("value")).alias("value")).where("value IS NOT NULL")


def _label_sets(metric: pa.Array, labels: pa.Array) -> tuple[np.ndarray, list[tuple]]:
    """The number of each row's metric and labels, and these by number."""
    metric, labels = metric.dictionary_encode(), labels.dictionary_encode()
    names, texts = metric.dictionary.to_pylist(), [*labels.dictionary.to_pylist(), None]
    code = metric.indices.to_numpy().astype(np.int64) * len(texts) + labels.indices.fill_null(len(texts) - 1).to_numpy()
    known, code = np.unique(code, return_inverse=True)
    return code, [(names[c // len(texts)], texts[c % len(texts)]) for c in known.tolist()]


def _packer(step: int, span: int, reach: int, newest: frozenset[str]):
    """Batches of samples as packs.  Of the metrics ``newest`` only the newest sample of a tick counts."""
    kind = pa.schema([("metric", pa.string()), ("labels", pa.string()), ("stretch", pa.int64()), ("samples", pa.binary())])

    def packs(names: dict, parts: list) -> pa.RecordBatch:
        name, us, value, valid = map(np.concatenate, zip(*parts))
        order = np.argsort(name.astype(np.int16) if len(names) < 1 << 15 else name, kind="stable")
        name, us = name[order], us[order]
        if ((us[1:] < us[:-1]) & (name[1:] == name[:-1])).any():
            again = np.lexsort((us, name))
            name, us, order = name[again], us[again], order[again]
        tick = _ticks(us, step)
        few = np.array([metric in newest for metric, _ in names])[name]
        keep = np.append(~few[:-1] | (name[1:] != name[:-1]) | (tick[1:] != tick[:-1]), True)
        name, us, tick, order = name[keep], us[keep], tick[keep], order[keep]
        value, valid, stretch = value[order], valid[order], tick // span
        starts = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (stretch[1:] != stretch[:-1])))
        rows, sets = [], list(names)
        for a, z in zip(starts, [*starts[1:], len(us)]):
            at = int(stretch[a])
            # what the first ticks of the next stretch look back at
            late = a + np.searchsorted(tick[a:z], (at + 1) * span - reach + 1)
            for start, place in ((a, at), (late, at + 1)):
                if start < z:
                    rows.append((*sets[name[a]], place, us[start:z].tobytes() + value[start:z].tobytes() + valid[start:z].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts, held = {}, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            code, sets = _label_sets(batch.column("metric"), batch.column("labels"))
            numbers = np.array([names.setdefault(s, len(names)) for s in sets], np.int64)
            value = batch.column("value")
            parts.append((numbers[code], batch.column("us").to_numpy(), value.fill_null(0.0).to_numpy(),
                          value.is_valid().to_numpy(zero_copy_only=False)))
            held += batch.num_rows
            if held >= HELD:
                yield packs(names, parts)
                names, parts, held = {}, [], 0
        if held:
            yield packs(names, parts)
    return pack


def _ticks(us: np.ndarray, step: int) -> np.ndarray:
    """``us div step`` as SQL has it."""
    return np.where(us < 0, -(-us // step), us // step)


class _Series:
    """Samples of a series in order, from its packs."""

    def __init__(self, packs: list[bytes], step: int):
        counts = [len(p) // 17 for p in packs]
        us, value, valid = (np.concatenate([np.frombuffer(p, kind, n, offset * n) for p, n in zip(packs, counts)])
                            for kind, offset in ((np.int64, 0), (np.float64, 8), (bool, 16)))
        if (us[1:] <= us[:-1]).any():
            order = np.lexsort((value, valid, us))
            us, value, valid = us[order], value[order], valid[order]
        self.us, self.value, self.valid, self.tick = us, value, valid, _ticks(us, step)

    def now(self, ticks: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """The newest value at each tick, while not too old, and where there is one."""
        at = np.searchsorted(self.tick, ticks, "right") - 1
        has = at >= 0
        at = np.maximum(at, 0)
        return self.value[at], has & (self.tick[at] > ticks - reach) & self.valid[at]

    def rate(self, ticks: np.ndarray, reach: int, clock: Clock) -> tuple[np.ndarray, np.ndarray]:
        """Per-second increase over the range, extrapolated to its ends, and where there is one."""
        us, value, valid = self.us, self.value, self.valid
        first, last = np.searchsorted(self.tick, ticks - reach + 1), np.searchsorted(self.tick, ticks, "right") - 1
        has = last > first
        first, last = np.where(has, first, 0), np.where(has, last, 0)
        has &= us[last] > us[first]
        before, after = value[:-1], value[1:]
        # NaN is above all numbers
        step = np.where((after < before) | (np.isnan(before) & ~np.isnan(after)), after, after - before)
        step = np.append(np.where(valid[:-1] & valid[1:], step, 0.0), 0.0)
        rise = np.add.reduceat(step, np.stack([first, last], 1).ravel())[::2]
        end = (ticks + 1) * clock.step_s
        t0, t1, v0 = us[first] / 1e6, us[last] / 1e6, value[first]
        span = np.where(has, t1 - t0, 1.0)
        head, tail, gap = t0 - (end - clock.range_s), end - t1, span / np.maximum(last - first, 1)
        head = np.where(head >= gap * 1.1, gap / 2, head)
        zero = valid[first] & ((rise > 0) | np.isnan(rise)) & ((v0 >= 0) | np.isnan(v0))
        head = np.where(zero, np.fmin(head, span * v0 / np.where(zero, rise, 1.0)), head)
        tail = np.where(tail >= gap * 1.1, gap / 2, tail)
        return rise * (span + head + tail) / span / clock.range_s, has


def _evaluator(rules: Iterable[Rule], clock: Clock, span: int):
    """Runs of breaching ticks of a rule's series in a stretch; the stretch is null where a run touches its ends."""
    known_rules = {r.rule_id: (r.vector.kind, r.breach.test, clock.ticks(r.hold_s)) for r in rules}
    step, kinds = clock.step_s * 1_000_000, (pa.int64(), pa.int64(), pa.int64(), pa.float64())

    def values(kind, sides, ticks):
        reach = clock.ticks(clock.range_s if kind in RATES else clock.lookback_s)
        found = {name: [one.rate(ticks, reach, clock) if kind in RATES else one.now(ticks, reach) for one in some]
                 for name, some in sides.items()}
        if kind == "cpu_pct":
            count = sum(has.astype(np.int64) for _, has in found["a"])
            total = sum(np.where(has, rate, 0.0) for rate, has in found["a"])
            return 100 - total / np.maximum(count, 1) * 100, count > 0
        (a, has_a), = found["a"]
        if kind in ("now", "rate"):
            return a, has_a
        (b, has_b), = found["b"]
        if kind == "rate_sum":
            return a + b, has_a & has_b
        has = has_a & has_b & (b != 0)
        return (1 - a / np.where(has, b, 1.0)) * 100, has

    def evaluate(key, table):
        rule_id, series, stretch = (k.as_py() for k in key)
        kind, (sign, x, y), hold = known_rules[rule_id]
        packs, sides = {}, {}
        for side, one, data in zip(*(table.column(c).to_pylist() for c in ("side", "series", "samples"))):
            packs.setdefault((side, one), []).append(data)
        for side, one in sorted(packs, key=lambda name: (name[0], name[1] or "")):
            sides.setdefault(side, []).append(_Series(packs[side, one], step))
        low, high = stretch * span, (stretch + 1) * span
        every = [one.tick for some in sides.values() for one in some]
        reach = clock.ticks(clock.range_s if kind in RATES else clock.lookback_s)
        ticks = np.arange(max(low, min(t[0] for t in every)), min(high, max(t[-1] for t in every) + reach))
        if not len(ticks) or len(sides) < (2 if kind in ("used_pct", "rate_sum") else 1):
            columns = [pa.array([], t) for t in (pa.int64(), *kinds)]
        else:
            with np.errstate(all="ignore"):
                value, known = values(kind, sides, ticks)
                nan = np.isnan(value)
                breach = known & {">": (value > x) | nan, "=": value == x, "<>": value != x,
                                  "outside": (value < x) | (value > y) | nan if y is not None else nan}[sign]
            starts, ends = np.flatnonzero(np.diff(np.concatenate([[0], breach.astype(np.int8), [0]]))).reshape(-1, 2).T
            peak = np.maximum.reduceat(np.append(value, 0.0), np.stack([starts, ends], 1).ravel())[::2] if len(starts) else np.zeros(0)
            first, last = ticks[starts], ticks[ends - 1]
            open_ = (first == low) | (last == high - 1)
            keep = open_ | (ends - starts > hold)
            columns = [pa.array(np.full(keep.sum(), stretch), mask=open_[keep]),
                       *(pa.array(c[keep], t) for c, t in zip((first, last, ends - starts, peak), kinds))]
        ip = max((i for i in table.column("instance").to_pylist() if i is not None), default=None)
        n = len(columns[0])
        return pa.Table.from_arrays([pa.array([v] * n, pa.string()) for v in (rule_id, series, ip)] + columns,
                                    ["rule_id", "series", "ip", "stretch", "start_tick", "end_tick", "ticks", "peak"])
    return evaluate


def evaluate_all(samples: DataFrame, clock: Clock = Clock(), rules: Iterable[Rule] | None = None,
                 row_floor: int | None = None) -> DataFrame:
    """Firing runs of all rules with their labels, as ``rules.evaluate`` gives them for each.

    ``row_floor`` is the number of ticks that are evaluated at once.
    """
    rules = list(RULES.values() if rules is None else rules)
    spark = samples.sparkSession
    reach = max(clock.ticks(clock.range_s), clock.ticks(clock.lookback_s))
    span = max(SPAN if row_floor is None else row_floor, reach)
    metrics = {m for r in rules for m in r.metrics}
    newest = metrics - {m for r in rules if r.vector.kind in RATES for m in r.metrics}
    # labels travel as text, which takes half the time of a map
    packs = samples.where(F.col("metric").isin(*metrics) & F.col("us").isNotNull()).select(
        "metric", F.to_json("labels").alias("labels"), "us", F.col("value").cast("double").alias("value")).mapInArrow(
        _packer(clock.step_s * 1_000_000, span, reach, frozenset(newest)), PACK)
    met = _met(packs.withColumn("labels", F.from_json("labels", "map<string,string>")), rules, clock).select("rule_id", "side", "series", "instance", _output_series().alias("out"), "stretch", "samples")
    runs = met.groupBy("rule_id", "out", "stretch").applyInArrow(_evaluator(rules, clock, span), RUN)
    # two open runs a stretch at most; the others follow no run
    w = Window.partitionBy("rule_id", "series", "stretch").orderBy("start_tick")
    before = F.lag("end_tick").over(w)
    runs = runs.withColumn("_new", F.when(before.isNull() | (before != F.col("start_tick") - 1), F.col("start_tick")))
    runs = runs.withColumn("_run", F.max("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    names = spark.createDataFrame([(r.rule_id, r.alert, r.severity, r.alert_type, clock.ticks(r.hold_s)) for r in rules],
                                  "rule_id string, alertname string, severity string, alert_type string, hold int")
    fired = runs.groupBy("rule_id", "series", "stretch", F.col("_run").alias("start_tick")).agg(
        F.max("end_tick").alias("end_tick"), F.sum("ticks").alias("ticks"), F.max("peak").alias("peak"), F.max("ip").alias("ip"))
    # a row per rule
    return fired.join(F.broadcast(names), "rule_id").where(F.col("ticks") >= F.col("hold") + 1).select(
        F.col("rule_id").alias("id"), "alertname", "severity", "alert_type", "series", "ip", "start_tick",
        (F.col("start_tick") + F.col("hold")).alias("fired_tick"), "end_tick", "ticks", "peak",
        F.format_string("%s %s: %.3f", "alertname", "ip", "peak").alias("summary"))
