"""The twenty metric alert rules as DataFrame jobs.

Samples are (metric, labels MAP<STRING,STRING>, us BIGINT, value DOUBLE).  An expression becomes one
value per (series, tick); a rule fires where the value breaches without a break for its hold time.
Ticks are numbers ``floor(us / step)``, so holds are gaps-and-islands on integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import div
from fleetlens.plans.ordered import OrderedGroups


@dataclass(frozen=True)
class Clock:
    """Evaluation step, rate range and how long an old sample stays valid (seconds)."""

    step_s: int = 15
    range_s: int = 300
    lookback_s: int = 300

    def ticks(self, seconds: float) -> int:
        return max(1, math.ceil(seconds / self.step_s))


def series_key(labels: Column) -> Column:
    """Canonical text of a label set."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(labels))))


def select_samples(samples: DataFrame, clock: Clock, metric: str, equal: dict | None = None,
                   differ: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Samples of one metric under label matchers, with series key, instance and tick."""
    out = samples.where(F.col("metric") == metric)
    for key, value in (equal or {}).items():
        out = out.where(F.col("labels")[key] == value)
    for key, value in differ:
        # a missing label counts as the empty string
        out = out.where(F.coalesce(F.col("labels")[key], F.lit("")) != value)
    return out.select(series_key(F.col("labels")).alias("series"),
                      F.col("labels")["instance"].alias("instance"), "us", "value",
                      div(F.col("us"), clock.step_s * 1_000_000)
                      .alias("tick"))


def _fill(buckets: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Dense grid: a bucket also answers the following ticks until the next one, at most reach."""
    if reach <= 1:
        return buckets.withColumn("age", F.lit(0))
    groups = OrderedGroups(buckets.withColumn("_back", -F.col("tick")), keys, ["_back"], halo=1)
    # walking backwards, the lag is the next bucket in time
    rows = groups.trim(groups.rows().withColumn("_next", F.lag("tick").over(groups.window())))
    last = F.least(F.col("tick") + (reach - 1), F.coalesce(F.col("_next") - 1,
                                                          F.col("tick") + (reach - 1)))
    return (rows.withColumn("_at", F.explode(F.sequence("tick", last)))
            .withColumn("age", F.col("_at") - F.col("tick"))
            .drop("tick", "_next", "_back").withColumnRenamed("_at", "tick"))


def instant(samples: DataFrame, clock: Clock, metric: str, equal: dict | None = None,
            differ: tuple = ()) -> DataFrame:
    """(series, instance, tick, value): newest sample at each tick, while not too old."""
    rows = select_samples(samples, clock, metric, equal, differ)
    last = rows.groupBy("series", "instance", "tick").agg(F.max_by("value", "us").alias("value"))
    return _fill(last, ["series"], clock.ticks(clock.lookback_s)).drop("age")


def instant_pair(samples: DataFrame, clock: Clock, left: str, right: str) -> DataFrame:
    """Two metrics of equal labels side by side: one grouped pass instead of a join."""
    both = samples.where(F.col("metric").isin(left, right))
    rows = both.select(
        series_key(F.col("labels")).alias("series"), F.col("labels")["instance"].alias("instance"),
        "metric", "us", "value",
        div(F.col("us"), clock.step_s * 1_000_000).alias("tick"))

    def newest(metric):
        mine = F.col("metric") == metric
        return F.max_by(F.when(mine, F.col("value")), F.when(mine, F.col("us")))
    wide = rows.groupBy("series", "instance", "tick").agg(newest(left).alias("a"),
                                                          newest(right).alias("b"))
    reach = clock.ticks(clock.lookback_s)
    if reach <= 1:
        return wide.where("a IS NOT NULL AND b IS NOT NULL")
    sides = [_fill(wide.where(f"{c} IS NOT NULL").select("series", "instance", "tick", c),
                   ["series"], reach).drop("age") for c in ("a", "b")]
    return sides[0].join(sides[1].drop("instance"), ["series", "tick"])  # instance may be null


def rate(samples: DataFrame, clock: Clock, metric: str, equal: dict | None = None,
         differ: tuple = ()) -> DataFrame:
    """Per-second rate over the range with counter resets and extrapolation to the range's ends.

    Increases are taken per sample, folded per tick first (map-side combined), then summed over
    the ticks of the range; the step into the first tick of a range lies outside it.
    """
    rows = select_samples(samples, clock, metric, equal, differ)
    groups = OrderedGroups(rows, ["series"], ["us"], halo=1)
    w = groups.window()
    before, at = F.lag("value").over(w), F.lag("tick").over(w)
    rise = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    steps = groups.trim(groups.rows().withColumns({"_rise": rise, "_from": at}))
    inside = F.col("_from") == F.col("tick")
    buckets = steps.groupBy("series", "instance", "tick").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("t0"), F.max("us").alias("t1"),
        F.min_by("value", "us").alias("v0"),
        F.sum(F.when(inside, F.col("_rise")).otherwise(0.0)).alias("own"),
        F.sum(F.when(~inside, F.col("_rise")).otherwise(0.0)).alias("entry"))
    reach = clock.ticks(clock.range_s)
    dense = _fill(buckets, ["series"], reach)
    if reach > 1:
        grid = OrderedGroups(dense, ["series"], ["tick"], halo=reach)
        frame = grid.window().rowsBetween(-(reach - 1), 0)
        real = F.col("age") == 0
        low = F.col("tick") - (reach - 1)
        dense = grid.rows().withColumn("_all", F.collect_list(F.when(real, F.struct(
            "tick", "n", "t0", "t1", "v0", "own", "entry"))).over(frame))
        dense = grid.trim(dense).withColumn("_in", F.filter("_all", lambda b: b["tick"] >= low))

        def total(name):
            return F.aggregate("_in", F.lit(0.0), lambda acc, b: acc + b[name])
        dense = dense.where(F.size("_in") > 0).select(
            "series", "instance", "tick", total("n").alias("n"), F.col("_in")[0]["t0"].alias("t0"),
            F.element_at("_in", -1)["t1"].alias("t1"), F.col("_in")[0]["v0"].alias("v0"),
            (total("own") + total("entry") - F.col("_in")[0]["entry"]).alias("rise"))
    else:
        dense = dense.withColumn("rise", F.col("own"))
    end = (F.col("tick") + 1) * clock.step_s
    begin = end - clock.range_s
    t0, t1 = F.col("t0") / 1e6, F.col("t1") / 1e6
    span = t1 - t0
    mean_gap = span / F.nullif(F.col("n") - 1, F.lit(0))
    to_start = F.when(t0 - begin >= mean_gap * 1.1, mean_gap / 2).otherwise(t0 - begin)
    to_zero = F.when((F.col("rise") > 0) & (F.col("v0") >= 0), span * F.col("v0") / F.nullif(F.col("rise"), F.lit(0.0)))
    to_start = F.least(to_start, F.coalesce(to_zero, to_start))
    to_end = F.when(end - t1 >= mean_gap * 1.1, mean_gap / 2).otherwise(end - t1)
    value = F.col("rise") * (span + to_start + to_end) / F.nullif(span, F.lit(0.0)) / clock.range_s
    return (dense.where((F.col("n") >= 2) & (F.col("t1") > F.col("t0")))
            .select("series", "instance", "tick", value.alias("value")))


def _instance_series(instance: Column) -> Column:
    return F.to_json(F.create_map(F.lit("instance"), instance))


def average_by_instance(vector: DataFrame) -> DataFrame:
    return (vector.groupBy("instance", "tick").agg(F.avg("value").alias("value"))
            .select(_instance_series(F.col("instance")).alias("series"),
                    "instance", "tick", "value"))


def match_vectors(left: DataFrame, right: DataFrame, how: Callable[[Column, Column], Column]
                  ) -> DataFrame:
    """One-to-one arithmetic on series with equal labels at the same tick."""
    theirs = right.select("series", "tick", F.col("value").alias("_r"))  # instance may be null
    return (left.withColumnRenamed("value", "_l").join(theirs, ["series", "tick"])
            .select("series", "instance", "tick", how(F.col("_l"), F.col("_r")).alias("value")))


def held(breaches: DataFrame, hold_ticks: int, row_floor: int | None = None,
         sizes_from: DataFrame | None = None) -> DataFrame:
    """Unbroken runs of breaching ticks per series that outlast the hold."""
    groups = OrderedGroups(breaches, ["series"], ["tick"], halo=1, row_floor=row_floor,
                           sizes_from=sizes_from)
    before = F.lag("tick").over(groups.window())
    rows = groups.trim(groups.rows().withColumn(
        "_new", before.isNull() | (before != F.col("tick") - 1)), keep_piece=True)
    rows = groups.finish(groups.running(rows, F.when(F.col("_new"), F.col("tick")), "start_tick"))
    return (rows.groupBy("series", "start_tick")
            .agg(F.max("tick").alias("end_tick"), F.count(F.lit(1)).alias("ticks"),
                 F.max("value").alias("peak"), F.max("instance").alias("ip"))
            .where(F.col("ticks") >= hold_ticks + 1)
            .withColumn("fired_tick", F.col("start_tick") + hold_ticks))


# ---- the rules ----------------------------------------------------------------------------

Vector = Callable[[DataFrame, Clock], DataFrame]
Test = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    alert: str
    hold_s: int
    severity: str
    metrics: tuple[str, ...]
    vector: Vector = field(repr=False)
    breach: Test = field(repr=False)
    by_instance: bool = False

    @property
    def alert_type(self) -> str:
        return "HARD_WARE" if self.rule_id.startswith(("GPU", "IPMI")) else "SOFT_WARE"


def _now(metric, equal=None, differ=()):
    def vector(s, c):
        return instant(s, c, metric, equal, differ)
    # what a live evaluation needs to know of a bare threshold; other vectors do not have it
    vector.selects = (metric, dict(equal or {}), tuple(differ))
    return _described(vector, "now", (metric, equal, differ))


def _described(vector, kind, *parts):
    """What the evaluation of all rules in one pass needs to know: the kind of the vector, and of each of its
    sides the metric with the labels that must and must not be equal."""
    vector.kind = kind
    vector.parts = tuple((metric, dict(equal or {}), tuple(differ)) for metric, equal, differ in parts)
    return vector


def _rate(metric, equal=None):
    return _described(lambda s, c: rate(s, c, metric, equal), "rate", (metric, equal, ()))


def _used_pct(free, total):
    def vector(s, c):
        return instant_pair(s, c, free, total).where("b <> 0").select(
            "series", "instance", "tick", ((1 - F.col("a") / F.nullif(F.col("b"), F.lit(0.0))) * 100).alias("value"))
    return _described(vector, "used_pct", (free, None, ()), (total, None, ()))


def _cpu_pct(s, c):
    idle = average_by_instance(rate(s, c, "node_cpu_seconds_total", {"mode": "idle"}))
    return idle.withColumn("value", 100 - F.col("value") * 100)


def _net_errors(s, c):
    return match_vectors(rate(s, c, "node_network_receive_errs_total"),
                         rate(s, c, "node_network_transmit_errs_total"), lambda a, b: a + b)


_described(_cpu_pct, "cpu_pct", ("node_cpu_seconds_total", {"mode": "idle"}, ()))
_described(_net_errors, "rate_sum", ("node_network_receive_errs_total", None, ()),
           ("node_network_transmit_errs_total", None, ()))


def _test(breach, sign, x, y=None):
    breach.test = (sign, float(x), None if y is None else float(y))
    return breach


def above(x):
    return _test(lambda v: v > x, ">", x)


def equals(x):
    return _test(lambda v: v == x, "=", x)


def differs(x):
    return _test(lambda v: v != x, "<>", x)


def outside(low, high):
    return _test(lambda v: (v < low) | (v > high), "outside", low, high)


def _simple(rule_id, alert, hold_s, severity, metric, breach, equal=None, differ=()):
    return Rule(rule_id, alert, hold_s, severity, (metric,), _now(metric, equal, differ), breach)


MEMORY = ("node_memory_MemAvailable_bytes", "node_memory_MemTotal_bytes")
DISK = ("node_filesystem_avail_bytes", "node_filesystem_size_bytes")
NET = ("node_network_receive_errs_total", "node_network_transmit_errs_total")
RESTARTS = "kube_pod_container_status_restarts_total"
PHASES = (("phase", "Running"), ("phase", "Succeeded"))

# Identifiers, names, holds, severities, metrics and thresholds of the rules
RULES: dict[str, Rule] = {r.rule_id: r for r in (
    _simple("GPU_0101", "GPUTemperatureHigh", 300, "P1", "DCGM_FI_DEV_GPU_TEMP", above(85)),
    _simple("GPU_0102", "GPUPowerHigh", 300, "P2", "DCGM_FI_DEV_POWER_USAGE", above(300)),
    _simple("GPU_0103", "GPUECCError", 60, "P1", "DCGM_FI_DEV_ECC_DBE_VOL_TOTAL", above(0)),
    _simple("GPU_0104", "GPUDown", 60, "P1", "up", equals(0), {"job": "nvidia-gpu-exporter"}),
    Rule("NODE_0101", "NodeCPUHigh", 300, "P2", ("node_cpu_seconds_total",), _cpu_pct, above(80),
         by_instance=True),
    Rule("NODE_0102", "NodeMemoryHigh", 300, "P2", MEMORY, _used_pct(*MEMORY), above(85)),
    Rule("NODE_0103", "NodeDiskHigh", 300, "P2", DISK, _used_pct(*DISK), above(85)),
    Rule("NODE_0104", "NodeNetworkErrorHigh", 300, "P2", NET, _net_errors, above(0.1)),
    Rule("K8S_0101", "PodRestartHigh", 300, "P2", (RESTARTS,), _rate(RESTARTS), above(0.1)),
    _simple("K8S_0102", "PodStatusAbnormal", 300, "P2", "kube_pod_status_phase", above(0),
            differ=PHASES),
    _simple("K8S_0103", "NodeStatusAbnormal", 300, "P1", "kube_node_status_condition", above(0),
            {"condition": "Ready", "status": "false"}),
    _simple("IPMI_0101", "IPMISensorStatus", 30, "P1", "ipmi_sensor_state", differs(1)),
    _simple("IPMI_0102", "IPMITemperatureHigh", 300, "P1", "ipmi_sensor_temperature_celsius",
            above(75)),
    _simple("IPMI_0103", "IPMIFanFailure", 60, "P1", "ipmi_sensor_fan_speed_rpm", equals(0)),
    _simple("IPMI_0104", "IPMIPowerFailure", 60, "P1", "ipmi_sensor_power_state", differs(1)),
    _simple("IPMI_0105", "IPMIVoltageAbnormal", 300, "P2", "ipmi_sensor_voltage_volts",
            outside(11.5, 12.5)),
    _simple("IPMI_0106", "IPMIMemoryError", 60, "P1", "ipmi_sensor_memory_ecc_errors", above(0)),
    _simple("IPMI_0107", "IPMIDiskFailure", 60, "P1", "ipmi_sensor_disk_state", differs(1)),
    _simple("IPMI_0108", "IPMINetworkInterfaceFailure", 60, "P2",
            "ipmi_sensor_network_interface_state", differs(1)),
    _simple("IPMI_0109", "IPMIBMCDown", 60, "P1", "up", equals(0), {"job": "ipmi-exporter"}),
)}


def evaluate(rule: Rule, samples: DataFrame, clock: Clock = Clock()) -> DataFrame:
    """Firing runs of one rule with its labels."""
    breaches = rule.vector(samples, clock).where(rule.breach(F.col("value")))
    mine = samples.where(F.col("metric").isin(*rule.metrics))
    key = (_instance_series(F.col("labels")["instance"]) if rule.by_instance
           else series_key(F.col("labels")))
    return held(breaches, clock.ticks(rule.hold_s), sizes_from=mine.select(key.alias("series"))).select(
        F.lit(rule.rule_id).alias("id"), F.lit(rule.alert).alias("alertname"),
        F.lit(rule.severity).alias("severity"), F.lit(rule.alert_type).alias("alert_type"),
        "series", "ip", "start_tick", "fired_tick", "end_tick", "ticks", "peak",
        F.format_string("%s %s: %.3f", F.lit(rule.alert), F.col("ip"), F.col("peak"))
        .alias("summary"))
