"""All twenty rules in one pass at the production step of 15 s, over samples with planted breaches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.catalog.fixtures import EVENTS_SQL, METRICS, _events
from fleetlens.catalog.registry import add
from fleetlens.operators import rules as R
from fleetlens.operators.rule_pass import evaluate_all
from fleetlens.plans.durable import cut_lineage, scratch_path
from fleetlens.streaming.rule_state import firing
from fleetlens.streaming.run import drain, parquet_stream

CLOCK = R.Clock()
STEP_US = CLOCK.step_s * 1_000_000
RANGE = CLOCK.ticks(CLOCK.range_s)

# Sixteen events make a tick.  An instance breaches for 24 ticks (longer than 300 s), 3 (30 s) and 6 (60 s) of
# every 64, each at its own time; ``bad`` says so, ``nbad`` counts such ticks so far.  Text that both dialects read.
_TICK = "CAST(floor(event_id / 16) AS BIGINT)"
_PHASE = f"(({_TICK} + 7 * (user_id % 8)) % 64)"
_BAD = f"({_PHASE} < 24 OR ({_PHASE} >= 32 AND {_PHASE} < 35) OR ({_PHASE} >= 40 AND {_PHASE} < 46))"
_NBAD = (f"(CAST(floor(({_TICK} + 7 * (user_id % 8)) / 64) AS BIGINT) * 33 + CASE WHEN {_PHASE} < 24 THEN {_PHASE} + 1"
         f" WHEN {_PHASE} < 32 THEN 24 WHEN {_PHASE} < 35 THEN {_PHASE} - 7 WHEN {_PHASE} < 40 THEN 27"
         f" WHEN {_PHASE} < 46 THEN {_PHASE} - 12 ELSE 33 END)")
_US = f"(1704067200000000 + {_TICK} * {STEP_US} + k * 140000 + (event_id % 16) * 1000)"


def _either(bad, good):
    return f"CASE WHEN {_BAD} THEN {bad} ELSE {good} END"


VALUES = {
    "DCGM_FI_DEV_GPU_TEMP": _either("86 + k % 5", "60 + k % 20"), "DCGM_FI_DEV_POWER_USAGE": _either("310 + k", "200 + k"),
    "DCGM_FI_DEV_ECC_DBE_VOL_TOTAL": _either("1 + k % 3", "0"), "up": _either("0", "1"),
    "node_cpu_seconds_total": f"15.0 * {_TICK} - 13.0 * {_NBAD}",
    "node_memory_MemAvailable_bytes": _either("40 + k % 9", "300 + k"), "node_memory_MemTotal_bytes": "500",
    "node_filesystem_avail_bytes": _either("30 + k % 9", "200 + k"), "node_filesystem_size_bytes": "400 + k",
    "node_network_receive_errs_total": f"1.5 * {_NBAD}", "node_network_transmit_errs_total": f"1.2 * {_NBAD}",
    "kube_pod_container_status_restarts_total": f"(3 * {_NBAD}) % 40", "kube_pod_status_phase": _either("1", "0"),
    "kube_node_status_condition": _either("1", "0"), "ipmi_sensor_state": _either("2", "1"),
    "ipmi_sensor_temperature_celsius": _either("76 + k % 9", "40 + k % 9"), "ipmi_sensor_fan_speed_rpm": _either("0", "900 + k"),
    "ipmi_sensor_power_state": _either("0", "1"), "ipmi_sensor_voltage_volts": _either("11 + 2 * (k % 2)", "12"),
    "ipmi_sensor_memory_ecc_errors": _either("4", "0"), "ipmi_sensor_disk_state": _either("3", "1"),
    "ipmi_sensor_network_interface_state": _either("0", "1"),
}


def _labels(metric):
    return {"instance": "concat('i', user_id % 8)", **METRICS[metric][1]}


def _planted_text(text):
    """The same text over the columns that ``planted_samples`` computes once per event."""
    return text.replace(_NBAD, "_nbad").replace(_BAD, "_bad").replace(_TICK, "_tick")


def planted_samples(s, d, *metrics):
    """(metric, labels, us, value): every event is a sample of every metric, or of those named."""
    # written once, as each metric reads them; one expression for all metrics is too large to be compiled
    events = cut_lineage(_events(s, d).select("event_id", "user_id", "k"))
    marked = events.select("*", *[F.expr(text).alias(name) for name, text in (("_tick", _TICK), ("_bad", _BAD), ("_nbad", _NBAD))])

    def samples(metric):
        pairs = [c for k, v in _labels(metric).items() for c in (F.lit(k), F.expr(v))]
        return marked.select(F.lit(metric).alias("metric"), F.create_map(*pairs).alias("labels"),
                             F.expr(_planted_text(_US)).alias("us"), F.expr(_planted_text(VALUES[metric])).cast("double").alias("value"))
    return reduce(DataFrame.unionByName, [samples(metric) for metric in metrics or VALUES])


def _source_sql(name, metric, equal, differ):
    """Samples of one side; labels are matched before they become text."""
    labels = _labels(metric)
    text = " || ',' || ".join(f"'\"{k}\":\"' || ({v}) || '\"'" for k, v in sorted(labels.items()))
    where = [f"({labels[k]}) = '{v}'" for k, v in equal.items()] + [f"({labels[k]}) <> '{v}'" for k, v in differ]
    return (f"{name}s AS MATERIALIZED (SELECT '{{' || {text} || '}}' AS series, concat('i', user_id % 8) AS instance, {_US} AS us,"
            f" {_US} // {STEP_US} AS tick, CAST({VALUES[metric]} AS DOUBLE) AS value FROM e WHERE {' AND '.join(where) or 'true'})")


def _grid_sql(name, columns):
    return f"""
{name}g AS MATERIALIZED (SELECT series, instance, {columns}, unnest(generate_series(tick, least(tick + {RANGE - 1},
 coalesce(nxt - 1, tick + {RANGE - 1})))) AS tick FROM (SELECT *, lead(tick) OVER (PARTITION BY series ORDER BY tick) AS nxt
 FROM {name}b))"""


def _side_sql(name, rate):
    if not rate:
        return f""", {name}b AS MATERIALIZED (SELECT series, any_value(instance) AS instance, tick, arg_max(value, us) AS value
 FROM {name}s GROUP BY series, tick), {_grid_sql(name, 'value')},
{name} AS (SELECT series, instance, tick, value FROM {name}g)"""
    return f""", {name}d AS (SELECT *, lag(value) OVER o AS b, lag(tick) OVER o AS bt FROM {name}s
 WINDOW o AS (PARTITION BY series ORDER BY us)),
{name}b AS MATERIALIZED (SELECT series, any_value(instance) AS instance, tick, count(*) AS n, min(us) AS t0, max(us) AS t1,
 arg_min(value, us) AS v0, sum(CASE WHEN b IS NULL THEN 0 WHEN value < b THEN value ELSE value - b END) AS rise,
 sum(CASE WHEN bt IS NULL OR bt <> tick THEN 0 WHEN value < b THEN value ELSE value - b END) AS own FROM {name}d GROUP BY series, tick),
{_grid_sql(name, 'n')},
{name}r AS (SELECT g.series, any_value(g.instance) AS instance, g.tick, sum(b.n) AS n, min(b.t0) / 1e6 AS t0, max(b.t1) / 1e6 AS t1,
 arg_min(b.v0, b.tick) AS v0, sum(b.rise) - arg_min(b.rise, b.tick) + arg_min(b.own, b.tick) AS rise
 FROM {name}g g JOIN {name}b b ON b.series = g.series AND b.tick BETWEEN g.tick - {RANGE - 1} AND g.tick GROUP BY g.series, g.tick),
{name}x AS (SELECT *, t1 - t0 AS span, (t1 - t0) / (n - 1) AS mg, t0 - ((tick + 1) * {CLOCK.step_s} - {CLOCK.range_s}) AS a,
 (tick + 1) * {CLOCK.step_s} - t1 AS z FROM {name}r WHERE n >= 2 AND t1 > t0),
{name} AS (SELECT series, instance, tick, rise * (span + least(CASE WHEN a >= mg * 1.1 THEN mg / 2 ELSE a END,
  CASE WHEN rise > 0 AND v0 >= 0 THEN span * v0 / rise ELSE a END)
 + CASE WHEN z >= mg * 1.1 THEN mg / 2 ELSE z END) / span / {CLOCK.range_s} AS value FROM {name}x)"""


_VALUE = {
    "now": "SELECT * FROM {a}", "rate": "SELECT * FROM {a}",
    "used_pct": "SELECT series, {a}.instance, tick, (1 - {a}.value / {b}.value) * 100 AS value FROM {a} JOIN {b} USING (series, tick)",
    "rate_sum": "SELECT series, {a}.instance, tick, {a}.value + {b}.value AS value FROM {a} JOIN {b} USING (series, tick)",
    "cpu_pct": "SELECT '{{\"instance\":\"' || instance || '\"}}' AS series, instance, tick, 100 - avg(value) * 100 AS value"
               " FROM {a} GROUP BY instance, tick",
}


def _rule_sql(rule):
    """Tables of one rule: its values ``v`` per tick, and its firing runs ``h``."""
    name, kind, out = rule.rule_id.lower() + "_", rule.vector.kind, []
    sign, x, y = rule.breach.test
    for side, part in zip("ab", rule.vector.parts):
        out.append(_source_sql(name + side, *part) + _side_sql(name + side, kind in ("rate", "rate_sum", "cpu_pct")))
    breach = f"value < {x} OR value > {y}" if sign == "outside" else f"value {sign} {x}"
    out.append(f"{name}v AS ({_VALUE[kind].format(a=name + 'a', b=name + 'b')})")
    out.append(f"{name}h AS (SELECT series, min(tick) AS start_tick, max(tick) AS end_tick, count(*) AS ticks, max(value) AS"
               f" peak, max(instance) AS ip FROM (SELECT *, tick - row_number() OVER (PARTITION BY series ORDER BY tick) AS isl"
               f" FROM {name}v WHERE {breach}) GROUP BY series, isl HAVING count(*) >= {CLOCK.ticks(rule.hold_s) + 1})")
    return name, out


def _rules_sql():
    out, last = [EVENTS_SQL], []
    for rule in R.RULES.values():
        name, tables = _rule_sql(rule)
        out += tables
        last.append(f"SELECT '{rule.rule_id}' AS id, '{rule.alert}' AS alertname, '{rule.severity}' AS severity,"
                    f" '{rule.alert_type}' AS alert_type, series, ip, start_tick, start_tick + {CLOCK.ticks(rule.hold_s)} AS"
                    f" fired_tick, end_tick, ticks, round(peak + 1e-9, 6) AS peak FROM {name}h")
    return ",\n".join(out) + "\n" + "\nUNION ALL ".join(last)


add("rules_one_pass", lambda s, d: evaluate_all(planted_samples(s, d), CLOCK).drop("summary"), _rules_sql())


def _live(rule):
    def query(s, d):
        path = scratch_path(s, "samples")
        planted_samples(s, d, *rule.metrics).withColumn("ts", F.timestamp_micros("us")).write.parquet(path)
        return drain(firing(parquet_stream(s, path), rule, CLOCK), "firing")
    return query


def _live_sql(rule):
    """Ticks of the firing runs that the watermark, the newest sample in milliseconds, has passed."""
    name, tables = _rule_sql(rule)
    newest = ", ".join(f"(SELECT max(us) FROM {name}{side}s)" for side, _ in zip("ab", rule.vector.parts))
    return ",\n".join([EVENTS_SQL, *tables]) + f"""
SELECT h.series, v.tick, round(v.value + 1e-9, 6) AS value FROM {name}h h JOIN {name}v v ON v.series = h.series
 AND v.tick BETWEEN h.start_tick + {CLOCK.ticks(rule.hold_s)} AND h.end_tick
WHERE (v.tick + 1) * {STEP_US // 1000} <= greatest({newest}) // 1000"""


for _id in ("NODE_0101", "NODE_0103", "K8S_0101"):
    add(f"x4_live_{_id.lower()}", _live(R.RULES[_id]), _live_sql(R.RULES[_id]))
