"""Metric rule queries: the building blocks on event ticks, then the twenty rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog import fixtures as X
from fleetlens.catalog.fixtures import METRIC_SQL, rule_samples, samples_sql
from fleetlens.catalog.registry import add
from fleetlens.operators import rules as R

CLOCK = R.Clock(step_s=300, range_s=300, lookback_s=300)


def _instant_sql(i: int, where: str = "true", name: str = "v") -> str:
    return (f", {name} AS (SELECT series, any_value(instance) AS instance, tick, arg_max(value, us)"
            f" AS value FROM s{i} WHERE {where} GROUP BY series, tick)")


def _rate_sql(i: int, where: str = "true", name: str = "v") -> str:
    """Rate over one tick, with resets and extrapolation."""
    return f""", {name}_d AS (SELECT *, lag(value) OVER o AS b, lag(tick) OVER o AS bt FROM s{i} WHERE {where}
 WINDOW o AS (PARTITION BY series ORDER BY us)),
{name}_b AS (SELECT series, any_value(instance) AS instance, tick, count(*) AS n, min(us) / 1e6 AS t0,
 max(us) / 1e6 AS t1, arg_min(value, us) AS v0, sum(CASE WHEN bt = tick THEN CASE WHEN value < b THEN value
 ELSE value - b END ELSE 0 END) AS rise FROM {name}_d GROUP BY series, tick),
{name}_x AS (SELECT *, t1 - t0 AS span, (t1 - t0) / (n - 1) AS mg, t0 - tick * 300 AS a, (tick + 1) * 300 - t1 AS z
 FROM {name}_b WHERE n >= 2 AND t1 > t0),
{name} AS (SELECT series, instance, tick, rise * (span
 + least(CASE WHEN a >= mg * 1.1 THEN mg / 2 ELSE a END,
   CASE WHEN rise > 0 AND v0 >= 0 THEN span * v0 / rise ELSE a END)
 + CASE WHEN z >= mg * 1.1 THEN mg / 2 ELSE z END) / span / 300 AS value FROM {name}_x)"""


def _held_sql(breach: str, hold: int, source: str = "v") -> str:
    return f""", br AS (SELECT series, instance, tick, value,
 tick - row_number() OVER (PARTITION BY series ORDER BY tick) AS isl FROM {source} WHERE {breach}),
held AS (SELECT series, min(tick) AS start_tick, max(tick) AS end_tick, count(*) AS ticks,
 max(value) AS peak, max(instance) AS ip, min(tick) + {hold} AS fired_tick FROM br GROUP BY series, isl
 HAVING count(*) >= {hold} + 1)"""


# ---- building blocks ----------------------------------------------------------------------

TEMP, IDLE, RESTARTS = "DCGM_FI_DEV_GPU_TEMP", "node_cpu_seconds_total", R.RESTARTS

add("m1_threshold", lambda s, d: R.instant(rule_samples(s, d, TEMP), CLOCK, TEMP).where("value > 85"),
    samples_sql(TEMP) + _instant_sql(0) + """
SELECT series, instance, tick, round(value + 1e-9, 6) AS value FROM v WHERE value > 85""")

add("m2_rate", lambda s, d: R.rate(rule_samples(s, d, RESTARTS), CLOCK, RESTARTS),
    samples_sql(RESTARTS) + _rate_sql(0) + """
SELECT series, instance, tick, round(value + 1e-9, 6) AS value FROM v""")

_AVG = """, av AS (SELECT '{"instance":"' || instance || '"}' AS series, instance, tick,
 avg(value) AS value FROM v GROUP BY instance, tick)"""
add("m3_average_by_instance", lambda s, d: R.average_by_instance(R.rate(
    rule_samples(s, d, IDLE), CLOCK, IDLE, {"mode": "idle"})),
    samples_sql(IDLE) + _rate_sql(0, "l_mode = 'idle'") + _AVG + """
SELECT series, instance, tick, round(value + 1e-9, 6) AS value FROM av""")

_PAIR = """, v AS (SELECT series, any_value(instance) AS instance, tick, (1 - arg_max(a, ua) / arg_max(b, ub))
 * 100 AS value FROM (SELECT series, instance, tick, value AS a, us AS ua, NULL AS b, NULL AS ub FROM s0
 UNION ALL SELECT series, instance, tick, NULL, NULL, value, us FROM s1) GROUP BY series, tick
 HAVING count(a) > 0 AND count(b) > 0)"""
add("m4_ratio", lambda s, d: R.RULES["NODE_0103"].vector(rule_samples(s, d, *R.DISK), CLOCK),
    samples_sql(*R.DISK) + _PAIR + """
SELECT series, instance, tick, round(value + 1e-9, 6) AS value FROM v""")

add("j6_vector_sum", lambda s, d: R.RULES["NODE_0104"].vector(rule_samples(s, d, *R.NET), CLOCK),
    samples_sql(*R.NET) + _rate_sql(0, name="p") + _rate_sql(1, name="q") + """
SELECT p.series, p.instance, p.tick, round(p.value + q.value + 1e-9, 6) AS value FROM p JOIN q USING (series, tick)""")


def _tick_averages(s, d):
    return X.metric_samples(s, d).groupBy(
        F.col("instance").cast("string").alias("series"), F.col("instance").cast("string").alias("instance"),
        "tick").agg(F.avg("value").alias("value"))


add("m5_held_breaches", lambda s, d: R.held(_tick_averages(s, d).where("value > 60"), 1), METRIC_SQL + """
, v AS (SELECT CAST(instance AS VARCHAR) AS series, CAST(instance AS VARCHAR) AS instance, tick,
 avg(value) AS value FROM metric_samples GROUP BY 1, 2, 3)""" + _held_sql("value > 60", 1) + """
SELECT series, start_tick, end_tick, ticks, round(peak + 1e-9, 6) AS peak, ip, fired_tick FROM held""")

VOLT = "ipmi_sensor_voltage_volts"
add("m6_either_bound", lambda s, d: R.instant(rule_samples(s, d, VOLT), CLOCK, VOLT).where(
    (F.col("value") < 11.5) | (F.col("value") > 12.5)), samples_sql(VOLT) + _instant_sql(0) + """
SELECT series, instance, tick, round(value + 1e-9, 6) AS value FROM v WHERE value < 11.5 OR value > 12.5""")

add("m7_labelled_alerts", lambda s, d: R.evaluate(
    R.RULES["GPU_0102"], rule_samples(s, d, "DCGM_FI_DEV_POWER_USAGE"), CLOCK).select(
        "id", "alertname", "severity", "alert_type", "ip", "start_tick", "series"),
    samples_sql("DCGM_FI_DEV_POWER_USAGE") + _instant_sql(0) + _held_sql("value > 300", 1) + """
SELECT 'GPU_0102' AS id, 'GPUPowerHigh' AS alertname, 'P2' AS severity, 'HARD_WARE' AS alert_type, ip,
 start_tick, series FROM held""")

# ---- the rules ----------------------------------------------------------------------------

_DIFF = "l_phase <> 'Running' AND l_phase <> 'Succeeded'"
_BREACH = {
    "GPU_0101": "value > 85", "GPU_0102": "value > 300", "GPU_0103": "value > 0",
    "GPU_0104": "value = 0", "NODE_0101": "value > 80", "NODE_0102": "value > 85",
    "NODE_0103": "value > 85", "NODE_0104": "value > 0.1", "K8S_0101": "value > 0.1",
    "K8S_0102": "value > 0", "K8S_0103": "value > 0", "IPMI_0101": "value <> 1",
    "IPMI_0102": "value > 75", "IPMI_0103": "value = 0", "IPMI_0104": "value <> 1",
    "IPMI_0105": "value < 11.5 OR value > 12.5", "IPMI_0106": "value > 0", "IPMI_0107": "value <> 1",
    "IPMI_0108": "value <> 1", "IPMI_0109": "value = 0",
}
_VECTOR = {
    "GPU_0104": _instant_sql(0, "l_job = 'nvidia-gpu-exporter'"),
    "IPMI_0109": _instant_sql(0, "l_job = 'ipmi-exporter'"),
    "K8S_0102": _instant_sql(0, _DIFF),
    "K8S_0103": _instant_sql(0, "l_condition = 'Ready' AND l_status = 'false'"),
    "NODE_0101": _rate_sql(0, "l_mode = 'idle'") + _AVG
    + ", c AS (SELECT series, instance, tick, 100 - value * 100 AS value FROM av)",
    "NODE_0102": _PAIR, "NODE_0103": _PAIR,
    "NODE_0104": _rate_sql(0, name="p") + _rate_sql(1, name="q")
    + ", v AS (SELECT p.series, p.instance, p.tick, p.value + q.value AS value FROM p"
      " JOIN q USING (series, tick))",
    "K8S_0101": _rate_sql(0),
}


def _rule_query(rule):
    def query(s, d):
        return R.evaluate(rule, rule_samples(s, d, *rule.metrics), CLOCK).drop("summary")
    return query


for _id, _rule in R.RULES.items():
    _source = "c" if _id == "NODE_0101" else "v"
    add(f"rule_{_id.lower()}", _rule_query(_rule),
        samples_sql(*_rule.metrics) + _VECTOR.get(_id, _instant_sql(0))
        + _held_sql(f"({_BREACH[_id]})", 1, _source) + f"""
SELECT '{_id}' AS id, '{_rule.alert}' AS alertname, '{_rule.severity}' AS severity,
 '{_rule.alert_type}' AS alert_type, series, ip, start_tick, fired_tick, end_tick, ticks,
 round(peak + 1e-9, 6) AS peak FROM held""")
