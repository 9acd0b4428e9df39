"""Alert, report and heartbeat queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog import fixtures as X
from fleetlens.catalog.fixtures import AS_OF, EVENTS_SQL, HEART_SQL, POLL_SQL, SNAP_SQL, STORE_SQL
from fleetlens.catalog.registry import add
from fleetlens.functions import alerts as FA
from fleetlens.operators import alerts as A
from fleetlens.operators import heartbeat as HB
from fleetlens.sources import feeds as FD

AS_OF_US = 1_706_659_200_000_000


def _alerts(s, d):
    return FD.parse_alerts(X.alert_json(s, d))


# ---- snapshots and stores -----------------------------------------------------------------

add("s9_alert_snapshots", lambda s, d: _alerts(s, d).select(
    "event_id", "poll", "fingerprint", "state", F.col("labels")["alertname"].alias("alertname"),
    F.col("labels")["severity"].alias("severity"), F.unix_micros("starts_at").alias("starts_us")),
    SNAP_SQL + """
SELECT event_id, poll, fingerprint, state, alertname, severity, epoch_us(starts_at) AS starts_us FROM snap""")

add("s9_snapshot_lists", lambda s, d: FD.parse_snapshots(X.alert_json(s, d).groupBy("poll").agg(
    F.concat(F.lit("["), F.concat_ws(",", F.collect_list("value")), F.lit("]")).alias("value")))
    .groupBy("poll", "ok", "state").agg(F.count(F.lit(1)).alias("alerts")), SNAP_SQL + """
SELECT poll, true AS ok, state, count(*) AS alerts FROM snap GROUP BY 1, 2, 3""")

add("f9_alert_states", lambda s, d: _alerts(s, d).groupBy("state").count(),
    SNAP_SQL + " SELECT state, count(*) AS count FROM snap GROUP BY 1")

add("f10_alert_times", lambda s, d: _alerts(s, d).select(
    "event_id", FA.local_text(F.col("starts_at")).alias("local_time")), SNAP_SQL + """
SELECT event_id, strftime(starts_at + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS local_time FROM snap""")

add("f8_severity_levels", lambda s, d: X.alert_store(s, d).select("event_id", FA.severity_level(F.when(
    F.col("recurrence_count") == 0, "Critical").when(F.col("recurrence_count") == 1, F.lower("severity"))
    .when(F.col("recurrence_count") == 2, "warning").otherwise("odd")).alias("level")), STORE_SQL + """
SELECT event_id, CAST(CASE recurrence_count WHEN 0 THEN 4 WHEN 1 THEN CASE severity WHEN 'P0' THEN 4
 WHEN 'P1' THEN 3 WHEN 'P2' THEN 2 WHEN 'P3' THEN 1 ELSE 0 END WHEN 2 THEN 2 ELSE 0 END AS INT) AS level
FROM alert_store""")

_ROW = ["fingerprint", "status", "starts_at", "alertname", "severity", "node", "host_ip", "namespace",
        "instance", "job", "summary", "description", "recurrence_count", "pod_ip"]
add("f11_display_rows", lambda s, d: FA.display_row(_alerts(s, d)).select(*_ROW), SNAP_SQL + """
SELECT fingerprint, state AS status, strftime(starts_at + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S')
 AS starts_at, coalesce(alertname, 'unknown') AS alertname, severity, coalesce(node, 'unknown') AS node,
 coalesce(host_ip, 'unknown') AS host_ip, coalesce(exported_namespace, namespace, 'unknown') AS namespace,
 instance, 'unknown' AS job, summary, 'unknown' AS description, '0' AS recurrence_count,
 'unknown' AS pod_ip FROM snap""")

add("f12_alert_cards", lambda s, d: FA.card(_alerts(s, d).withColumn(
    "repeat_count", (F.col("event_id") % 3).cast("int"))), SNAP_SQL + """
SELECT fingerprint, CASE WHEN state = 'resolved' THEN '🟢【故障恢复】 - ' || coalesce(alertname, '未知告警')
 ELSE '⚠【故障告警】 - ' || coalesce(alertname, '未知告警') || CASE WHEN event_id % 3 > 0
 THEN ' -- 重复推送' || (event_id % 3) || '次' ELSE '' END END AS title,
 CASE WHEN state = 'resolved' THEN 'green' ELSE CASE severity WHEN 'P0' THEN 'red' WHEN 'P1' THEN 'orange'
 WHEN 'P2' THEN 'yellow' ELSE 'blue' END END AS colour, severity, summary,
 coalesce(node, '未知节点') AS node, coalesce(host_ip, '未知IP') AS host_ip, instance,
 '未知ID' AS id, '未知类型' AS alert_type, '未知任务' AS job, coalesce(cluster, '未知集群') AS cluster,
 coalesce(exported_namespace, namespace, '未知命名空间') AS namespace, '未知节点' AS nodename, '未知Pod' AS pod_name,
 '未知Pod IP' AS pod_ip, '未知容器' AS pod_container_name, coalesce(deployment, '未知部署') AS deployment,
 '无详细信息' AS description, strftime(starts_at + INTERVAL 8 HOURS, '%Y-%m-%d %H:%M:%S') AS started FROM snap""")

_RULE = A.AlertFilter(min_severity="warning", exclude_names=("Alert3",), exclude_labels={"node": "node4"},
                      include_labels={"host_ip": "10.2.0.5", "namespace": "ns1", "instance": "10.1.0.2"})
add("p5_configured_filter", lambda s, d: A.keep_alerts(_alerts(s, d), _RULE).select("event_id"), SNAP_SQL + """
SELECT event_id FROM snap WHERE severity IN ('P0', 'P1', 'P2') AND coalesce(alertname, '') <> 'Alert3'
 AND coalesce(node, '') <> 'node4'
 AND (host_ip = '10.2.0.5' OR namespace = 'ns1' OR instance = '10.1.0.2')""")

add("p6_adhoc_filter", lambda s, d: A.find_alerts(_alerts(s, d), "Alert2", "active", {
    "instance": ".1", "host_ip": "10.2"}).select("event_id"), SNAP_SQL + """
SELECT event_id FROM snap WHERE alertname = 'Alert2' AND state IN ('active', 'firing')
 AND contains(instance, '.1') AND contains(host_ip, '10.2')""")

add("p7_valid_alerts", lambda s, d: A.checked_alerts(_alerts(s, d)).select("event_id"), SNAP_SQL + """
SELECT event_id FROM snap WHERE fingerprint <> '' AND alertname IS NOT NULL""")

add("p7_rejected_alerts", lambda s, d: A.rejected_alerts(_alerts(s, d)).select("event_id", "reason"),
    SNAP_SQL + """
SELECT event_id, CASE WHEN fingerprint = '' THEN 'no_fingerprint' ELSE 'no_alertname' END AS reason
FROM snap WHERE fingerprint = '' OR alertname IS NULL""")

LATEST_SQL = STORE_SQL + """, latest AS (SELECT * EXCLUDE (p) FROM (SELECT *, row_number() OVER (
 PARTITION BY fingerprint ORDER BY created_at DESC, event_id DESC) AS p FROM alert_store) WHERE p = 1)"""
add("s10_latest_alerts", lambda s, d: A.latest_alerts(X.alert_store(s, d)).select(
    "fingerprint", "status", "event_id"), LATEST_SQL + " SELECT fingerprint, status, event_id FROM latest")
add("s10_newest_first", lambda s, d: A.newest_first(X.alert_store(s, d)).select("event_id", "fingerprint"),
    STORE_SQL + " SELECT event_id, fingerprint FROM alert_store ORDER BY created_at DESC, event_id DESC")
add("u3_active_fingerprints", lambda s, d: A.active_fingerprints(X.alert_store(s, d)),
    STORE_SQL + " SELECT DISTINCT fingerprint FROM alert_store WHERE status <> 'resolved'")

# snapshot = error events, store = click events, both keyed by user and k
_KEYED = STORE_SQL + """, keyed AS (SELECT concat('fp', e.user_id, '-', e.k) AS fingerprint, e.event_type,
 CASE e.k % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'firing' ELSE 'resolved' END AS status, us, event_id FROM e),
snapshot AS (SELECT DISTINCT fingerprint FROM keyed WHERE event_type = 'error'),
store AS (SELECT * FROM keyed WHERE event_type = 'click')"""


def _keyed(s, d, kind):
    k = F.col("k")
    return X.metric_samples(s, d).where(F.col("metric") == kind).join(
        X._events(s, d).select("event_id", "user_id"), "event_id").select(
            F.concat(F.lit("fp"), "user_id", F.lit("-"), k).alias("fingerprint"),
            F.when(k % 3 == 0, "active").when(k % 3 == 1, "firing").otherwise("resolved").alias("status"),
            F.col("ts").alias("created_at"), "event_id")


add("j3_snapshot_with_store", lambda s, d: A.match_store(
    _keyed(s, d, "error").select("fingerprint").distinct(), _keyed(s, d, "click"))
    .select("fingerprint", "stored_status", F.unix_micros("stored_at").alias("stored_us")), _KEYED + """
, l AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY us DESC, event_id DESC) AS p FROM store)
SELECT s.fingerprint, l.status AS stored_status, l.us AS stored_us FROM snapshot s
LEFT JOIN l ON s.fingerprint = l.fingerprint AND l.p = 1""")

_CHANGES = _KEYED + """, ch AS (SELECT fingerprint, 'new' AS change FROM snapshot
 WHERE fingerprint NOT IN (SELECT fingerprint FROM store)
 UNION ALL SELECT DISTINCT fingerprint, 'resolved' FROM store WHERE status <> 'resolved'
 AND fingerprint NOT IN (SELECT fingerprint FROM snapshot))"""
add("j4_snapshot_changes", lambda s, d: A.snapshot_changes(_keyed(s, d, "error"), _keyed(s, d, "click")),
    _CHANGES + " SELECT fingerprint, change FROM ch")
add("u1_new_fingerprints", lambda s, d: _keyed(s, d, "error").select("fingerprint").distinct().exceptAll(
    _keyed(s, d, "click").select("fingerprint").distinct()),
    _CHANGES + " SELECT fingerprint FROM ch WHERE change = 'new'")

# ---- life cycle ---------------------------------------------------------------------------

LIFE_SQL = "RECURSIVE " + POLL_SQL + """, sight AS (SELECT fingerprint, poll, row_number() OVER (
  PARTITION BY fingerprint ORDER BY poll) AS rn FROM (SELECT DISTINCT fingerprint, poll FROM alert_polls)),
fold AS (SELECT fingerprint, poll, rn, poll AS live, 'new' AS state FROM sight WHERE rn = 1
 UNION ALL SELECT s.fingerprint, s.poll, s.rn,
  CASE WHEN s.poll - f.live = 1 OR s.poll - f.live > 3 THEN s.poll ELSE f.live END,
  CASE WHEN s.poll - f.live = 1 THEN 'ongoing' WHEN s.poll - f.live > 3 THEN 'recurrence'
   ELSE 'suppressed' END
 FROM fold f JOIN sight s ON s.fingerprint = f.fingerprint AND s.rn = f.rn + 1),
life AS (SELECT fingerprint, poll, state FROM fold
 UNION ALL SELECT fingerprint, poll + 1, 'resolved' FROM fold f WHERE state <> 'suppressed'
 AND poll < (SELECT max(poll) FROM alert_polls) AND NOT EXISTS (SELECT 1 FROM fold g
  WHERE g.fingerprint = f.fingerprint AND g.poll = f.poll + 1 AND g.state <> 'suppressed')),
started AS (SELECT fingerprint, poll, min(poll) OVER (PARTITION BY fingerprint, poll - rn) AS starts_poll
 FROM sight),
facts AS (SELECT fingerprint, poll, min(alertname) AS alertname, min(severity) AS severity
 FROM alert_polls GROUP BY 1, 2)"""

add("l1_alert_lifecycle", lambda s, d: A.lifecycle(X.alert_polls(s, d)),
    LIFE_SQL + " SELECT fingerprint, poll, state FROM life")



def _decision_sides(s, d):
    """Snapshot: newest error event per user; store: click events, resolved ``k`` minutes ago.

    Each side lacks some users, so that alerts are new and gone too."""
    e, k = X._events(s, d).withColumn("fingerprint", F.concat(F.lit("fp"), "user_id")), F.col("k")
    state = F.when(k % 3 == 0, "active").when(k % 3 == 1, "firing").otherwise("resolved")
    seen = e.where("event_type = 'error' AND user_id % 5 <> 1").groupBy("fingerprint").agg(
        F.max_by(state, "event_id").alias("state"), F.max_by(k % 4, "event_id").alias("starts_us"))
    status = F.when(k % 11 == 0, "pending").otherwise(state)
    ended = F.when((status == "resolved") & (k % 2 == 0), F.lit(AS_OF_US) - k.cast("bigint") * 60_000_000)
    return seen, e.where("event_type = 'click' AND user_id % 7 <> 2").select(
        "fingerprint", status.alias("status"), (k % 4).alias("starts_us"), ended.alias("resolved_us"), "us",
        "event_id")


add("l1_alert_decisions", lambda s, d: A.decide(*_decision_sides(s, d), AS_OF_US), EVENTS_SQL + f"""
, t AS (SELECT *, concat('fp', user_id) AS fingerprint,
 CASE k % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'firing' ELSE 'resolved' END AS state FROM e),
seen AS (SELECT * FROM t WHERE event_type = 'error' AND user_id % 5 <> 1
 QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY event_id DESC) = 1),
st AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'pending' ELSE state END AS status FROM t WHERE event_type = 'click'
 AND user_id % 7 <> 2),
newest AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY us DESC, event_id DESC) = 1),
sooner AS (SELECT DISTINCT fingerprint FROM st WHERE status = 'resolved' AND k % 2 = 0 AND k < 20),
v AS (SELECT fingerprint, s.state, CASE WHEN n.status IS NULL THEN 'new'
  WHEN n.status IN ('active', 'firing') THEN 'ongoing' WHEN n.status = 'pending' THEN 'other'
  WHEN n.k % 4 = s.k % 4 THEN 'unchanged'
  WHEN fingerprint IN (SELECT fingerprint FROM sooner) THEN 'suppressed' ELSE 'recurrence' END AS verdict
 FROM seen s LEFT JOIN newest n USING (fingerprint))
SELECT fingerprint, verdict, verdict IN ('new', 'recurrence') AND state IN ('active', 'firing') AS notify FROM v
UNION ALL SELECT DISTINCT fingerprint, 'resolved', false FROM st WHERE status <> 'resolved'
 AND fingerprint NOT IN (SELECT fingerprint FROM seen)""")

add("l2_stored_alerts", lambda s, d: A.stored_rows(X.alert_polls(s, d)), LIFE_SQL + """
SELECT fingerprint, alertname, severity, poll AS created_poll, starts_poll,
 state = 'recurrence' AS is_recurrence FROM fold JOIN started USING (fingerprint, poll)
JOIN facts USING (fingerprint, poll) WHERE state IN ('new', 'recurrence')""")

add("l3_settled_store", lambda s, d: A.settle_status(
    X.alert_store(s, d), X.alert_store(s, d).where("status = 'resolved'").select(
        "fingerprint", F.col("us").alias("resolved_at"))).groupBy("status", "resolved_at").count(),
    STORE_SQL + """, ended AS (SELECT s.event_id, any_value(s.status) AS status, min(r.us) AS resolved_at
 FROM alert_store s LEFT JOIN alert_store r
 ON r.fingerprint = s.fingerprint AND r.status = 'resolved' AND r.us >= s.us GROUP BY 1)
SELECT CASE WHEN resolved_at IS NOT NULL THEN 'resolved' ELSE status END AS status, resolved_at,
 count(*) AS count FROM ended GROUP BY 1, 2""")


def _pushes(s, d):
    """Push facts from the other events: view = group, purchase = repeat, signup = table or recovery."""
    t, k = F.col("event_type"), F.col("k")
    return X._events(s, d).where("event_type IN ('view', 'purchase', 'signup')").select(
        F.concat(F.lit("fp"), "user_id").alias("fingerprint"), "us",
        F.when(t == "view", "group").when(t == "purchase", "repeat").when(k >= 50, "table")
        .otherwise("recovery").alias("kind"))


PUSH_SQL = LATEST_SQL + """, pushes AS (SELECT concat('fp', user_id) AS fingerprint, us,
 CASE event_type WHEN 'view' THEN 'group' WHEN 'purchase' THEN 'repeat' ELSE CASE WHEN k >= 50 THEN 'table'
 ELSE 'recovery' END END AS kind FROM e WHERE event_type IN ('view', 'purchase', 'signup')),
ps AS (SELECT s.fingerprint, max(CASE WHEN kind IN ('group', 'repeat') THEN p.us END) AS group_push_us,
 max(CASE WHEN kind = 'table' THEN p.us END) AS table_push_us,
 count(CASE WHEN kind = 'repeat' THEN 1 END) AS repeat_count,
 coalesce(bool_or(kind = 'recovery'), false) AS rec
 FROM (SELECT DISTINCT fingerprint FROM alert_store) s LEFT JOIN pushes p USING (fingerprint) GROUP BY 1)"""

add("l4_repeat_due", lambda s, d: A.repeat_due(X.alert_store(s, d), _pushes(s, d), AS_OF_US), PUSH_SQL + f"""
SELECT fingerprint, repeat_count + 1 AS next_repeat, round(({AS_OF_US} - group_push_us) / 1e6 + 1e-9, 6)
 AS since_push_s FROM ps JOIN latest USING (fingerprint) WHERE status IN ('active', 'firing')
 AND (group_push_us IS NULL OR ({AS_OF_US} - group_push_us) / 1e6 >= 86400)""")

add("l5_push_state", lambda s, d: A.push_state(X.alert_store(s, d), _pushes(s, d)), PUSH_SQL + """
SELECT fingerprint, group_push_us, table_push_us, repeat_count, CASE WHEN rec THEN 'recovery_reported'
 WHEN group_push_us IS NOT NULL THEN 'reported' ELSE 'unreported' END AS push_status FROM ps""")


def routed(s, d):
    polls = X.alert_polls(s, d)
    who = polls.groupBy("fingerprint").agg(F.min("severity").alias("severity"),
                                           F.min("alertname").alias("alertname"))
    return A.route(A.lifecycle(polls).join(who, "fingerprint"))


ROUTE_SQL = LIFE_SQL + """, who AS (SELECT fingerprint, min(severity) AS severity, min(alertname) AS alertname
 FROM alert_polls GROUP BY 1),
ev AS (SELECT * FROM life JOIN who USING (fingerprint) WHERE state IN ('new', 'recurrence', 'resolved')),
routed AS (SELECT *, CASE severity WHEN 'P0' THEN 'group_p0' WHEN 'P1' THEN 'group_p1' ELSE 'group_p2' END
 AS channel FROM ev UNION ALL SELECT *, 'table' FROM ev
 UNION ALL SELECT *, 'phone' FROM ev WHERE severity = 'P0' AND state <> 'resolved')"""

add("l6_notifications", routed, ROUTE_SQL + """
SELECT fingerprint, poll, state, severity, alertname, channel FROM routed""")

_WEEK = f""", wk AS (SELECT * FROM alert_store WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS
 AND created_at <= TIMESTAMP '{AS_OF}')"""
add("l7_report_window", lambda s, d: A.last_week(X.alert_store(s, d), AS_OF).select("event_id"),
    STORE_SQL + _WEEK + " SELECT event_id FROM wk")

_TALLY = """count(*) AS total_count, count(CASE WHEN status IN ({live}) THEN 1 END) AS active_count,
 count(CASE WHEN status = 'resolved' THEN 1 END) AS resolved_count,
 count(CASE WHEN is_recurrence THEN 1 END) AS recurrence_count,
 count(CASE WHEN repeat_push_count > 0 THEN 1 END) AS repeat_push_count,
 CAST(sum(repeat_push_count) AS BIGINT) AS total_repeat_push"""
_LIVE = _TALLY.format(live="'active', 'firing'")
_BY = f"""SELECT severity, {_LIVE} FROM wk GROUP BY 1 UNION ALL SELECT 'ALL', {_LIVE} FROM wk"""
add("a24_weekly_severity", lambda s, d: A.weekly_by_severity(X.alert_store(s, d), AS_OF),
    STORE_SQL + _WEEK + " " + _BY)
_OLD = _TALLY.format(live="'active'")
add("a24_weekly_severity_compat", lambda s, d: A.weekly_by_severity(X.alert_store(s, d), AS_OF, True),
    STORE_SQL + f""", wk AS (SELECT * FROM alert_store WHERE created_at >= date_trunc('day',
 TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS) AND created_at <= TIMESTAMP '{AS_OF}')
SELECT severity, {_OLD} FROM wk GROUP BY 1 UNION ALL SELECT 'ALL', {_OLD} FROM wk""")

_NAMES = """SELECT alertname, count(*) AS alerts,
 count(CASE WHEN status IN ('active', 'firing') THEN 1 END) AS active_count,
 CAST(sum(recurrence_count) AS BIGINT) AS total_recurrence FROM wk {where} GROUP BY 1
 ORDER BY 2 DESC, 1 LIMIT {k}"""
add("a25_weekly_top_names", lambda s, d: A.weekly_top_names(X.alert_store(s, d), AS_OF),
    STORE_SQL + _WEEK + " " + _NAMES.format(where="", k=10))
add("a26_weekly_p3", lambda s, d: A.weekly_p3(X.alert_store(s, d), AS_OF), STORE_SQL + _WEEK + """
SELECT count(*) AS total_count, count(CASE WHEN status IN ('active', 'firing') THEN 1 END) AS active_count,
 count(CASE WHEN status = 'resolved' THEN 1 END) AS resolved_count,
 count(CASE WHEN recurrence_count > 0 THEN 1 END) AS recurring_alerts,
 CAST(sum(recurrence_count) AS BIGINT) AS total_recurrence FROM wk WHERE severity = 'P3'""")
add("a26_weekly_p3_names", lambda s, d: A.weekly_top_names(X.alert_store(s, d), AS_OF, severity="P3"),
    STORE_SQL + _WEEK + " " + _NAMES.format(where="WHERE severity = 'P3'", k=10))

add("l8_report_lines", lambda s, d: A.report_lines(X.alert_store(s, d), AS_OF), STORE_SQL + _WEEK + f"""
, by_sev AS ({_BY}), names AS ({_NAMES.format(where="", k=5)})
SELECT CASE WHEN severity = 'ALL' THEN 0 ELSE 1 END AS part, severity AS name,
 printf('total %d | active %d | resolved %d | recurring %d | repeated %d', total_count, active_count,
 resolved_count, recurrence_count, repeat_push_count) AS line FROM by_sev
UNION ALL SELECT 2, alertname, printf('%d alerts (%d active)', alerts, active_count) FROM names""")

add("l9_notification_groups", lambda s, d: A.notification_groups(X.alert_store(s, d), "10 minutes"),
    STORE_SQL + """
SELECT us // 600000000 * 600000000 AS window_us, alertname, count(*) AS alerts,
 count(DISTINCT fingerprint) AS fingerprints, min(severity) AS top_severity, CASE min(severity)
 WHEN 'P1' THEN 'critical-alerts' WHEN 'P2' THEN 'warning-alerts' ELSE 'web.hook' END AS receiver
FROM alert_store GROUP BY 1, 2""")

add("l8_p3_card", lambda s, d: A.p3_card_lines(X.alert_store(s, d), AS_OF), STORE_SQL + _WEEK + f"""
, p3 AS (SELECT count(*) AS total, count(CASE WHEN status IN ('active', 'firing') THEN 1 END) AS active,
 count(CASE WHEN status = 'resolved' THEN 1 END) AS resolved,
 count(CASE WHEN recurrence_count > 0 THEN 1 END) AS again, coalesce(sum(recurrence_count), 0) AS often
 FROM wk WHERE severity = 'P3'), names AS ({_NAMES.format(where="WHERE severity = 'P3'", k=10)})
SELECT 0 AS part, '统计周期' AS name, '2024-01-24 至 2024-01-31' AS line
UNION ALL SELECT 1, '总告警数', CAST(total AS VARCHAR) FROM p3 UNION ALL SELECT 2, '活跃告警', CAST(active AS VARCHAR) FROM p3
UNION ALL SELECT 3, '已解决', CAST(resolved AS VARCHAR) FROM p3 UNION ALL SELECT 4, '复发告警', CAST(again AS VARCHAR) FROM p3
UNION ALL SELECT 5, '总复发次数', CAST(often AS VARCHAR) FROM p3
UNION ALL SELECT 6, alertname, concat('• ', alertname, ': ', alerts, '次',
 CASE WHEN total_recurrence > 0 THEN concat(' (复发', total_recurrence, '次)') ELSE '' END) FROM names
UNION ALL SELECT 6, '', '• 本周无P3告警' FROM p3 WHERE total = 0""")

_MID_US = 1_705_708_800_000_000
add("l9_group_repeats", lambda s, d: A.group_repeats(X.alert_store(s, d), _MID_US), STORE_SQL + f"""
, past AS (SELECT * FROM alert_store WHERE us <= {_MID_US}), newest AS (SELECT fingerprint, alertname, status,
  row_number() OVER (PARTITION BY fingerprint ORDER BY us DESC, event_id DESC) AS p FROM past),
sent AS (SELECT alertname, max(us // 10000000 * 10000000) AS last_us FROM past GROUP BY 1),
live AS (SELECT alertname, count(*) AS live_alerts FROM newest WHERE p = 1 AND status IN ('active', 'firing')
 GROUP BY 1)
SELECT alertname, last_us, live_alerts, round(({_MID_US} - last_us) / 1e6 + 1e-9, 6) AS since_s
FROM sent JOIN live USING (alertname) WHERE {_MID_US} - last_us >= 3600000000""")

add("l10_receivers", lambda s, d: X.alert_store(s, d).groupBy(A.receiver(F.col("severity")).alias(
    "receiver")).count(), STORE_SQL + """
SELECT CASE severity WHEN 'P1' THEN 'critical-alerts' WHEN 'P2' THEN 'warning-alerts' ELSE 'web.hook' END
 AS receiver, count(*) AS count FROM alert_store GROUP BY 1""")

add("w16_recurrences", lambda s, d: A.history_recurrences(X.alert_store(s, d)), STORE_SQL + """
, h AS (SELECT fingerprint, status, lag(status) OVER (PARTITION BY fingerprint ORDER BY us, event_id) AS b
 FROM alert_store)
SELECT fingerprint, count(CASE WHEN b = 'resolved' AND status IN ('active', 'firing') THEN 1 END)
 AS recurrences FROM h GROUP BY 1""")

# ---- feeds and heartbeats -----------------------------------------------------------------

add("s11_metric_feed", lambda s, d: FD.parse_samples(X.metric_samples(s, d).select(F.to_json(F.struct(
    "metric", F.create_map(F.lit("instance"), F.concat(F.lit("i"), "instance")).alias("labels"), "us",
    "value")).alias("value"))).groupBy("metric", F.col("labels")["instance"].alias("instance")).agg(
        F.count(F.lit(1)).alias("samples"), F.max("us").alias("last_us"), F.max("value").alias("peak")),
    X.METRIC_SQL + """
SELECT metric, concat('i', instance) AS instance, count(*) AS samples, max(us) AS last_us,
 round(max(value) + 1e-9, 6) AS peak FROM metric_samples GROUP BY 1, 2""")

add("s12_heartbeat_feed", lambda s, d: FD.parse_heartbeats(X.heartbeats(s, d).select(F.to_json(F.struct(
    F.concat(F.lit("c"), "client_id").alias("client_id"), F.lit("alive").alias("status"),
    F.lit(True).alias("process_running"), "us")).alias("value"))).groupBy("client_id").agg(
        F.count(F.lit(1)).alias("beats"), F.max("us").alias("last_us")), HEART_SQL + """
SELECT concat('c', client_id) AS client_id, count(*) AS beats, max(us) AS last_us
FROM heartbeats GROUP BY 1""")

SILENT_SQL = HEART_SQL + """, g AS (SELECT client_id, us, lag(us) OVER (PARTITION BY client_id ORDER BY us)
 AS last_us FROM (SELECT DISTINCT client_id, us FROM heartbeats)),
silent AS (SELECT client_id, last_us, us, us AS until FROM g WHERE us - last_us > 1200000000
 UNION ALL SELECT client_id, max(us), NULL, (SELECT max(us) FROM heartbeats) FROM heartbeats GROUP BY 1
 HAVING (SELECT max(us) FROM heartbeats) - max(us) > 1200000000)"""
add("x3_heartbeat_silences", lambda s, d: HB.silences(X.heartbeats(s, d)), SILENT_SQL + """
SELECT client_id, last_us, last_us + 1200000000 AS offline_us, us AS back_us,
 round((until - last_us) / 1e6 + 1e-9, 6) AS silent_s FROM silent""")
add("x3_connection_events", lambda s, d: HB.connection_events(X.heartbeats(s, d)), SILENT_SQL + """
SELECT client_id, min(us) AS us, 'recovered' AS event FROM heartbeats GROUP BY 1
UNION ALL SELECT client_id, last_us + 1200000000, 'offline' FROM silent
UNION ALL SELECT client_id, us, 'recovered' FROM silent WHERE us IS NOT NULL""")
