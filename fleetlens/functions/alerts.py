"""Alert fields: state, times, severities, display rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.calls import lookup
from fleetlens.params import SEVERITY_LEVELS

DISPLAY_ZONE = "Asia/Shanghai"

# Titles, colours, texts for absent labels, and the columns of the alert display row
TITLE_FIRING = "⚠【故障告警】 - "
TITLE_RESOLVED = "🟢【故障恢复】 - "
TITLE_REPEAT = " -- 重复推送%d次"
CARD_COLOURS = {"P0": "red", "P1": "orange", "P2": "yellow", "P3": "blue"}
CARD_DEFAULTS = {
    "alertname": "未知告警", "id": "未知ID", "alert_type": "未知类型", "severity": "未知", "node": "未知节点",
    "instance": "未知实例", "job": "未知任务", "host_ip": "未知IP", "cluster": "未知集群", "nodename": "未知节点",
    "pod_name": "未知Pod", "pod_ip": "未知Pod IP", "pod_container_name": "未知容器", "deployment": "未知部署",
}
CARD_NAMESPACE, CARD_SUMMARY, CARD_DESCRIPTION = "未知命名空间", "无描述", "无详细信息"
LABEL_COLUMNS = ("id", "alert_type", "alertname", "instance", "severity", "job", "node", "host_ip",
                 "cluster", "nodename", "pod_name", "pod_ip", "pod_container_name", "deployment")


def severity_level(severity: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_LEVELS, F.upper(severity)), F.lit(0))


def state_of(status_json: Column) -> Column:
    """State from ``{"state": s}`` or from a plain string."""
    nested = F.get_json_object(status_json, "$.state")
    return F.coalesce(nested, F.when(~status_json.startswith("{"), F.trim(status_json, F.lit('"'))),
                      F.lit(""))


def instant(text: Column) -> Column:
    """Timestamp from ``...Z``, ``...+hh:mm`` or naive-UTC text (session time zone UTC)."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, text).otherwise(F.concat(text, F.lit("Z"))).try_cast("timestamp")


def local_text(ts: Column, zone: str = DISPLAY_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm:ss")


def is_live(state: Column) -> Column:
    return state.isin("active", "firing")


def display_row(alerts: DataFrame) -> DataFrame:
    """24-column table row; input has fingerprint, state, starts_at, ends_at, labels, annotations."""
    def label(name):
        return F.coalesce(F.col("labels")[name], F.lit("unknown"))
    return alerts.select(
        F.coalesce("fingerprint", F.lit("unknown")).alias("fingerprint"),
        F.col("state").alias("status"),
        local_text(F.col("starts_at")).alias("starts_at"),
        local_text(F.col("ends_at")).alias("ends_at"),
        *[label(n).alias(n) for n in LABEL_COLUMNS],
        F.coalesce(F.col("labels")["exported_namespace"], F.col("labels")["namespace"],
                   F.lit("unknown")).alias("namespace"),
        F.coalesce(F.col("annotations")["summary"], F.lit("unknown")).alias("summary"),
        F.coalesce(F.col("annotations")["description"], F.lit("unknown")).alias("description"),
        F.lit("0").alias("recurrence_count"),
        F.to_json("labels").alias("labels"), F.to_json("annotations").alias("annotations"))


def card(alerts: DataFrame, repeats: str = "repeat_count") -> DataFrame:
    """Title, colour and text fields of one notification per alert."""
    labels, state = F.col("labels"), F.col("state")
    field = {k: F.coalesce(labels[k], F.lit(v)) for k, v in CARD_DEFAULTS.items()}
    name, severity = field.pop("alertname"), field.pop("severity")
    firing = F.concat(F.lit(TITLE_FIRING), name, F.when(
        F.col(repeats) > 0, F.format_string(TITLE_REPEAT, F.col(repeats))).otherwise(F.lit("")))
    colour = F.when(state == "resolved", F.lit("green")).otherwise(
        F.coalesce(lookup(CARD_COLOURS, F.upper(severity)), F.lit("orange")))
    return alerts.select(
        "fingerprint", F.when(is_live(state), firing).otherwise(
            F.concat(F.lit(TITLE_RESOLVED), name)).alias("title"),
        colour.alias("colour"), severity.alias("severity"),
        *[value.alias(key) for key, value in field.items()],
        F.coalesce(labels["exported_namespace"], labels["namespace"], F.lit(CARD_NAMESPACE)).alias("namespace"),
        F.coalesce(F.col("annotations")["summary"], F.lit(CARD_SUMMARY)).alias("summary"),
        F.coalesce(F.col("annotations")["description"], F.lit(CARD_DESCRIPTION)).alias("description"),
        local_text(F.col("starts_at")).alias("started"))
