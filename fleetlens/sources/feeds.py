"""Alert snapshots, metric samples and heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.alerts import instant, state_of

LABEL_MAP = "MAP<STRING, STRING>"


def parse_alerts(objects: DataFrame, column: str = "value") -> DataFrame:
    """One alert object per row; ``status`` may be ``{"state": s}`` or a plain string."""
    keep = [c for c in objects.columns if c != column]
    body = F.col("_b")
    schema = (f"fingerprint STRING, labels {LABEL_MAP}, annotations {LABEL_MAP},"
              " startsAt STRING, endsAt STRING")
    return (objects.withColumn("_b", F.from_json(column, schema))
            .select(*keep, body["fingerprint"].alias("fingerprint"),
                    state_of(F.get_json_object(column, "$.status")).alias("state"),
                    body["labels"].alias("labels"), body["annotations"].alias("annotations"),
                    instant(body["startsAt"]).alias("starts_at"),
                    instant(body["endsAt"]).alias("ends_at")))


def parse_snapshots(polls: DataFrame, column: str = "value") -> DataFrame:
    """One poll per row, its payload a JSON list of alert objects; ``ok`` is false if unreadable."""
    items = F.from_json(column, "ARRAY<STRING>")
    out = polls.withColumn("ok", items.isNotNull()).withColumn("value", F.explode_outer(items))
    return parse_alerts(out)


def parse_samples(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON samples to (metric, labels, us, value)."""
    body = F.from_json(column, f"metric STRING, labels {LABEL_MAP}, us BIGINT, value DOUBLE")
    return lines.select(body.alias("_b")).select("_b.*").where("metric IS NOT NULL")


def parse_heartbeats(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON beats to (client_id, ts, process_running); beats without a client are refused."""
    body = F.from_json(column, "client_id STRING, status STRING, process_running BOOLEAN, us BIGINT")
    return (lines.select(body.alias("_b")).select("_b.*").where("client_id IS NOT NULL"))
