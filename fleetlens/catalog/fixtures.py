"""Domain tables derived from the given parquet tables, once for Spark and once as oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.numbers import div
from fleetlens.params import Topology

TOPOLOGY = Topology(tp=2, pp=2, world_size=8)
TICK_US = 14_400_000_000  # one poll / evaluation tick: four hours
FIRST_TICK = 118_338
AS_OF = "2024-01-31 00:00:00"


def events_of(raw: DataFrame) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return raw.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"), us.alias("us"),
        (div(us, TICK_US) - FIRST_TICK).alias("tick"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return events_of(spark.read.parquet(f"{sf}/events.parquet"))


EVENTS_SQL = f"""e AS (
 SELECT event_id, ts, user_id, event_type, value,
  CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) AS us,
  CAST(epoch_us(ts) // {TICK_US} AS BIGINT) - {FIRST_TICK} AS tick FROM events)"""


def calls_of(events: DataFrame, *extra: str) -> DataFrame:
    k = F.col("k")
    return events.select(
        (1 + F.floor((F.dayofmonth("ts") - 1) / 10)).cast("int").alias("save_count"),
        (F.col("us") * 1000).alias("ts_ns"), (F.col("us") / 1e6).alias("timestamp"),
        (F.col("user_id") % 8).cast("int").alias("rank"),
        F.when(k % 5 == 0, "AllReduce").when(k % 5 == 1, "AllGather")
        .when(k % 5 == 2, "ReduceScatter").when(k % 5 == 3, "Send")
        .otherwise("Broadcast").alias("function"),
        F.when(k % 5 == 4, k.cast("bigint"))
        .otherwise(F.round(F.col("value") * 100).cast("bigint")).alias("data_size"),
        F.concat(F.lit("0x"), (k % 5).cast("string")).alias("stream"),
        F.col("tick").alias("op_count"),
        F.when(F.col("event_type") == "click", -11).when(F.col("event_type") == "error", 12)
        .when(F.col("event_type") == "purchase", -13).when(F.col("event_type") == "signup", 14)
        .otherwise(15).cast("bigint").alias("group_hash"),
        "event_id", *extra)


def comm_ops(spark: SparkSession, sf: str) -> DataFrame:
    return calls_of(_events(spark, sf))


COMM_SQL = EVENTS_SQL + """, comm_ops AS (
 SELECT CAST(1 + floor((day(ts)-1)/10) AS INT) AS save_count, us*1000 AS ts_ns, us/1e6 AS timestamp,
  CAST(user_id % 8 AS INT) AS rank,
  CASE k % 5 WHEN 0 THEN 'AllReduce' WHEN 1 THEN 'AllGather' WHEN 2 THEN 'ReduceScatter'
   WHEN 3 THEN 'Send' ELSE 'Broadcast' END AS function,
  CASE WHEN k % 5 = 4 THEN CAST(k AS BIGINT) ELSE CAST(round(value*100) AS BIGINT) END AS data_size,
  concat('0x', CAST(k % 5 AS VARCHAR)) AS stream, tick AS op_count,
  CAST(CASE event_type WHEN 'click' THEN -11 WHEN 'error' THEN 12 WHEN 'purchase' THEN -13
   WHEN 'signup' THEN 14 ELSE 15 END AS BIGINT) AS group_hash,
  event_id FROM e)"""


def call_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Call log text; damaged where k >= 93, without a hash where k < 6."""
    c = calls_of(_events(spark, sf), "k")
    stamp = F.format_string("%d.%09d", div(F.col("ts_ns"), 1_000_000_000),
                            F.col("ts_ns") % 1_000_000_000)
    line = F.format_string(
        "[save_count %d] [%s] [Rank %d] Fun %s Data %d stream %s opCount %d",
        "save_count", stamp, "rank", "function", "data_size", "stream", "op_count")
    tail = F.when(F.col("k") < 6, F.lit("")).otherwise(
        F.format_string(" groupHash %d", "group_hash"))
    bad = F.concat(F.lit("## "), line)
    return c.select("rank", "event_id", "k", F.when(F.col("k") >= 93, bad)
                    .otherwise(F.concat(line, tail)).alias("value"))


LINE_SQL = COMM_SQL + """, call_lines AS (
 SELECT c.rank, c.event_id, e.k, concat(
  CASE WHEN e.k >= 93 THEN '## ' ELSE '' END,
  printf('[save_count %d] [%d.%09d] [Rank %d] Fun %s Data %d stream %s opCount %d', c.save_count,
   CAST(c.ts_ns // 1000000000 AS BIGINT), CAST(c.ts_ns % 1000000000 AS BIGINT), c.rank, c.function,
   c.data_size, c.stream, c.op_count),
  CASE WHEN e.k >= 93 OR e.k < 6 THEN '' ELSE printf(' groupHash %d', c.group_hash) END) AS value
 FROM comm_ops c JOIN e USING (event_id)),
parsed AS (SELECT c.save_count, c.ts_ns, c.rank, c.function, c.data_size, c.stream, c.op_count,
  CASE WHEN e.k >= 6 THEN c.group_hash END AS group_hash, c.event_id
 FROM comm_ops c JOIN e USING (event_id) WHERE e.k < 93)"""


def call_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """comm_ops with per-stream numbering that drops a number wherever k < 3."""
    from fleetlens.plans.ordered import OrderedGroups
    groups = OrderedGroups(calls_of(_events(spark, sf), "k"), ["rank", "stream"],
                           ["ts_ns", "event_id"])
    step = F.lit(1) + F.when(F.col("k") < 3, 1).otherwise(0)
    out = groups.finish(groups.running(groups.rows(), step, "op_number", "sum"))
    return out.select("save_count", "ts_ns", "timestamp", "rank", "function", "data_size",
                      "stream", F.col("op_number").cast("bigint").alias("op_count"),
                      "group_hash", "event_id")


SEQ_SQL = COMM_SQL + """, call_sequences AS (
 SELECT c.save_count, c.ts_ns, c.timestamp, c.rank, c.function, c.data_size, c.stream,
  row_number() OVER w + sum(CASE WHEN e.k < 3 THEN 1 ELSE 0 END) OVER w AS op_count,
  c.group_hash, c.event_id
 FROM comm_ops c JOIN e USING (event_id)
 WINDOW w AS (PARTITION BY c.rank, c.stream ORDER BY c.ts_ns, c.event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def link_transfers(spark: SparkSession, sf: str) -> DataFrame:
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    return spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.concat(F.lit("n"), s % 4).alias("node"), F.concat(F.lit("mlx"), s % 2).alias("card"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        F.col("l_linenumber").cast("bigint").alias("grp"),
        (s % 8).cast("int").alias("from_rank"),
        ((s + 1 + F.when(p % 10 == 0, 1).otherwise(0)) % 8).cast("int").alias("to_rank"),
        (F.col("l_linenumber") % 2).cast("int").alias("channel"),
        (p % 8).cast("int").alias("func"), (F.col("l_orderkey") % 100).alias("func_times"),
        F.concat(F.lit("10.0.0."), s % 8).alias("src_ip"),
        F.concat(F.lit("10.0.1."), p % 4).alias("dst_ip"),
        (F.col("l_quantity").cast("bigint") * 4096).alias("bytes_sent"),
        (F.floor("l_extendedprice") + 1).cast("bigint").alias("nsec"))


LINK_SQL = """link_transfers AS (
 SELECT concat('n', l_suppkey % 4) AS node, concat('mlx', l_suppkey % 2) AS card,
  CAST(epoch(l_shipdate) AS BIGINT) AS ts, CAST(l_linenumber AS BIGINT) AS grp,
  CAST(l_suppkey % 8 AS INT) AS from_rank,
  CAST((l_suppkey + 1 + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END) % 8 AS INT) AS to_rank,
  CAST(l_linenumber % 2 AS INT) AS channel, CAST(l_partkey % 8 AS INT) AS func,
  l_orderkey % 100 AS func_times, concat('10.0.0.', l_suppkey % 8) AS src_ip,
  concat('10.0.1.', l_partkey % 4) AS dst_ip, CAST(l_quantity AS BIGINT)*4096 AS bytes_sent,
  CAST(floor(l_extendedprice) AS BIGINT) + 1 AS nsec FROM lineitem),
fn AS (SELECT *, CASE func WHEN 0 THEN 'ncclFuncBroadcast' WHEN 1 THEN 'ncclFuncReduce'
  WHEN 2 THEN 'ncclFuncAllGather' WHEN 3 THEN 'ncclFuncReduceScatter' WHEN 4 THEN 'ncclFuncAllReduce'
  WHEN 5 THEN 'ncclFuncSendRecv' WHEN 6 THEN 'ncclFuncSend' WHEN 7 THEN 'ncclFuncRecv'
  WHEN 8 THEN 'ncclNumFuncs' ELSE 'Unknown' END AS func_name,
  concat(from_rank, '->', to_rank) AS flow, concat(src_ip, '->', dst_ip) AS ip_flow
  FROM link_transfers)"""


def _numbered_sends(spark: SparkSession, sf: str) -> tuple[DataFrame, bool]:
    """Per device: sends numbered by ship date, order and line (one row_number per device), and whether one was cut."""
    from fleetlens.plans.ordered import OrderedGroups
    s = F.col("l_suppkey")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.concat(F.lit("n"), s % 4).alias("nic"), (s % 2).cast("int").alias("dev"),
        (F.col("l_quantity").cast("bigint") * 100).alias("size"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("_d"),
        "l_orderkey", "l_linenumber")
    groups = OrderedGroups(rows, ["nic", "dev"], ["_d", "l_orderkey", "l_linenumber", "size"])
    rn = F.col("_pos").cast("bigint") + 1
    sends = groups.numbered("_pos", None).select(
        "nic", "dev", "size", div(rn, 200).alias("func_times"),
        (rn * 5000 + F.col("size")).alias("t_ns"), rn.alias("rn"))
    return sends, groups.split


def link_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """The numbered sends; where a device had to be cut they are written once, as their readers go over them several times."""
    from fleetlens.plans.durable import cut_lineage
    sends, split = _numbered_sends(spark, sf)
    return cut_lineage(sends) if split else sends


def telemetry_table(spark: SparkSession, sf: str, path: str) -> str:
    """The numbered sends as a table at ``path``, written once in any case."""
    _numbered_sends(spark, sf)[0].write.parquet(path)
    return path


TELE_SQL = """r AS (SELECT concat('n', l_suppkey % 4) AS nic, CAST(l_suppkey % 2 AS INT) AS dev,
  CAST(l_quantity AS BIGINT)*100 AS size, row_number() OVER (PARTITION BY l_suppkey % 4, l_suppkey % 2
   ORDER BY l_shipdate, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT)) AS rn FROM lineitem),
link_telemetry AS (SELECT nic, dev, size, rn // 200 AS func_times, rn*5000 + size AS t_ns, rn FROM r)"""


def alert_polls(spark: SparkSession, sf: str) -> DataFrame:
    return (_events(spark, sf).where("event_type = 'error'").select(
        F.col("tick").alias("poll"), F.concat(F.lit("fp"), F.col("user_id")).alias("fingerprint"),
        F.concat(F.lit("Alert"), F.col("user_id") % 7).alias("alertname"),
        F.concat(F.lit("P"), F.col("user_id") % 4).alias("severity")).distinct())


POLL_SQL = EVENTS_SQL + """, alert_polls AS (
 SELECT DISTINCT tick AS poll, concat('fp', user_id) AS fingerprint,
  concat('Alert', user_id % 7) AS alertname, concat('P', user_id % 4) AS severity
 FROM e WHERE event_type = 'error')"""


def alert_store(spark: SparkSession, sf: str) -> DataFrame:
    """One stored alert row per error or click event."""
    k, u = F.col("k"), F.col("user_id")
    return (_events(spark, sf).where("event_type IN ('error', 'click')").select(
        F.concat(F.lit("fp"), u).alias("fingerprint"),
        F.concat(F.lit("Alert"), u % 13).alias("alertname"),
        F.concat(F.lit("P"), u % 5).alias("severity"),
        F.when(k % 3 == 0, "active").when(k % 3 == 1, "firing").otherwise("resolved")
        .alias("status"),
        F.col("ts").cast("timestamp").alias("created_at"),
        (k % 7 == 0).alias("is_recurrence"), (k % 5).alias("repeat_push_count"),
        (k % 4).alias("recurrence_count"), "event_id", "us"))


STORE_SQL = EVENTS_SQL + """, alert_store AS (
 SELECT concat('fp', user_id) AS fingerprint, concat('Alert', user_id % 13) AS alertname,
  concat('P', user_id % 5) AS severity,
  CASE k % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'firing' ELSE 'resolved' END AS status,
  ts AS created_at, k % 7 = 0 AS is_recurrence, k % 5 AS repeat_push_count,
  k % 4 AS recurrence_count, event_id, us FROM e WHERE event_type IN ('error', 'click'))"""


def alert_json(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshot objects as the alert manager's API returns them, one per error event."""
    k, u = F.col("k"), F.col("user_id")
    e = _events(spark, sf).where("event_type = 'error'")
    state = F.when(k % 3 == 0, "active").when(k % 3 == 1, "firing").otherwise("resolved")
    base = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    shifted = F.date_format(F.col("ts").cast("timestamp") + F.expr("INTERVAL 8 HOURS"),
                            "yyyy-MM-dd'T'HH:mm:ss")
    starts = F.when(k % 3 == 0, F.concat(base, F.lit("Z"))).when(
        k % 3 == 1, F.concat(shifted, F.lit("+08:00"))).otherwise(base)

    def opt(cond, name, value):
        return F.when(cond, F.concat(F.lit(f',"{name}":"'), value, F.lit('"'))).otherwise("")
    labels = F.concat(
        F.lit('{"severity":"P'), u % 4, F.lit('"'),
        opt(k < 90, "alertname", F.concat(F.lit("Alert"), u % 7)),
        opt(u % 5 != 0, "node", F.concat(F.lit("node"), u % 9)),
        opt(u % 3 != 0, "host_ip", F.concat(F.lit("10.2.0."), u % 16)),
        opt(u % 4 == 1, "namespace", F.concat(F.lit("ns"), u % 6)),
        opt(u % 4 == 2, "exported_namespace", F.concat(F.lit("ex"), u % 6)),
        opt(k % 2 == 1, "cluster", F.concat(F.lit("c"), k % 4)),
        opt(k % 5 == 0, "deployment", F.concat(F.lit("d"), u % 3)),
        opt(F.lit(True), "instance", F.concat(F.lit("10.1.0."), u % 16)), F.lit("}"))
    status = F.when(k % 2 == 0, F.concat(F.lit('{"state":"'), state, F.lit('"}'))).otherwise(
        F.concat(F.lit('"'), state, F.lit('"')))
    fp = F.when(k >= 95, F.lit("")).otherwise(F.concat(F.lit("fp"), u))
    return e.select("event_id", F.col("tick").alias("poll"), F.concat(
        F.lit('{"fingerprint":"'), fp, F.lit('","status":'), status,
        F.lit(',"labels":'), labels, F.lit(',"annotations":{"summary":"s'), k,
        F.lit('"},"startsAt":"'), starts, F.lit('"}')).alias("value"))


SNAP_SQL = EVENTS_SQL + """, snap AS (
 SELECT event_id, tick AS poll,
  CASE WHEN k >= 95 THEN '' ELSE concat('fp', user_id) END AS fingerprint,
  CASE k % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'firing' ELSE 'resolved' END AS state,
  concat('P', user_id % 4) AS severity,
  CASE WHEN k < 90 THEN concat('Alert', user_id % 7) END AS alertname,
  CASE WHEN user_id % 5 <> 0 THEN concat('node', user_id % 9) END AS node,
  CASE WHEN user_id % 3 <> 0 THEN concat('10.2.0.', user_id % 16) END AS host_ip,
  CASE WHEN user_id % 4 = 1 THEN concat('ns', user_id % 6) END AS namespace,
  CASE WHEN user_id % 4 = 2 THEN concat('ex', user_id % 6) END AS exported_namespace,
  CASE WHEN k % 2 = 1 THEN concat('c', k % 4) END AS cluster,
  CASE WHEN k % 5 = 0 THEN concat('d', user_id % 3) END AS deployment,
  concat('10.1.0.', user_id % 16) AS instance, concat('s', k) AS summary,
  date_trunc('second', ts) AS starts_at, user_id, k FROM e WHERE event_type = 'error')"""


def metric_samples(spark: SparkSession, sf: str) -> DataFrame:
    """(metric, instance, ts, us, value): one sample per event."""
    return _events(spark, sf).select(
        F.col("event_type").alias("metric"), (F.col("user_id") % 8).cast("int").alias("instance"),
        F.col("ts").cast("timestamp").alias("ts"), "us", "tick", "value", "event_id", "k")


METRIC_SQL = EVENTS_SQL + """, metric_samples AS (
 SELECT event_type AS metric, CAST(user_id % 8 AS INT) AS instance, ts, us, tick, value, event_id, k
 FROM e)"""


def heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select(
        (F.col("user_id") % 8).alias("client_id"), F.col("ts").cast("timestamp").alias("ts"), "us")


HEART_SQL = EVENTS_SQL + """, heartbeats AS (
 SELECT user_id % 8 AS client_id, ts, us FROM e)"""


# ---- metric rule samples ------------------------------------------------------------------

SQUEEZE = 48  # sample time runs 48 times faster: a four-hour tick becomes five minutes
_BAD = "CASE WHEN k < 30 THEN 0 ELSE 1 END"
_HIGH = "CASE WHEN k < 35 THEN 1 ELSE 0 END"
_COUNT = "CAST(event_id AS DOUBLE)"
_SENSOR = {"sensor_name": "concat('s', k % 2)"}
# metric -> (value, labels), as text that both SQL dialects read
METRICS: dict[str, tuple[str, dict[str, str]]] = {
    "DCGM_FI_DEV_GPU_TEMP": ("value", {"gpu": "concat('g', k % 2)"}),
    "DCGM_FI_DEV_POWER_USAGE": ("value * 4", {"gpu": "concat('g', k % 2)"}),
    "DCGM_FI_DEV_ECC_DBE_VOL_TOTAL": (_HIGH, {"gpu": "concat('g', k % 2)"}),
    "up": ("CASE WHEN k < 25 THEN 0 ELSE 1 END", {
        "job": "CASE WHEN k % 2 = 0 THEN 'nvidia-gpu-exporter' ELSE 'ipmi-exporter' END"}),
    "node_cpu_seconds_total": (_COUNT, {
        "mode": "CASE WHEN k % 5 = 4 THEN 'user' ELSE 'idle' END", "cpu": "concat('c', k % 2)"}),
    "node_memory_MemAvailable_bytes": ("value", {}),
    "node_memory_MemTotal_bytes": ("500", {}),
    "node_filesystem_avail_bytes": ("value", {"mountpoint": "concat('/d', k % 2)"}),
    "node_filesystem_size_bytes": ("400 + k", {"mountpoint": "concat('/d', k % 2)"}),
    "node_network_receive_errs_total": (f"{_COUNT} * 3 / 10", {"device": "concat('e', k % 2)"}),
    "node_network_transmit_errs_total": (f"{_COUNT} / 4", {"device": "concat('e', k % 2)"}),
    "kube_pod_container_status_restarts_total": (
        f"{_COUNT} * 11 / 20 - 80 * floor({_COUNT} / 400)", {"pod": "concat('p', k % 2)"}),
    "kube_pod_status_phase": (_HIGH, {
        "phase": "CASE k % 4 WHEN 0 THEN 'Running' WHEN 1 THEN 'Pending' WHEN 2 THEN 'Failed'"
                 " ELSE 'Succeeded' END"}),
    "kube_node_status_condition": (_HIGH, {
        "condition": "CASE WHEN k % 4 = 3 THEN 'DiskPressure' ELSE 'Ready' END",
        "status": "CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END"}),
    "ipmi_sensor_state": (_BAD, _SENSOR),
    "ipmi_sensor_temperature_celsius": ("value", _SENSOR),
    "ipmi_sensor_fan_speed_rpm": ("CASE WHEN k < 30 THEN 0 ELSE value * 10 END", _SENSOR),
    "ipmi_sensor_power_state": (_BAD, _SENSOR),
    "ipmi_sensor_voltage_volts": ("value / 300 + CAST(11.45 AS DOUBLE)", _SENSOR),
    "ipmi_sensor_memory_ecc_errors": (_HIGH, _SENSOR),
    "ipmi_sensor_disk_state": (_BAD, _SENSOR),
    "ipmi_sensor_network_interface_state": (_BAD, _SENSOR),
}


def _label_set(metric: str) -> dict[str, str]:
    return {"instance": "concat('i', user_id % 8)", **METRICS[metric][1]}


def samples_of(events: DataFrame, *metrics: str) -> DataFrame:
    """(metric, labels, us, ts, value): every event is a sample of each asked metric."""
    def sample(m):
        pairs = [c for k, v in _label_set(m).items() for c in (F.lit(k), F.expr(v))]
        return F.struct(F.lit(m).alias("metric"), F.create_map(*pairs).alias("labels"),
                        F.expr(METRICS[m][0]).cast("double").alias("value"))
    us = div(F.col("us"), SQUEEZE)
    rows = events.withColumn("_m", F.explode(F.array(*[sample(m) for m in metrics])))
    return rows.select("_m.metric", "_m.labels", us.alias("us"),
                       F.timestamp_micros(us).alias("ts"), "_m.value")


def rule_samples(spark: SparkSession, sf: str, *metrics: str) -> DataFrame:
    return samples_of(_events(spark, sf), *metrics)


def samples_sql(*metrics: str) -> str:
    """CTE ``samples`` (metric, series, instance, us, tick, value + label columns as text)."""
    parts = []
    for m in metrics:
        labels = _label_set(m)
        text = " || ',' || ".join(f"'\"{k}\":\"' || {v} || '\"'"
                                  for k, v in sorted((k, f"({v})") for k, v in labels.items()))
        own = ", ".join(f"{v} AS l_{k}" for k, v in labels.items() if k != "instance")
        parts.append(f"s{len(parts)} AS (SELECT '{m}' AS metric, '{{' || {text} || '}}' AS series,"
                     f" {labels['instance']} AS instance, us // {SQUEEZE} AS us,"
                     f" us // {SQUEEZE} // 300000000 AS tick,"
                     f" CAST({METRICS[m][0]} AS DOUBLE) AS value{', ' + own if own else ''} FROM e)")
    return EVENTS_SQL + ", " + ", ".join(parts)
