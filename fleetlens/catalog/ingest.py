"""Source, parsing, lookup and topology queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.catalog import fixtures as X
from fleetlens.catalog.fixtures import COMM_SQL, LINE_SQL, TOPOLOGY as T
from fleetlens.catalog.registry import add
from fleetlens.functions import calls as FC
from fleetlens.functions import parsing as P
from fleetlens.functions.topology import with_coordinates
from fleetlens.operators import topology as TP
from fleetlens.plans.durable import scratch_path
from fleetlens.sources import links as SL
from fleetlens.sources import logs as L


def _written_lines(s, d, codec: str | None) -> str:
    """Call lines as text files, one folder per rank."""
    path = scratch_path(s, "lines")
    writer = X.call_lines(s, d).select("rank", "value").write.partitionBy("rank")
    (writer.option("compression", codec) if codec else writer).text(path)
    return path


def _per_rank(calls: DataFrame) -> DataFrame:
    return calls.groupBy("rank").agg(F.count(F.lit(1)).alias("calls"),
                                     F.count("group_hash").alias("hashed"),
                                     F.max("ts_ns").alias("last_ns"))


_PER_RANK = LINE_SQL + """ SELECT rank, count(*) AS calls, count(group_hash) AS hashed,
 max(ts_ns) AS last_ns FROM parsed GROUP BY 1"""

add("s1_discovered_logs", lambda s, d: _per_rank(L.read_calls(s, _written_lines(s, d, None))), _PER_RANK)
add("s2_gzip_logs", lambda s, d: _per_rank(L.read_calls(s, _written_lines(s, d, "gzip"))), _PER_RANK)
add("s2_bzip2_logs", lambda s, d: _per_rank(L.read_calls(s, _written_lines(s, d, "bzip2"))), _PER_RANK)

add("s3_parse_calls", lambda s, d: P.parse_calls(X.call_lines(s, d).select("event_id", "value"))
    .drop("timestamp"), LINE_SQL + " SELECT * FROM parsed")

add("s3_quarantined_lines", lambda s, d: P.unparsed_calls(X.call_lines(s, d)).select("event_id", "value"),
    LINE_SQL + " SELECT event_id, value FROM call_lines WHERE k >= 93")

add("s4_parse_short_calls", lambda s, d: P.parse_short_calls(X.call_lines(s, d).select(
    "event_id", F.regexp_replace("value", r"^\[save_count \d+\] ", "").alias("value"))), LINE_SQL + """
SELECT event_id, ts_ns, rank, function, data_size FROM parsed""")


def _file_names(s, d):
    r = F.col("rank").cast("string")
    kind = F.col("k") % 6
    name = (F.when(kind == 0, F.concat(F.lit("rank_"), r, F.lit(".log")))
            .when(kind == 1, F.concat(r, F.lit(".log")))
            .when(kind == 2, F.concat(F.lit("log_"), r, F.lit(".txt")))
            .when(kind == 3, F.concat(F.lit("rank"), r, F.lit(".log")))
            .when(kind == 4, F.concat(F.lit("w"), r, F.lit("_7.err"))).otherwise("app.log"))
    return X.call_lines(s, d).select("event_id", "rank", "k", name.alias("name"))


add("s5_rank_of_file", lambda s, d: _file_names(s, d).select(
    "event_id", P.rank_of_file(F.col("name")).alias("rank")), LINE_SQL + """
SELECT event_id, CASE WHEN k % 6 = 5 THEN -1 ELSE rank END AS rank FROM call_lines""")

add("s6_file_checks", lambda s, d: L.file_checks(X.call_lines(s, d).select(
    F.concat(F.lit("rank_"), "rank", F.lit(".log")).alias("file")), T.world_size), LINE_SQL + """
SELECT count(DISTINCT rank) AS files, 8 AS world_size, count(DISTINCT rank) = 8 AS one_per_rank,
 count(DISTINCT rank) > 0 AS any_file FROM call_lines""")


def _long_lines(s, d):
    padded = F.concat("value", F.repeat(F.lit("0"), F.when(F.col("k") >= 6, F.col("k")).otherwise(0)))
    return X.call_lines(s, d).select("event_id", padded.alias("value"))


add("s14_truncated_lines", lambda s, d: _long_lines(s, d).select(
    "event_id", P.truncated(F.col("value")).alias("unreliable")), LINE_SQL + """
, long AS (SELECT event_id, concat(value, repeat('0', CASE WHEN k >= 6 THEN k ELSE 0 END)) AS value
 FROM call_lines)
SELECT event_id, length(regexp_replace(value, '^\\[save_count \\d+\\] ', '')) >= 127
 OR NOT regexp_matches(value, 'groupHash -?\\d+') AS unreliable FROM long""")

# ---- links --------------------------------------------------------------------------------


def _link_lines(s, d):
    t = X.link_transfers(s, d)
    names = iter(t.columns)
    line = F.concat(*[F.coalesce(F.col(next(names)).cast("string"), F.lit("null")) if part == "%" else F.lit(part) for part in
                      re.split("(%)", "%:%:%: Group:%, from rank % to rank %, channel_id:%, func:%,FuncTimes:%,"
                                      " %->% send % Bytes used % nsec") if part])
    # lines of transfers above 200 000 bytes are damaged
    damage = F.when(F.col("bytes_sent") > 200_000, "?? ").otherwise("")
    return t.select(F.concat(damage, line).alias("value"))


add("s7_parse_links", lambda s, d: P.parse_links(_link_lines(s, d)).groupBy(
    "node", "card", "grp", "func", "func_times").agg(
        F.count(F.lit(1)).alias("sends"), F.sum("bytes_sent").alias("bytes"),
        F.sum("nsec").alias("nsec"), F.max("ts").alias("last_ts")), X.LINK_SQL + """
SELECT node, card, grp, func, func_times, count(*) AS sends, CAST(sum(bytes_sent) AS BIGINT) AS bytes,
 CAST(sum(nsec) AS BIGINT) AS nsec, max(ts) AS last_ts FROM link_transfers
WHERE bytes_sent <= 200000 GROUP BY ALL""")


def _telemetry_files(s, d):
    """Telemetry CSV with every row written twice, as overlapping rotated files would hold it."""
    t = X.link_transfers(s, d)
    unsigned = F.when(F.col("grp") % 2 == 0, F.concat(
        F.lit("1844674407370955160"), F.col("grp"))).otherwise(F.col("grp").cast("string"))
    rows = t.select(
        F.col("ts").cast("string").alias("Time"), unsigned.alias("Group"),
        F.col("from_rank").alias("FromRank"), F.col("to_rank").alias("ToRank"),
        (F.col("from_rank") % 2).alias("DevIndex"), F.col("func").alias("Func"),
        F.col("func_times").alias("FuncTimes"), F.col("src_ip").alias("SrcIP"),
        F.col("dst_ip").alias("DstIP"), F.col("channel").alias("Bandwidth"),
        F.lit(1).alias("SendWrCounter"), F.col("bytes_sent").cast("int").alias("RemainWrDataSize"),
        F.col("nsec").alias("Timestamp"), F.explode(F.array(F.lit(1), F.lit(2))).alias("_copy"))
    path = scratch_path(s, "telemetry")
    rows.drop("_copy").write.option("header", True).csv(path)
    return path


add("s8_link_telemetry", lambda s, d: SL.read_telemetry(s, _telemetry_files(s, d), "*.csv").groupBy(
    "group_hash", "DevIndex", "Func").agg(F.count(F.lit(1)).alias("sends"),
                                          F.sum("Timestamp").alias("nsec")), X.LINK_SQL + """
, u AS (SELECT DISTINCT ts, grp, from_rank, to_rank, func, func_times, src_ip, dst_ip, channel,
 bytes_sent, nsec FROM link_transfers)
SELECT CAST(CASE WHEN grp % 2 = 0 THEN grp - 16 ELSE grp END AS BIGINT) AS group_hash,
 from_rank % 2 AS DevIndex, func AS Func, count(*) AS sends, CAST(sum(nsec) AS BIGINT) AS nsec
FROM u GROUP BY ALL""")

add("p8_large_transfers", lambda s, d: SL.large_transfers(X.link_transfers(s, d), 16, "bytes_sent")
    .groupBy("card").agg(F.count(F.lit(1)).alias("sends")), X.LINK_SQL + """
SELECT card, count(*) AS sends FROM link_transfers WHERE bytes_sent > 16 GROUP BY 1""")

add("f13_link_functions", lambda s, d: X.link_transfers(s, d).groupBy(
    FC.link_function(F.col("func")).alias("func_name")).agg(F.count(F.lit(1)).alias("sends")),
    X.LINK_SQL + " SELECT func_name, count(*) AS sends FROM fn GROUP BY 1")

add("f14_flow_keys", lambda s, d: X.link_transfers(s, d).select(
    FC.arrow(F.col("from_rank"), F.col("to_rank")).alias("flow"),
    FC.arrow(F.col("src_ip"), F.col("dst_ip")).alias("ip_flow")).groupBy("flow", "ip_flow").count(),
    X.LINK_SQL + " SELECT flow, ip_flow, count(*) AS count FROM fn GROUP BY 1, 2")

add("f15_signed_hashes", lambda s, d: X.comm_ops(s, d).select("event_id", P.signed64(F.when(
    F.col("group_hash") < 0, F.lit("18446744073709551616").cast("decimal(20,0)") + F.col("group_hash"))
    .otherwise(F.col("group_hash")).cast("decimal(20,0)").cast("string")).alias("group_hash")),
    COMM_SQL + " SELECT event_id, group_hash FROM comm_ops")

# ---- lookups ------------------------------------------------------------------------------

add("f5_operation_classes", lambda s, d: X.comm_ops(s, d).groupBy("function").agg(
    F.count(F.lit(1)).alias("calls")).withColumn("kind", FC.operation_class(F.col("function"))),
    COMM_SQL + """ SELECT function, count(*) AS calls, CASE WHEN function IN ('AllReduce', 'AllGather',
 'Broadcast', 'Reduce', 'Scatter', 'Gather') THEN 'collective' WHEN function IN ('Send', 'Recv', 'SendRecv')
 THEN 'point_to_point' WHEN function IN ('Barrier', 'Wait', 'Synchronize') THEN 'synchronization'
 ELSE 'other' END AS kind FROM comm_ops GROUP BY 1""")

add("f6_size_buckets", lambda s, d: X.comm_ops(s, d).select(
    FC.size_bucket(F.col("data_size") * 8192).alias("bucket")).groupBy("bucket").count(), COMM_SQL + """
SELECT CASE WHEN data_size * 8192 >= 104857600 THEN 'huge' WHEN data_size * 8192 >= 10485760 THEN 'large'
 WHEN data_size * 8192 >= 1048576 THEN 'medium' WHEN data_size * 8192 >= 1024 THEN 'small' ELSE 'tiny' END
 AS bucket, count(*) AS count FROM comm_ops GROUP BY 1""")

# ---- topology -----------------------------------------------------------------------------

_COORD = """rank % 2 AS tp_pos, rank // 2 AS tp_group, rank // 4 AS pp_stage, rank % 4 AS pp_group,
 (rank // 2) % 2 AS dp_pos, (rank // 4) * 2 + rank % 2 AS dp_group"""

add("f1_coordinates", lambda s, d: with_coordinates(X.comm_ops(s, d).select("event_id", "rank"), T),
    COMM_SQL + f" SELECT event_id, rank, {_COORD} FROM comm_ops")

add("f2_topology", lambda s, d: TP.topology_table(X.comm_ops(s, d), T), COMM_SQL + f"""
SELECT DISTINCT rank, {_COORD}, rank // 4 = 0 AS is_first_pp, rank // 4 = 1 AS is_last_pp FROM comm_ops""")

add("f2_parallel_groups", lambda s, d: TP.parallel_groups(X.comm_ops(s, d), T).select(
    "group_type", "gid", F.array_join("ranks", ",").alias("ranks")), COMM_SQL + f"""
, t AS (SELECT DISTINCT rank, {_COORD} FROM comm_ops),
g AS (SELECT 'TP' AS group_type, tp_group AS gid, rank FROM t UNION ALL SELECT 'PP', pp_group, rank FROM t
 UNION ALL SELECT 'DP', dp_group, rank FROM t)
SELECT group_type, gid, string_agg(rank, ',' ORDER BY rank) AS ranks FROM g GROUP BY 1, 2""")


def _configs(s, d):
    k = F.col("s_suppkey")
    return s.read.parquet(f"{d}/supplier.parquet").select(
        k.alias("config_id"), (1 + k % 8).cast("int").alias("tp"), (1 + k % 4).cast("int").alias("pp"),
        (1 + k % 64).cast("int").alias("world_size"))


add("s13_topology_configs", lambda s, d: TP.check_topologies(_configs(s, d)), """
c AS (SELECT s_suppkey AS config_id, CAST(1 + s_suppkey % 8 AS INT) AS tp,
 CAST(1 + s_suppkey % 4 AS INT) AS pp, CAST(1 + s_suppkey % 64 AS INT) AS world_size FROM supplier)
SELECT *, world_size // (tp * pp) AS dp, CASE WHEN tp * pp > world_size THEN 'tp_pp_exceeds_world'
 WHEN world_size % (tp * pp) <> 0 THEN 'not_divisible' ELSE 'ok' END AS verdict FROM c""")


def _models(s, d):
    k = F.col("s_suppkey")
    return s.read.parquet(f"{d}/supplier.parquet").select(
        k.alias("config_id"), (1 + k % 16).cast("int").alias("ranks"),
        (8 + k % 56).alias("num_layers"), (1_000_000 + k * 7919).alias("model_size"),
        (128 * (1 + k % 32)).alias("hidden_size"), (1000 + k % 5000).alias("vocab_size"))


PLACE_SQL = """m AS (SELECT s_suppkey AS config_id, 1 + s_suppkey % 16 AS n, 8 + s_suppkey % 56 AS layers,
 1000000 + s_suppkey * 7919 AS size, 128 * (1 + s_suppkey % 32) AS hidden,
 1000 + s_suppkey % 5000 AS vocab FROM supplier),
r AS (SELECT *, CAST(unnest(range(0, n)) AS INT) AS rank FROM m),
place AS (SELECT config_id, rank, n, layers, hidden, (layers // n) * rank AS start_layer,
 CASE WHEN rank = n - 1 THEN layers ELSE (layers // n) * (rank + 1) END AS end_layer,
 (size // n) * rank AS start_param,
 CASE WHEN rank = n - 1 THEN size ELSE (size // n) * (rank + 1) END AS end_param,
 hidden * hidden * 4 // n AS att, hidden * hidden * 16 // n AS ffn,
 CASE WHEN rank = 0 THEN vocab * hidden * 4 // n ELSE 0 END AS emb FROM r)"""

add("f3_model_placement", lambda s, d: TP.placement(_models(s, d)), PLACE_SQL + """
SELECT config_id, rank, start_layer, end_layer, round(100.0 * (end_layer - start_layer) / layers + 1e-9, 6) AS layer_pct,
 start_param, end_param, round(att / 1048576 + 1e-9, 6) AS attention_mb, round(ffn / 1048576 + 1e-9, 6) AS ffn_mb,
 round(emb / 1048576 + 1e-9, 6) AS embedding_mb, round((att + ffn + emb) / 1048576 + 1e-9, 6) AS total_mb,
 layers AS allreduce_calls, att AS volume_per_call, round(1.0 / n + 1e-9, 6) AS ideal_efficiency,
 n - 1 AS overhead_factor FROM place""")


def _expected(s, d):
    """Placement with planted faults: a missing rank, shifted layers, shifted parameters."""
    base = TP.placement(_models(s, d))
    c, r = F.col("config_id"), F.col("rank")
    shifted = base.withColumn("end_layer", F.col("end_layer") + F.when((c % 7 == 0) & (r == 0), 1)
                              .otherwise(0)).withColumn(
        "end_param", F.col("end_param") + F.when((c % 5 == 0) & (r == 1), 1).otherwise(0))
    moved = F.when((c % 11 == 0) & (r == 2), 99).otherwise(r)
    return shifted.withColumn("rank", moved)


add("f4_placement_mismatches", lambda s, d: TP.placement_mismatches(
    _expected(s, d), TP.placement(_models(s, d))), PLACE_SQL + """
SELECT config_id, rank, CASE WHEN config_id % 11 = 0 AND rank = 2 THEN 'unexpected_rank'
 WHEN config_id % 7 = 0 AND rank = 0 THEN 'layers' ELSE 'parameters' END AS reason FROM place
WHERE (config_id % 11 = 0 AND rank = 2) OR (config_id % 7 = 0 AND rank = 0)
 OR (config_id % 5 = 0 AND rank = 1)
UNION ALL SELECT config_id, 99, 'missing_rank' FROM place WHERE config_id % 11 = 0 AND rank = 2""")
