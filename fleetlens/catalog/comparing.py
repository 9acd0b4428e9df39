"""Slow-rank queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog.fixtures import COMM_SQL, TOPOLOGY as T, comm_ops
from fleetlens.catalog.registry import add
from fleetlens.functions.topology import with_coordinates
from fleetlens.operators import compare as C
from fleetlens.operators import outliers as U

_KEY = "group_type, gid, op_count, group_hash"
MEMBER_SQL = COMM_SQL + f""", lat AS (
 SELECT rank, op_count, group_hash, max(ts_ns) AS ts_ns FROM comm_ops
 WHERE group_hash IS NOT NULL GROUP BY ALL),
mem AS (
 SELECT 'GLOBAL' AS group_type, 0 AS gid, op_count, group_hash, rank, ts_ns FROM lat
 UNION ALL SELECT 'TP', rank // 2, op_count, group_hash, rank, ts_ns FROM lat
 UNION ALL SELECT 'DP', (rank // 4) * 2 + rank % 2, op_count, group_hash, rank, ts_ns FROM lat),
seen AS (SELECT DISTINCT rank FROM comm_ops),
want AS (
 SELECT 'GLOBAL' AS group_type, 0 AS gid, count(*) AS expected FROM seen HAVING count(*) = 8
 UNION ALL SELECT 'TP', rank // 2, count(*) FROM seen GROUP BY 1, 2
 UNION ALL SELECT 'DP', (rank // 4) * 2 + rank % 2, count(*) FROM seen GROUP BY 1, 2),
placed AS (
 SELECT m.*, w.expected, row_number() OVER o AS place, lead(ts_ns) OVER o AS next_ns,
  count(*) OVER (PARTITION BY {_KEY}) AS members
 FROM mem m JOIN want w USING (group_type, gid)
 WINDOW o AS (PARTITION BY {_KEY} ORDER BY ts_ns DESC, rank DESC)),
judged AS (SELECT * FROM placed WHERE members = expected AND members > 1),
stats AS (
 SELECT group_type, CASE WHEN group_type = 'GLOBAL' THEN group_hash ELSE gid END AS group_id, rank,
  count(*) AS participations, CAST(sum(CASE WHEN place = 1 THEN 1 ELSE 0 END) AS BIGINT) AS picks,
  CAST(sum(CASE WHEN place = 1 THEN greatest(ts_ns - next_ns, 0) ELSE 0 END) AS BIGINT) AS lag_ns
 FROM judged GROUP BY ALL)"""

add("a1_latest_per_rank", lambda s, d: C.latest_per_rank(comm_ops(s, d)),
    MEMBER_SQL + " SELECT rank, op_count, group_hash, ts_ns FROM lat")

add("a5_slow_picks", lambda s, d: C.slow_picks(comm_ops(s, d), T), MEMBER_SQL + """
SELECT group_type, CAST(gid AS INT) AS gid, op_count, group_hash, rank AS slowest_rank, members,
 round(greatest(ts_ns - next_ns, 0) / 1e9 + 1e-9, 6) AS lag_s FROM judged WHERE place = 1""")

add("a5_comparison_totals", lambda s, d: C.comparison_totals(comm_ops(s, d), T), MEMBER_SQL + f"""
, g AS (SELECT {_KEY}, count(*) AS members FROM mem GROUP BY ALL)
SELECT group_type, count(*) AS groups_formed,
 CAST(sum(CASE WHEN members = expected AND members > 1 THEN 1 ELSE 0 END) AS BIGINT) AS groups_judged,
 max(members) AS largest_group FROM g LEFT JOIN want USING (group_type, gid) GROUP BY 1""")

add("a6_normalised_picks", lambda s, d: C.normalised_picks(comm_ops(s, d), T), MEMBER_SQL + """
, net AS (SELECT *, picks - min(picks) OVER (PARTITION BY group_type, group_id) AS net FROM stats)
SELECT rank, group_type, CAST(sum(net) AS BIGINT) AS normalised, CAST(sum(picks) AS BIGINT) AS picks
FROM net GROUP BY 1, 2""")

add("a6_normalised_picks_compat", lambda s, d: C.normalised_picks(comm_ops(s, d), T, compat=True),
    MEMBER_SQL + """
, net AS (SELECT *, picks - min(picks) OVER (PARTITION BY group_type, group_id) AS net FROM stats
 WHERE picks > 0)
SELECT rank, group_type, CAST(sum(net) AS BIGINT) AS normalised, CAST(sum(picks) AS BIGINT) AS picks
FROM net GROUP BY 1, 2""")

add("a7_pick_rates", lambda s, d: C.pick_rates(comm_ops(s, d), T), MEMBER_SQL + """
SELECT rank, group_type, CAST(sum(picks) AS BIGINT) AS picks,
 CAST(sum(participations) AS BIGINT) AS participations,
 round(100.0 * sum(picks) / sum(participations) + 1e-9, 6) AS rate_pct,
 round(CAST(sum(lag_ns) AS DOUBLE) / 1e9 + 1e-9, 6) AS lag_s FROM stats GROUP BY 1, 2""")

add("p2_hashed_calls", lambda s, d: C.hashed(comm_ops(s, d)).groupBy("function", "group_hash").agg(
    F.count(F.lit(1)).alias("calls")),
    COMM_SQL + " SELECT function, group_hash, count(*) AS calls FROM comm_ops"
               " WHERE group_hash IS NOT NULL GROUP BY 1, 2")

add("p3_complete_groups", lambda s, d: C.complete_groups(comm_ops(s, d), T), MEMBER_SQL + f"""
SELECT {_KEY.replace('gid', 'CAST(gid AS INT) AS gid')}, count(*) AS members, any_value(expected)
 AS expected FROM mem JOIN want USING (group_type, gid) GROUP BY ALL
HAVING count(*) = any_value(expected)""")

add("p4_global_hashes", lambda s, d: C.global_hashes(comm_ops(s, d), T), COMM_SQL + """
SELECT group_hash, count(DISTINCT rank) AS ranks FROM comm_ops WHERE group_hash IS NOT NULL
GROUP BY 1 HAVING count(DISTINCT rank) = 8""")

add("j1_calls_by_coordinates", lambda s, d: with_coordinates(comm_ops(s, d), T).groupBy(
    "tp_group", "pp_stage", "dp_group", "function").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("data_size").alias("elements")), COMM_SQL + """
, topo AS (SELECT DISTINCT rank, rank // 2 AS tp_group, rank // 4 AS pp_stage,
 (rank // 4) * 2 + rank % 2 AS dp_group FROM comm_ops)
SELECT CAST(tp_group AS INT) AS tp_group, CAST(pp_stage AS INT) AS pp_stage,
 CAST(dp_group AS INT) AS dp_group, function, count(*) AS calls,
 CAST(sum(data_size) AS BIGINT) AS elements FROM comm_ops JOIN topo USING (rank) GROUP BY ALL""")

add("j2_calls_on_global_hashes", lambda s, d: C.global_calls(comm_ops(s, d), T).select(
    "event_id", "rank", "group_hash"), COMM_SQL + """
SELECT event_id, rank, group_hash FROM comm_ops WHERE group_hash IN (
 SELECT group_hash FROM comm_ops GROUP BY 1 HAVING count(DISTINCT rank) = 8)""")

add("u2_comparison_members", lambda s, d: C.comparison_members(comm_ops(s, d), T), MEMBER_SQL + """
SELECT group_type, CAST(gid AS INT) AS gid, op_count, group_hash, rank, ts_ns FROM mem""")

# ---- group hash detector ------------------------------------------------------------------

HASH_SQL = COMM_SQL + """, hg AS (
 SELECT group_hash, function, op_count, count(*) AS entries,
  arg_max(rank, (ts_ns, -rank)) AS slowest_rank, max(ts_ns) AS slowest_ns,
  CAST(median(ts_ns - 1704067200000000000) AS DOUBLE) AS mid
 FROM comm_ops WHERE group_hash IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2),
sc AS (SELECT group_hash, slowest_rank AS rank, count(*) AS slow_count FROM hg GROUP BY 1, 2),
num AS (SELECT group_hash, dense_rank() OVER (ORDER BY CAST(group_hash AS VARCHAR)) AS group_id
 FROM (SELECT DISTINCT group_hash FROM comm_ops WHERE group_hash IS NOT NULL)),
part AS (SELECT DISTINCT group_hash, rank FROM comm_ops WHERE group_hash IS NOT NULL),
cell AS (SELECT rank, group_hash, coalesce(slow_count, 0) AS slow_count,
  coalesce(slow_count, 0) - min(coalesce(slow_count, 0)) OVER (PARTITION BY group_hash) AS normalised
 FROM part LEFT JOIN sc USING (group_hash, rank)),
cmp AS (SELECT DISTINCT c.rank FROM comm_ops c JOIN hg USING (group_hash, function, op_count)),
matrix AS (SELECT rank, group_hash, CAST(group_id AS INT) AS group_id, slow_count, normalised
 FROM cell JOIN num USING (group_hash) WHERE rank IN (SELECT rank FROM cmp))"""

add("a13_group_hash_slowest", lambda s, d: C.hash_groups(comm_ops(s, d)), HASH_SQL + """
SELECT group_hash, function, op_count, entries, slowest_rank, slowest_ns FROM hg""")

add("a13_group_hash_slow_counts", lambda s, d: C.hash_slow_counts(comm_ops(s, d)),
    HASH_SQL + " SELECT group_hash, rank, slow_count FROM sc")

add("a14_group_numbers", lambda s, d: C.group_numbers(comm_ops(s, d)),
    HASH_SQL + " SELECT group_hash, CAST(group_id AS INT) AS group_id FROM num")

add("a15_slow_matrix", lambda s, d: C.slow_matrix(comm_ops(s, d)),
    HASH_SQL + " SELECT rank, group_hash, group_id, slow_count, normalised FROM matrix")

add("j5_slow_matrix_wide", lambda s, d: C.slow_matrix_wide(comm_ops(s, d)), HASH_SQL + " SELECT rank, "
    + ", ".join(f"max(CASE WHEN group_id = {i} THEN normalised END) AS g{i}" for i in range(1, 6))
    + " FROM matrix GROUP BY 1")

def _text(values):
    return F.concat_ws(",", F.transform(values, lambda x: x.cast("string")))


add("j5_slow_matrix_maps", lambda s, d: C.slow_matrix_maps(comm_ops(s, d)).select(
    "rank", F.size("groups").cast("bigint").alias("members"), _text(F.map_keys("groups")).alias("ids"),
    _text(F.map_values("groups")).alias("counts")), HASH_SQL + """
SELECT rank, count(*) AS members, string_agg(CAST(group_id AS VARCHAR), ',' ORDER BY group_id) AS ids,
 string_agg(CAST(normalised AS VARCHAR), ',' ORDER BY group_id) AS counts FROM matrix GROUP BY 1""")

_TOTALS = """, parts AS (SELECT rank, count(*) AS participations FROM (
 SELECT DISTINCT c.rank, group_hash, function, op_count
 FROM comm_ops c JOIN hg USING (group_hash, function, op_count)) GROUP BY 1),
lead AS (SELECT slowest_rank AS rank, count(*) AS slow_count,
 sum(slowest_ns - 1704067200000000000 - mid) / 1e9 AS slow_time_s FROM hg GROUP BY 1)"""

add("a16_group_hash_totals", lambda s, d: C.hash_rank_totals(comm_ops(s, d)).withColumn(
    "slow_time_s", F.round("slow_time_s", 4)), HASH_SQL + _TOTALS + """
SELECT rank, coalesce(slow_count, 0) AS slow_count, participations,
 round(100.0 * coalesce(slow_count, 0) / participations + 1e-9, 6) AS rate_pct,
 round(coalesce(slow_time_s, 0), 4) AS slow_time_s FROM parts LEFT JOIN lead USING (rank)""")

add("a16_group_hash_totals_compat", lambda s, d: C.hash_rank_totals(comm_ops(s, d), compat=True)
    .select("rank", "slow_count", "participations"), HASH_SQL + _TOTALS + """
, per AS (SELECT group_hash, count(*) AS n FROM hg GROUP BY 1),
swollen AS (SELECT rank, CAST(sum(slow_count * n) AS BIGINT) AS slow_count
 FROM sc JOIN per USING (group_hash) GROUP BY 1)
SELECT rank, coalesce(s.slow_count, 0) AS slow_count, participations
FROM parts LEFT JOIN swollen s USING (rank)""")

_SUM = ", tot AS (SELECT rank, CAST(sum(slow_count) AS BIGINT) AS slow_count FROM sc GROUP BY 1)"
add("a17_top_slow_ranks", lambda s, d: C.top_slow_ranks(comm_ops(s, d), 3), HASH_SQL + _SUM +
    " SELECT rank, slow_count FROM tot WHERE slow_count > 0 ORDER BY slow_count DESC, rank LIMIT 3")

add("o2_slow_rank_ranking", lambda s, d: C.top_slow_ranks(comm_ops(s, d), 5), HASH_SQL + _SUM +
    " SELECT rank, slow_count FROM tot WHERE slow_count > 0 ORDER BY slow_count DESC, rank LIMIT 5")

add("o3_slowest_ranks", lambda s, d: C.slowest_ranks(comm_ops(s, d)), HASH_SQL + _SUM +
    " SELECT rank, slow_count FROM tot WHERE slow_count = (SELECT max(slow_count) FROM tot)")

add("a20_group_breakdown", lambda s, d: C.group_breakdown(comm_ops(s, d)), COMM_SQL + """
SELECT group_hash, function, data_size, count(*) AS calls, min(rank) AS first_rank FROM comm_ops
WHERE group_hash IS NOT NULL GROUP BY 1, 2, 3""")

add("a29_set_sizes", lambda s, d: C.set_sizes(comm_ops(s, d)), COMM_SQL + """
SELECT group_hash, count(DISTINCT op_count) AS op_counts, count(DISTINCT rank) AS ranks
FROM comm_ops GROUP BY 1""")

# ---- stream-keyed outlier tests -----------------------------------------------------------

from fleetlens.params import GRUBBS_CRITICAL  # noqa: E402

_G = "group_type, gid, op_count, stream"
STREAM_SQL = COMM_SQL + f""", sg AS (
 SELECT 'TP' AS group_type, rank // 2 AS gid, op_count, stream, rank, ts_ns FROM comm_ops
 UNION ALL SELECT 'PP', rank // 4, op_count, stream, rank, ts_ns FROM comm_ops
 UNION ALL SELECT 'DP', (rank // 4) * 2 + rank % 2, op_count, stream, rank, ts_ns FROM comm_ops),
x AS (SELECT *, (ts_ns - (SELECT min(ts_ns) FROM comm_ops)) / 1e9 AS x,
 row_number() OVER (PARTITION BY {_G} ORDER BY ts_ns) - 1 AS pos,
 count(*) OVER (PARTITION BY {_G}) AS n FROM sg),
crit AS (SELECT unnest([{', '.join(map(str, GRUBBS_CRITICAL))}]) AS n,
 CAST(unnest([{', '.join(map(str, GRUBBS_CRITICAL.values()))}]) AS DOUBLE) AS critical),
st AS (SELECT {_G}, any_value(n) AS n, avg(x) AS mean_s, stddev_samp(x) AS std_s, max(x) AS max_s,
 arg_max(rank, (ts_ns, -rank)) AS slowest_rank, max(CASE WHEN pos = n // 4 THEN x END) AS q1_s,
 max(CASE WHEN pos = 3 * n // 4 THEN x END) AS q3_s FROM x GROUP BY {_G} HAVING any_value(n) >= 2),
g AS (SELECT st.*, critical, (max_s - mean_s) / std_s AS g,
 coalesce(st.n BETWEEN 4 AND 30 AND round(std_s, 9) > 0
  AND round((max_s - mean_s) / std_s, 9) > critical, false) AS hit,
 q3_s + 1.5 * (q3_s - q1_s) AS fence FROM st LEFT JOIN crit USING (n)),
above AS (SELECT {_G}, count(*) AS above FROM x JOIN g USING ({_G})
 WHERE round(x, 9) > round(fence, 9) GROUP BY ALL),
verdict AS (SELECT {_G}, n, CASE WHEN n < 4 THEN 'max' WHEN hit THEN 'grubbs' ELSE 'iqr' END AS method,
 slowest_rank, n >= 4 AS is_outlier,
 CASE WHEN n < 4 THEN 0 WHEN hit THEN 1 ELSE coalesce(above, 0) END AS outliers,
 CASE WHEN n < 4 THEN 0.0 WHEN hit THEN mean_s + critical * std_s ELSE fence END AS threshold_s
 FROM g LEFT JOIN above USING ({_G}) WHERE n < 4 OR hit OR above > 0),
score AS (SELECT slowest_rank AS rank, group_type, count(*) AS score FROM verdict WHERE is_outlier
 GROUP BY 1, 2)"""
_GS = "group_type, CAST(gid AS INT) AS gid, op_count, stream"

add("a8_stream_groups", lambda s, d: U.stream_group_sizes(comm_ops(s, d), T), STREAM_SQL + f"""
, z AS (SELECT {_G}, count(*) AS n FROM sg GROUP BY ALL)
SELECT group_type, CASE WHEN n = 1 THEN 'single' WHEN n < 4 THEN 'tiny' WHEN n <= 30 THEN 'grubbs'
 ELSE 'large' END AS size_class, count(*) AS groups, CAST(sum(n) AS BIGINT) AS members
FROM z GROUP BY 1, 2""")

add("a9_grubbs", lambda s, d: U.grubbs(comm_ops(s, d), T), STREAM_SQL + f"""
SELECT {_GS}, n, slowest_rank, round(g + 1e-9, 6) AS g, critical, hit AS is_outlier FROM g
WHERE n BETWEEN 4 AND 30 AND round(std_s, 9) > 0""")

add("a10_judged_groups", lambda s, d: U.judged_groups(comm_ops(s, d), T), STREAM_SQL + f"""
SELECT {_GS}, n, method, slowest_rank, is_outlier, CAST(outliers AS BIGINT) AS outliers,
 round(threshold_s + 1e-9, 6) AS threshold_s FROM verdict""")

_PIVOT = ", ".join(f"CAST(coalesce(sum(CASE WHEN group_type = '{c}' THEN score END), 0) AS BIGINT)"
                   f" AS {c.lower()}" for c in ("TP", "PP", "DP"))
add("a11_slow_scores", lambda s, d: U.slow_scores(comm_ops(s, d), T),
    STREAM_SQL + f" SELECT rank, {_PIVOT} FROM score GROUP BY 1")


def _normal(ranks: str) -> str:
    return STREAM_SQL + f"""
, grid AS (SELECT rank, unnest(['TP', 'PP', 'DP']) AS group_type FROM (SELECT DISTINCT rank FROM {ranks})),
f AS (SELECT rank, group_type, coalesce(score, 0) - min(coalesce(score, 0)) OVER (PARTITION BY group_type)
 AS score FROM grid LEFT JOIN score USING (rank, group_type))
SELECT rank, {_PIVOT} FROM f GROUP BY 1"""


add("a12_normalised_scores", lambda s, d: U.normalised_scores(comm_ops(s, d), T), _normal("comm_ops"))
add("a12_normalised_scores_compat",
    lambda s, d: U.normalised_scores(comm_ops(s, d), T, compat=True), _normal("score"))
