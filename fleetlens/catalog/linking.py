"""Link queries."""

from __future__ import annotations

from fleetlens.catalog.fixtures import LINK_SQL, TELE_SQL, link_telemetry, link_transfers
from fleetlens.catalog.registry import add
from fleetlens.operators import links as K
from fleetlens.operators import rings as R

_F = "grp, func_name, func_times, channel, flow, ip_flow"
RATE_SQL = LINK_SQL + f""", rate AS (SELECT {_F}, CAST(sum(bytes_sent) AS BIGINT) AS bytes,
 CAST(sum(nsec) AS BIGINT) AS nsec, count(*) AS sends,
 CASE WHEN sum(nsec) > 0 THEN CAST(sum(bytes_sent) * 8 AS DOUBLE) / sum(nsec) ELSE 0 END AS rate_gbps
 FROM fn GROUP BY ALL)"""

add("a21_flow_rates", lambda s, d: K.flow_rates(link_transfers(s, d)), RATE_SQL + f"""
SELECT {_F}, bytes, nsec, sends, round(rate_gbps + 1e-9, 6) AS rate_gbps FROM rate""")

add("a22_group_rates", lambda s, d: K.group_rates(link_transfers(s, d)), RATE_SQL + f"""
, low AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(rate_gbps, 9), {_F}) AS p,
 row_number() OVER (ORDER BY round(rate_gbps, 9), {_F}) AS q FROM rate)
SELECT grp, count(*) AS flows, round(avg(rate_gbps) + 1e-9, 6) AS avg_gbps,
 round(min(round(rate_gbps, 9)) + 1e-9, 6) AS lowest_gbps, max(CASE WHEN p = 1 THEN flow END) AS lowest_flow,
 max(CASE WHEN p = 1 THEN ip_flow END) AS lowest_ip_flow FROM low GROUP BY 1
UNION ALL SELECT -1, count(*), round(avg(rate_gbps) + 1e-9, 6), round(min(round(rate_gbps, 9)) + 1e-9, 6),
 max(CASE WHEN q = 1 THEN flow END), max(CASE WHEN q = 1 THEN ip_flow END) FROM low""")

add("a23_flow_details", lambda s, d: K.flow_details(link_transfers(s, d)), RATE_SQL + f"""
SELECT {_F}, round(bytes / sends + 1e-9, 6) AS avg_bytes, round(nsec / sends + 1e-9, 6) AS avg_nsec,
 round(rate_gbps + 1e-9, 6) AS avg_gbps FROM rate""")

add("w15_slowest_flows", lambda s, d: K.slowest_flows(link_transfers(s, d), 3), RATE_SQL + f"""
, p AS (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY round(rate_gbps, 9), {_F}) AS INT)
 AS place FROM rate)
SELECT {_F}, bytes, nsec, sends, round(rate_gbps + 1e-9, 6) AS rate_gbps, place FROM p WHERE place <= 3""")

add("a27_compacted_sends", lambda s, d: K.compact_sends(link_telemetry(s, d)), TELE_SQL + """
, f AS (SELECT *, CASE WHEN lag(func_times) OVER w IS DISTINCT FROM func_times THEN 1 ELSE 0 END AS nw
 FROM link_telemetry WINDOW w AS (PARTITION BY nic, dev ORDER BY rn)),
g AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY nic, dev ORDER BY rn) AS BIGINT) AS run FROM f)
SELECT nic, dev, run, func_times, CAST(sum(size) AS BIGINT) AS size, max(t_ns) AS t_ns, count(*) AS sends
FROM g GROUP BY nic, dev, run, func_times""")

BAND_SQL = TELE_SQL + """
, w AS (SELECT *, count(*) OVER f AS full_n, sum(size) OVER f AS bytes, first(size) OVER f AS first_size,
 first(t_ns) OVER f AS since, min(func_times) OVER f AS lo, max(func_times) OVER f AS hi
 FROM link_telemetry WINDOW f AS (PARTITION BY nic, dev ORDER BY rn ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT nic, dev, rn, func_times, CAST(floor(CAST(bytes - first_size AS DOUBLE) * CAST(7.44 AS DOUBLE)
 / (t_ns - since)) AS BIGINT) AS gbps FROM w WHERE full_n = 50 AND lo = hi AND t_ns > since"""

add("w14_sliding_bandwidth", lambda s, d: K.sliding_bandwidth(link_telemetry(s, d)), BAND_SQL)

_GR = "grp, func, func_times, channel"
SCC_SQL = "RECURSIVE " + LINK_SQL + f""", ed AS (SELECT DISTINCT {_GR}, from_rank AS u, to_rank AS v
 FROM link_transfers),
reach AS (SELECT * FROM ed UNION SELECT r.grp, r.func, r.func_times, r.channel, r.u, e.v FROM reach r
 JOIN ed e ON r.grp = e.grp AND r.func = e.func AND r.func_times = e.func_times
 AND r.channel = e.channel AND r.v = e.u),
node AS (SELECT {_GR}, u AS rank FROM ed UNION SELECT {_GR}, v FROM ed),
mutual AS (SELECT a.grp, a.func, a.func_times, a.channel, a.u AS rank, a.v AS peer FROM reach a
 JOIN reach b ON a.grp = b.grp AND a.func = b.func AND a.func_times = b.func_times
 AND a.channel = b.channel AND a.u = b.v AND a.v = b.u
 UNION SELECT {_GR}, rank, rank FROM node),
scc AS (SELECT {_GR}, rank, min(peer) AS scc, count(*) AS size FROM mutual GROUP BY ALL),
comp AS (SELECT s.*, size > 1 OR EXISTS (SELECT 1 FROM ed WHERE ed.grp = s.grp AND ed.func = s.func
 AND ed.func_times = s.func_times AND ed.channel = s.channel AND ed.u = s.rank AND ed.v = s.rank)
 AS is_cycle FROM scc s)"""

add("r1_rank_cycles", lambda s, d: R.cycles(link_transfers(s, d)),
    SCC_SQL + f" SELECT {_GR}, rank, scc, size, is_cycle FROM comp WHERE is_cycle")
add("r1_rank_components_compat", lambda s, d: R.cycles(link_transfers(s, d), compat=True),
    SCC_SQL + f" SELECT {_GR}, rank, scc, size, is_cycle FROM comp")
# the same components by the distributed rounds that larger graphs take
add("r1_rank_components_by_rounds", lambda s, d: R.cycles(link_transfers(s, d), compat=True, edge_limit=0),
    SCC_SQL + f" SELECT {_GR}, rank, scc, size, is_cycle FROM comp")
