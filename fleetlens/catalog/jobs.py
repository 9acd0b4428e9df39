"""The alert job replayed over a table of polls, and its meaning in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.catalog import fixtures as X
from fleetlens.catalog.fixtures import FIRST_TICK, POLL_SQL, TICK_US
from fleetlens.catalog.registry import add
from fleetlens.params import AlertLimits
from fleetlens.plans.durable import scratch_path
from fleetlens.streaming.alert_job import AlertStore
from fleetlens.streaming.run import parquet_stream

LIMITS = AlertLimits(recurrence_s=3 * TICK_US // 1_000_000, repeat_push_s=5 * TICK_US // 1_000_000)
BATCHES = 3


def job_polls(s, d):
    """Polls four hours apart: some alerts are shown as silenced, starts move every fourth poll."""
    user = F.substring("fingerprint", 3, 20).cast("bigint")
    us = (F.col("poll") + FIRST_TICK) * TICK_US
    return X.alert_polls(s, d).select(
        us.alias("poll_us"), "fingerprint",
        F.when((user + F.col("poll")) % 17 == 0, "suppressed").when(user % 2 == 0, "firing").otherwise("active").alias("state"),
        (us - (F.col("poll") % 4) * TICK_US).alias("starts_us"), F.lit(None).cast("bigint").alias("ends_us"), "alertname",
        "severity", F.concat(F.lit("s"), user % 5).alias("summary"), F.concat(F.lit("d"), user % 3).alias("description"),
        F.concat_ws("|", "fingerprint", "poll").alias("raw_data"))


def replayed(s, d) -> AlertStore:
    """The store after a stream of ``BATCHES`` micro-batches."""
    root = scratch_path(s, "alert-job")
    polls = job_polls(s, d)
    low, high = polls.agg(F.min("poll_us"), F.max("poll_us")).first()
    if low is not None:
        width = (high - low) // BATCHES + 1
        for i in range(BATCHES):  # a file per micro-batch, in the order of their polls
            part = F.col("poll_us").between(low + i * width, low + (i + 1) * width - 1)
            polls.where(part).coalesce(1).write.mode("append").parquet(f"{root}/polls")
        store = AlertStore(s, f"{root}/store", LIMITS)
        store.start(parquet_stream(s, f"{root}/polls", 1), f"{root}/checkpoint").awaitTermination()
    return AlertStore(s, f"{root}/store", LIMITS)


def _us(df):
    return df.select(*[F.unix_micros(c).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


JOB_SQL = "RECURSIVE " + POLL_SQL + f""", polls AS (SELECT poll, row_number() OVER (ORDER BY poll) AS n,
 (poll + {FIRST_TICK}) * {TICK_US} AS us FROM (SELECT DISTINCT poll FROM alert_polls)),
sight AS (SELECT a.*, n, us, CAST(substr(fingerprint, 3) AS BIGINT) AS u,
  us - (poll % 4) * {TICK_US} AS starts, (CAST(substr(fingerprint, 3) AS BIGINT) + poll) % 17 <> 0 AS shown,
  row_number() OVER (PARTITION BY fingerprint ORDER BY poll) AS rn FROM alert_polls a JOIN polls USING (poll)),
fold AS (SELECT fingerprint, rn, n, shown AS live, CASE WHEN shown THEN starts END AS starts, CAST(NULL AS BIGINT) AS res,
  CASE WHEN shown THEN us END AS push, 0 AS reps, 0 AS recs, CASE WHEN shown THEN 'new' END AS kind,
  CAST(NULL AS BIGINT) AS gone, CAST(NULL AS BIGINT) AS gone_starts, shown AS stored FROM sight WHERE rn = 1
 UNION ALL SELECT fingerprint, rn, n, on_now OR kind IN ('new', 'recurrence'),
  CASE WHEN kind IN ('new', 'recurrence') THEN new_starts ELSE starts END, res,
  CASE WHEN kind IS NOT NULL THEN us ELSE push END, reps + CASE WHEN kind = 'repeat' THEN 1 ELSE 0 END,
  recs + CASE WHEN kind = 'recurrence' THEN 1 ELSE 0 END, kind, gone, gone_starts, stored OR kind = 'new' FROM
  (SELECT *, CASE WHEN NOT stored THEN CASE WHEN shown THEN 'new' END
   WHEN on_now THEN CASE WHEN us - push >= {LIMITS.repeat_push_s * 1_000_000} THEN 'repeat' END
   WHEN shown AND starts <> new_starts AND (res IS NULL OR us - res >= {LIMITS.recurrence_s * 1_000_000}) THEN 'recurrence'
   END AS kind FROM
   (SELECT f.fingerprint, s.rn, s.n, s.us, s.shown, s.starts AS new_starts, f.starts, f.push, f.reps, f.recs, f.stored,
     f.live AND s.n = f.n + 1 AS on_now, CASE WHEN f.live AND s.n > f.n + 1 THEN p.us END AS gone,
     CASE WHEN f.live AND s.n > f.n + 1 THEN f.starts END AS gone_starts,
     CASE WHEN f.live AND s.n > f.n + 1 THEN p.us ELSE f.res END AS res
    FROM fold f JOIN sight s ON s.fingerprint = f.fingerprint AND s.rn = f.rn + 1
    LEFT JOIN polls p ON p.n = f.n + 1))),
ends AS (SELECT fingerprint, gone AS us, gone_starts AS starts FROM fold WHERE gone IS NOT NULL
 UNION ALL SELECT f.fingerprint, p.us, f.starts FROM fold f JOIN polls p ON p.n = f.n + 1
 WHERE f.live AND f.rn = (SELECT max(rn) FROM sight s WHERE s.fingerprint = f.fingerprint)),
ev AS (SELECT f.*, s.us, s.u, s.poll, s.alertname, s.severity FROM fold f JOIN sight s USING (fingerprint, rn)
 WHERE kind IS NOT NULL),
fact AS (SELECT fingerprint, max(us) AS pushed, max(CASE WHEN kind <> 'repeat' THEN us END) AS listed, max(reps) AS reps,
 max(recs) AS recs FROM ev GROUP BY 1),
ended AS (SELECT fingerprint, max(us) AS ended FROM ends GROUP BY 1)"""

add("l2_alert_rows", lambda s, d: _us(replayed(s, d).rows().drop("id")), JOB_SQL + """
SELECT e.fingerprint, alertname, CASE WHEN ended >= us THEN 'resolved' WHEN u % 2 = 0 THEN 'firing' ELSE 'active' END AS status,
 severity, concat('s', u % 5) AS summary, concat('d', u % 3) AS description, starts AS starts_at,
 CAST(NULL AS BIGINT) AS ends_at, CASE WHEN EXISTS (SELECT 1 FROM ends x WHERE x.fingerprint = e.fingerprint
  AND x.starts = e.starts) THEN 'recovery_reported' ELSE 'reported' END AS push_status, pushed AS group_push_time,
 listed AS table_push_time, CAST(fact.reps - e.reps AS BIGINT) AS repeat_push_count,
 CASE WHEN ended >= us THEN ended END AS resolved_at, CAST(fact.recs AS BIGINT) AS recurrence_count,
 kind = 'recurrence' AS is_recurrence, CASE WHEN ended >= us THEN ended ELSE us END AS updated_at, us AS created_at,
 concat(e.fingerprint, '|', poll) AS raw_data
FROM ev e JOIN fact USING (fingerprint) LEFT JOIN ended USING (fingerprint) WHERE kind <> 'repeat'""")

add("l2_status_history", lambda s, d: replayed(s, d).history(), JOB_SQL + """
, ch AS (SELECT fingerprint, CASE WHEN u % 2 = 0 THEN 'firing' ELSE 'active' END AS status, us FROM ev WHERE kind <> 'repeat'
 UNION ALL SELECT fingerprint, 'resolved', us FROM ends)
SELECT fingerprint, status, us AS valid_from, lead(us) OVER (PARTITION BY fingerprint ORDER BY us) AS valid_to FROM ch""")

add("l7_outbox", lambda s, d: replayed(s, d).outbox().drop("alertname"), JOB_SQL + """
, m AS (SELECT fingerprint, starts AS starts_us, us, severity, kind AS state FROM ev
 UNION ALL SELECT fingerprint, starts, min(us), (SELECT any_value(severity) FROM alert_polls p
  WHERE p.fingerprint = x.fingerprint), 'resolved' FROM ends x GROUP BY fingerprint, starts)
SELECT *, CASE severity WHEN 'P0' THEN 'group_p0' WHEN 'P1' THEN 'group_p1' ELSE 'group_p2' END AS channel FROM m
UNION ALL SELECT *, 'table' FROM m WHERE state <> 'repeat'
UNION ALL SELECT *, 'phone' FROM m WHERE state IN ('new', 'recurrence') AND severity = 'P0'""")
