"""The alert job: verdicts over polls, repeated and failed batches, versions, awkward rows."""

from __future__ import annotations

import pytest

from fleetlens.operators.alerts import AlertFilter
from fleetlens.params import AlertLimits
from fleetlens.streaming import alert_job
from fleetlens.streaming.alert_job import FACTS, AlertStore

LIMITS = AlertLimits(recurrence_s=100, repeat_push_s=1000)
S = 1_000_000


def batch(spark, rows):
    """Rows of (seconds, fingerprint, state, start in seconds)."""
    schema = "poll_us bigint, fingerprint string, " + ", ".join(f"{k} {v}" for k, v in FACTS.items())
    return spark.createDataFrame([(t * S, f, state, None if start is None else start * S, None, "n", "P0", "s", "d", f"raw{t}")
                                  for t, f, state, start in rows], schema)


def rows(store, version=None):
    return sorted((r.fingerprint, r.status, r.created_at.timestamp(), r.resolved_at.timestamp() if r.resolved_at else None,
                   r.push_status, r.repeat_push_count, r.is_recurrence) for r in store.rows(version).collect())


def everything(store):
    return [sorted(map(str, view.drop("version").collect()))
            for view in (store.rows(), store.history(), store.outbox(), store.state(), store.events())]


@pytest.fixture
def store(spark, tmp_path):
    return AlertStore(spark, f"{tmp_path}/store", LIMITS)


POLLS = [
    [(0, "a", "active", 0), (0, "b", "suppressed", 0), (0, None, None, None)],
    [(50, "a", "active", 0), (50, "b", "firing", 0), (100, "b", "firing", 0)],  # a is gone at 100
    [(150, "a", "active", 120), (150, "b", "firing", 0), (250, "a", "active", 0), (250, "b", "firing", 0)],
    [(300, "a", "active", 120), (300, "b", "firing", 0), (1200, "a", "active", 120), (1200, "b", "firing", 0)],
    [(1300, None, None, None)],  # an empty poll resolves everything
]


def test_polls_become_rows_history_and_messages(spark, store):
    for i, polls in enumerate(POLLS):
        store.apply(batch(spark, polls), i)
    # a: new 0, resolved 100, too soon at 150, the old start at 250, back at 300; b: silenced first, repeated at 1200
    assert rows(store) == [("a", "resolved", 0.0, 1300.0, "recovery_reported", 0, False),
                           ("a", "resolved", 300.0, 1300.0, "recovery_reported", 0, True),
                           ("b", "resolved", 50.0, 1300.0, "recovery_reported", 1, False)]
    spans = sorted((r.fingerprint, r.status, r.valid_from // S, r.valid_to and r.valid_to // S) for r in store.history().collect())
    assert spans == [("a", "active", 0, 100), ("a", "active", 300, 1300), ("a", "resolved", 100, 300),
                     ("a", "resolved", 1300, None), ("b", "firing", 50, 1300), ("b", "resolved", 1300, None)]
    assert sorted(map(tuple, store.history(row_floor=1).drop("version").collect()), key=str) == sorted(
        map(tuple, store.history().drop("version").collect()), key=str)
    sent = [(r.fingerprint, r.state, r.us // S, r.channel) for r in store.outbox().collect()]
    assert sorted(x[:3] for x in sent if x[3] == "group_p0") == [
        ("a", "new", 0), ("a", "recurrence", 300), ("a", "resolved", 100), ("a", "resolved", 1300), ("b", "new", 50),
        ("b", "repeat", 1200), ("b", "resolved", 1300)]
    assert sorted(x[:3] for x in sent if x[3] == "phone") == [("a", "new", 0), ("a", "recurrence", 300), ("b", "new", 50)]
    # earlier versions stay as they were
    assert rows(store, 0) == [("a", "active", 0.0, None, "reported", 0, False)]
    assert len(store.rows().columns) == 19


def test_repeated_and_failed_batches_change_nothing(spark, store, tmp_path):
    once = AlertStore(spark, f"{tmp_path}/once", LIMITS)
    for i, polls in enumerate(POLLS):
        once.apply(batch(spark, polls), i)
    for i, polls in enumerate(POLLS):
        if i == 2:  # a try that died before its commit
            store._advance(batch(spark, [(9000, "z", "active", 0)]), [9000 * S], 1, 2)
            assert store.head() == (1, 100 * S) and all(r.fingerprint != "z" for r in store.rows().collect())
        store.apply(batch(spark, polls), i)
        store.apply(batch(spark, polls), i)  # the same batch again
    assert everything(store) == everything(once)
    store.apply(batch(spark, POLLS[3] + POLLS[0]), 5)  # old polls in a new batch
    assert everything(store) == everything(once) and store.head()[0] == 5


def test_a_recovery_is_told_once_per_start(spark, store):
    store.apply(batch(spark, [(0, "a", "active", 7), (200, None, None, None), (400, "a", "active", 8),
                              (600, None, None, None), (800, "a", "active", 7), (1000, None, None, None)]), 0)
    gone = [(r.starts_us // S, r.us // S) for r in store.outbox().where("state = 'resolved' AND channel = 'table'").collect()]
    assert sorted(gone) == [(7, 200), (8, 600)] and store.rows().count() == 3


def test_awkward_batches(spark, store):
    empty = batch(spark, [])
    store.apply(empty, 0)
    assert rows(store) == [] and store.outbox().count() == store.history().count() == 0
    store.apply(batch(spark, [(1, "a", "active", None), (1, "a", "active", None), (1, "a", "resolved", None), (1, "", "active", 1),
                              (2, "a", None, None)]), 1)
    assert rows(store) == []  # of one poll's rows with equal start the last state counts, and it is not live
    store.apply(empty, 2)
    assert store.head() == (2, 2 * S)


def test_filtered_alerts_leave_their_poll(spark, store):
    alerts = spark.createDataFrame(
        [(5 * S, "a", "active", {"alertname": "x", "severity": "P0"}), (9 * S, "a", "active", {"alertname": "y", "severity": "P0"}),
         (9 * S, "b", "active", {"severity": "P0"})],
        "poll_us bigint, fingerprint string, state string, labels map<string,string>").selectExpr(
            "*", "CAST(map() AS map<string,string>) AS annotations", "timestamp_micros(0) AS starts_at",
            "CAST(NULL AS timestamp) AS ends_at")
    polls = alert_job.poll_rows(alerts, AlertFilter(exclude_names=("y",)))
    store.apply(polls, 0)
    assert rows(store) == [("a", "resolved", 5.0, 9.0, "recovery_reported", 0, False)]
