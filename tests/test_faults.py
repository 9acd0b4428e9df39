"""Planted faults are found, and the compat switches reproduce the documented numbers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.parsing import parse_calls, parse_links, signed64, truncated
from fleetlens.operators import alerts as A
from fleetlens.operators import compare as C
from fleetlens.operators import hang, heartbeat, outliers, roles, sequences, timing
from fleetlens.operators import topology as TP
from fleetlens.params import SequenceLimits, Topology

T8 = Topology(tp=2, pp=2, world_size=8)


def late_rank(world, ops, slow, delay, jitter=0.001):
    """Every rank calls op i near second 10 i; one rank is late by ``delay``."""
    return [{"rank": r, "op": o, "t": 1000 + 10 * o + jitter * r + (delay if r == slow else 0)}
            for r in range(world) for o in range(ops)]


def test_late_rank_is_picked_by_both_detectors(make_calls):
    calls = make_calls(late_rank(8, 10, 2, 5.0))
    picks = C.slow_picks(calls, T8).where("group_type = 'GLOBAL'").collect()
    assert len(picks) == 10 and {p.slowest_rank for p in picks} == {2}
    assert all(p.lag_s == pytest.approx(5.0 - 0.005) for p in picks)
    top = C.top_slow_ranks(calls).first()
    assert (top["rank"], top["slow_count"]) == (2, 10)


def test_always_slow_rank_hidden_only_in_compat(make_calls):
    calls = make_calls(late_rank(8, 10, 2, 5.0))

    def total(compat):
        rows = C.normalised_picks(calls, T8, compat).where("rank = 2 AND group_type = 'GLOBAL'").collect()
        return rows[0]["normalised"]
    assert total(False) == 10
    assert total(True) == 0


def test_alternating_pair_normalised_difference(make_calls):
    rows = []
    for o in range(10):
        slow = 0 if o < 7 else 1
        rows += [{"rank": r, "op": o, "t": 100 * o + (3 if r == slow else 0) + 0.01 * r} for r in range(2)]
    t2 = Topology(tp=2, pp=1, world_size=2)
    got = {r["rank"]: r["normalised"] for r in C.normalised_picks(make_calls(rows), t2).where(
        "group_type = 'TP'").collect()}
    assert got == {0: 4, 1: 0}


def test_ties_go_to_the_documented_rank(make_calls):
    calls = make_calls([{"rank": r, "op": 1, "t": 50.0} for r in range(2)])
    t2 = Topology(tp=2, pp=1, world_size=2)
    assert {p.slowest_rank for p in C.slow_picks(calls, t2).collect()} == {1}
    assert C.hash_groups(calls).first()["slowest_rank"] == 0


def test_incomplete_groups_are_not_compared(make_calls):
    rows = [r for r in late_rank(8, 4, 1, 2.0) if not (r["rank"] == 5 and r["op"] == 3)]
    picks = C.slow_picks(make_calls(rows), T8)
    assert picks.where("group_type = 'GLOBAL'").count() == 3
    assert picks.where("op_count = 3 AND group_type = 'TP'").count() == 3


def test_hash_zero_counts_and_null_does_not(make_calls):
    calls = make_calls([{"rank": r, "op": 1, "t": r, "group_hash": h} for r in range(2) for h in (0, None)])
    assert C.hash_groups(calls).count() == 1


def test_hung_rank_is_the_candidate(make_calls):
    rows = [{"rank": r, "op": o, "t": 10 * o + r * 0.01} for r in range(4)
            for o in range(20 if r != 3 else 12)]
    calls = make_calls(rows)
    got = hang.hang_candidate(calls).first()
    assert (got["rank"], got["op_count"]) == (3, 11)
    idle = hang.stream_hangs(calls, as_of_ns=int(500e9)).collect()
    assert {(r["rank"], r["severity"]) for r in idle} == {(0, "medium"), (1, "medium"), (2, "medium"),
                                                         (3, "medium")}
    assert {r["rank"] for r in hang.stream_hangs(calls, as_of_ns=int(450e9)).collect()} == {3}


def test_collective_gap(make_calls):
    calls = make_calls([{"rank": 0, "op": o, "t": t} for o, t in enumerate((0, 10, 140))])
    assert hang.collective_hangs(calls).first()["gap_s"] == pytest.approx(130)
    assert hang.collective_hangs(make_calls([{"rank": 0, "op": 0, "t": 0}])).count() == 0


def test_last_batch_ignores_older_batches(make_calls):
    calls = make_calls([{"rank": 0, "op": 9, "t": 900, "save_count": 1},
                        {"rank": 0, "op": 1, "t": 100, "save_count": 2}])
    assert hang.last_calls(calls).first()["op_count"] == 1


def test_grubbs_on_four(make_calls):
    rows = [{"rank": r, "op": 1, "t": 1e9 + (20 if r == 2 else 0)} for r in range(4)]
    got = outliers.grubbs(make_calls(rows), Topology(tp=4, pp=1, world_size=4)).where(
        "group_type = 'TP'").first()
    assert got["g"] == pytest.approx(1.5) and got["is_outlier"] and got["slowest_rank"] == 2


def test_quartile_branch_above_thirty(make_calls):
    rows = [{"rank": 0, "op": 1, "t": 100 + 0.1 * i} for i in range(30)] + [{"rank": 1, "op": 1, "t": 200}]
    got = outliers.judged_groups(make_calls(rows), Topology(tp=2, pp=1, world_size=2)).where(
        "group_type = 'TP'").first()
    assert (got["method"], got["outliers"], got["slowest_rank"]) == ("iqr", 1, 1)


def test_late_rank_scores_hidden_only_in_compat(make_calls):
    rows = late_rank(8, 10, 2, 20.0)
    t = Topology(tp=4, pp=2, world_size=8)
    scores = outliers.normalised_scores(make_calls(rows), t).where("rank = 2").first()
    assert (scores["tp"], scores["pp"]) == (10, 10)
    old = outliers.normalised_scores(make_calls(rows), t, compat=True).where("rank = 2").first()
    assert (old["tp"], old["pp"]) == (0, 0)


def test_long_gap_found_by_timing_and_forecast(make_calls):
    t, rows = 0.0, []
    for o in range(40):
        t += 4.0 if o == 25 else 1.0 + 0.01 * (o % 3)
        rows.append({"rank": 0, "op": o, "t": t})
    calls = make_calls(rows)
    found = timing.interval_anomalies(calls).collect()
    assert [(f["method"], round(f["actual_s"], 3)) for f in found] == [("z_score", 4.0)]
    assert found[0]["severity"] == "critical"
    # the gap itself misses its forecast by 75 % of its length; its followers by 100 %
    hits = sequences.forecast_anomalies(calls, SequenceLimits(10, 0.7)).collect()
    assert [h["gap_idx"] for h in hits] == [24, 25, 26, 27]


def test_missing_calls_never_fire_on_the_mean(make_calls):
    rows, t = [], 0.0
    for o in range(60):
        t += 30.0 if o % 10 == 9 else 1.0
        rows.append({"rank": 0, "op": o, "t": t})
    calls = make_calls(rows)
    assert timing.missing_calls(calls).count() == 1
    assert timing.missing_calls(calls, expected="mean").count() == 0


def test_sequences_break_on_gaps_batches_and_repeats(make_calls):
    ops = [(1, 1), (1, 2), (1, 3), (1, 5), (1, 6), (2, 7), (2, 8), (2, 8), (2, 9)]
    calls = make_calls([{"rank": 0, "op": o, "t": i, "save_count": b} for i, (b, o) in enumerate(ops)])
    got = sorted((r["save_count"], r["start_op"], r["length"]) for r in sequences.sequences(calls).collect())
    assert got == [(1, 1, 3), (1, 5, 2), (2, 7, 2), (2, 8, 2)]


def test_forecaster_registry(make_calls):
    sequences.register_forecaster("zero", lambda gaps: gaps.withColumn("predicted_s", F.lit(0.0)))
    calls = make_calls([{"rank": 0, "op": o, "t": float(o)} for o in range(15)])
    got = sequences.forecast_anomalies(calls, SequenceLimits(3, 0.5), "zero").collect()
    assert len(got) == 11 and all(r["deviation"] == pytest.approx(1.0) for r in got)


def test_roles(make_calls):
    def use(stream, function, size, ops):
        return [{"rank": 0, "op": o, "t": o, "stream": stream, "function": function, "data_size": size}
                for o in range(ops)]
    calls = make_calls(use("0xa", "AllReduce", 9999, 9) + use("0xb", "AllGather", 9999, 3)
                       + use("0xc", "Send", 9999, 3) + use("0xd", "Broadcast", 8, 3))
    got = {r["stream"]: (r["is_tp"], r["is_dp"], r["is_pp"], r["is_barrier"])
           for r in roles.stream_roles(calls).collect()}
    assert got == {"0xa": (True, False, False, False), "0xb": (False, True, False, False),
                   "0xc": (False, False, True, False), "0xd": (False, False, False, True)}


def test_topology_arithmetic(spark):
    rows = {r["rank"]: r for r in TP.rank_table(spark, T8).collect()}
    assert len(rows) == 8 and T8.dp == 2
    assert [rows[5][c] for c in ("tp_pos", "tp_group", "pp_stage", "pp_group", "dp_pos", "dp_group")] == [
        1, 2, 1, 1, 0, 3]
    with pytest.raises(ValueError):
        Topology(tp=4, pp=4, world_size=8)
    assert Topology.from_mapping({}) == T8


# ---- text ---------------------------------------------------------------------------------

LINE = ("[save_count 5] [1755877674.248008482] [Rank 0] Fun AllReduce Data 25165824 stream 0x562a9d0b5020"
        " opCount 8 groupHash -5956285979098587305")


def test_call_lines_keep_nanoseconds(spark):
    df = spark.createDataFrame([(LINE,), (LINE.split(" groupHash")[0],), ("noise " + LINE,), ("",)],
                               "value STRING")
    rows = parse_calls(df).orderBy(F.col("group_hash").asc_nulls_last()).collect()
    assert len(rows) == 2
    assert rows[0]["ts_ns"] == 1755877674248008482
    assert rows[0]["group_hash"] == -5956285979098587305 and rows[1]["group_hash"] is None
    assert rows[0]["stream"] == "0x562a9d0b5020" and rows[0]["data_size"] == 25165824


def test_truncated_messages_are_flagged(spark):
    message = LINE.split("] ", 1)[1]
    long = "[save_count 5] " + (message + "0" * 60)[:127]
    df = spark.createDataFrame([(LINE,), (long,), (LINE.split(" groupHash")[0],)], "value STRING")
    assert [r[0] for r in df.select(truncated(F.col("value"))).collect()] == [False, True, True]


def test_link_lines_and_hash_signs(spark):
    line = ("n1:mlx0:99: Group:18446744073709551605, from rank 1 to rank 2, channel_id:0, func:4,FuncTimes:7,"
            " 10.0.0.1->10.0.0.2 send 4096 Bytes used 100 nsec")
    df = spark.createDataFrame([(line.replace("18446744073709551605", "12"),), ("junk",)], "value STRING")
    row = parse_links(df).first()
    assert (row["grp"], row["from_rank"], row["to_rank"], row["bytes_sent"], row["nsec"]) == (12, 1, 2, 4096, 100)
    got = spark.sql("SELECT '18446744073709551605' AS a, '12' AS b").select(
        signed64(F.col("a")), signed64(F.col("b"))).first()
    assert tuple(got) == (-11, 12)


# ---- alerts -------------------------------------------------------------------------------

def polls(spark, *pairs):
    return spark.createDataFrame([(f, p, "A", "P0") for f, ps in pairs for p in ps],
                                 "fingerprint STRING, poll BIGINT, alertname STRING, severity STRING")


def brute_states(ps, hold):
    """The state machine, step by step."""
    out, live = [], None
    for p in sorted(set(ps)):
        if live is None:
            state = "new"
        elif p - live == 1:
            state = "ongoing"
        elif p - live > hold:
            state = "recurrence"
        else:
            state = "suppressed"
        if state != "suppressed":
            live = p
        out.append((p, state))
    return out


def test_flapping_alert_is_suppressed_then_recurs(spark):
    got = A.replay(polls(spark, ("f", [0, 2, 3, 4, 9])), hold=3).orderBy("poll").collect()
    assert [(r["poll"], r["state"]) for r in got] == [
        (0, "new"), (2, "suppressed"), (3, "suppressed"), (4, "recurrence"), (9, "recurrence")]


@pytest.mark.parametrize("hold,floor", [(1, None), (3, None), (3, 10), (5, None)])
def test_replay_equals_state_machine(spark, hold, floor):
    import random
    rng = random.Random(hold)
    data = {f"f{i}": [p for p in range(120) if rng.random() < (0.15 + 0.1 * i)] for i in range(8)}
    got = {}
    for r in A.replay(polls(spark, *data.items()), hold, floor).collect():
        got.setdefault(r["fingerprint"], []).append((r["poll"], r["state"]))
    for name, ps in data.items():
        assert sorted(got.get(name, [])) == brute_states(ps, hold), name


def test_empty_poll_resolves_and_failed_poll_does_not(spark):
    history = polls(spark, ("f", [0, 1]), ("g", [0, 1, 4]))
    seen = A.lifecycle(history).where("state = 'resolved'").collect()
    assert {(r["fingerprint"], r["poll"]) for r in seen} == {("f", 2), ("g", 2)}
    good = spark.createDataFrame([(0,), (1,), (4,)], "poll BIGINT")
    kept = A.lifecycle(history, ok_polls=good).collect()
    states = {(r["fingerprint"], r["poll"]): r["state"] for r in kept}
    assert states[("g", 4)] == "ongoing" and states[("f", 4)] == "resolved"


def test_exclude_labels_exclude(spark):
    alerts = spark.createDataFrame(
        [("a", {"alertname": "X", "severity": "P1", "team": "dev"}), ("b", {"alertname": "X", "severity": "P1"}),
         ("c", {"alertname": "X", "severity": "P3"})], "fingerprint STRING, labels MAP<STRING,STRING>")
    kept = A.keep_alerts(alerts, A.AlertFilter(exclude_labels={"team": "dev"}))
    assert [r["fingerprint"] for r in kept.collect()] == ["b"]


def test_routes(spark):
    events = spark.createDataFrame([("a", "P0", "new"), ("b", "P3", "new"), ("c", None, "resolved"),
                                    ("d", "P1", "repeat"), ("e", "P0", "ongoing")],
                                   "fingerprint STRING, severity STRING, state STRING")
    got = {(r["fingerprint"], r["channel"]) for r in A.route(events).collect()}
    assert got == {("a", "group_p0"), ("a", "table"), ("a", "phone"), ("b", "group_p2"), ("b", "table"),
                   ("c", "group_p2"), ("c", "table"), ("d", "group_p1")}
    assert ("b", "group_p3") in {(r["fingerprint"], r["channel"]) for r in A.route(events, True).collect()}


def test_silent_client(spark):
    beats = spark.createDataFrame([("c", 0), ("c", 1_200_000_000), ("c", 2_401_000_000)],
                                  "client_id STRING, us BIGINT")
    rows = heartbeat.silences(beats).collect()
    assert [(r["last_us"], r["back_us"]) for r in rows] == [(1_200_000_000, 2_401_000_000)]
    kinds = [r["event"] for r in heartbeat.connection_events(beats).orderBy("us").collect()]
    assert kinds == ["recovered", "offline", "recovered"]


def test_client_that_stays_away(spark):
    beats = spark.createDataFrame([("gone", 0), ("here", 0), ("here", 1_000_000_000), ("here", 1_500_000_000)],
                                  "client_id STRING, us BIGINT")
    rows = heartbeat.silences(beats).collect()
    assert [(r["client_id"], r["last_us"], r["back_us"], r["silent_s"]) for r in rows] == [("gone", 0, None, 1500.0)]
    assert heartbeat.silences(beats, as_of=1_100_000_000).count() == 0
    events = [(r["client_id"], r["event"]) for r in heartbeat.connection_events(beats).orderBy("us", "client_id").collect()]
    assert events == [("gone", "recovered"), ("here", "recovered"), ("gone", "offline")]


def test_rows_stored_after_a_resolution_stay(spark):
    store = spark.createDataFrame([("a", 10, "active"), ("a", 50, "active"), ("a", 99, "firing"), ("b", 5, "active")],
                                  "fingerprint STRING, us BIGINT, status STRING")
    ends = spark.createDataFrame([("a", 50), ("a", 60)], "fingerprint STRING, resolved_at BIGINT")
    got = {(r["fingerprint"], r["us"], r["status"], r["resolved_at"]) for r in A.settle_status(store, ends).collect()}
    assert got == {("a", 10, "resolved", 50), ("a", 50, "resolved", 50), ("a", 99, "firing", None), ("b", 5, "active", None)}


def test_set_sizes_keep_the_null_group(make_calls):
    from fleetlens.operators import compare
    got = {r["group_hash"]: (r["op_counts"], r["ranks"]) for r in compare.set_sizes(make_calls([
        {"rank": r, "op": o, "t": 1.0 + o, "group_hash": h}
        for r, o, h in ((0, 1, None), (1, 1, None), (0, 1, 7), (0, 2, 7))])).collect()}
    assert got == {None: (1, 2), 7: (2, 1)}


def test_every_group_is_a_column(make_calls):
    from fleetlens.operators import compare
    calls = make_calls([{"rank": r, "op": o, "t": 1.0 + o + 0.1 * r, "group_hash": h}
                        for h in range(10, 17) for o in (1, 2) for r in (0, 1)])
    assert compare.slow_matrix_wide(calls).columns == ["rank"] + [f"g{i}" for i in range(1, 8)]


def test_series_without_an_instance_match(spark):
    from fleetlens.operators import rules
    side = spark.createDataFrame([("s", None, 3, 6.0)], "series STRING, instance STRING, tick BIGINT, value DOUBLE")
    assert rules.match_vectors(side, side, lambda a, b: a / b).first()["value"] == 1.0


def test_topology_must_divide():
    with pytest.raises(ValueError):
        Topology(tp=3, pp=2, world_size=8)


def test_decision_counts_seconds_since_the_resolution(spark):
    s = 1_000_000
    store = spark.createDataFrame([
        ("live", "firing", 1, None, 1, 1), ("same", "resolved", 1, 0, 1, 2), ("soon", "resolved", 1, 801 * s, 1, 3),
        ("late", "resolved", 1, 800 * s, 1, 4), ("never", "resolved", 1, None, 1, 5), ("odd", "pending", 1, None, 1, 6),
        ("gone", "active", 1, None, 1, 7), ("done", "resolved", 1, 5, 1, 8), ("twice", "active", 1, None, 1, 9),
        ("twice", "resolved", 1, 0, 2, 10)],
        "fingerprint string, status string, starts_us long, resolved_us long, us long, event_id long")
    names = ("live", "same", "soon", "late", "never", "odd", "first", "twice")
    seen = [(n, "firing", 1 if n == "same" else 2) for n in names] + [("quiet", "suppressed", 2)]
    snapshot = spark.createDataFrame(seen, "fingerprint string, state string, starts_us long")
    got = {r.fingerprint: (r.verdict, r.notify) for r in A.decide(snapshot, store, 2000 * s).collect()}
    assert got == {"live": ("ongoing", False), "same": ("unchanged", False), "soon": ("suppressed", False),
                   "late": ("recurrence", True), "never": ("recurrence", True), "odd": ("other", False),
                   "first": ("new", True), "twice": ("recurrence", True), "quiet": ("new", False),
                   "gone": ("resolved", False)}
    assert A.decide(snapshot.limit(0), store, 0).where("verdict <> 'resolved'").isEmpty()
    assert A.decide(snapshot, store.limit(0), 0).where("verdict <> 'new'").isEmpty()
