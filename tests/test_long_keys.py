"""Operators that must not hold a key in one array: automata, missing calls, hash repair, as-of joins, log streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import alerts, correlate, hang
from fleetlens.operators.repair import repair_hashes
from fleetlens.plans.automata import states_before
from fleetlens.sources import log_stream


def brute_replay(polls, hold):
    out = []
    for f in {f for f, _ in polls}:
        live = None
        for p in sorted({p for g, p in polls if g == f}):
            gap = None if live is None else p - live
            state = ("new" if gap is None else "ongoing" if gap == 1 else "recurrence" if gap > hold else "suppressed")
            out.append((f, p, state))
            live = live if state == "suppressed" else p
    return sorted(out)


@pytest.mark.parametrize("row_floor", [None, 50])
def test_replay_of_flapping_alerts(spark, row_floor):
    rng = random.Random(5)
    polls = [("flap", 2 * i) for i in range(400)] + [("steady", i) for i in range(300)] + [("once", 7)]
    polls += [(f"r{k}", p) for k in range(3) for p in range(900) if rng.random() < 0.3 * (k + 1)]
    df = spark.createDataFrame(polls + polls[:5], "fingerprint string, poll bigint")
    got = sorted(map(tuple, alerts.replay(df, 3, row_floor).collect()))
    assert got == brute_replay(polls, 3)
    assert alerts.replay(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("block", [3, 512])
def test_states_equal_a_plain_walk(spark, block):
    """Three levels of blocks, null keys, and columns of any name."""
    rng = random.Random(2)
    rows = [(k, i, [rng.randrange(4) for _ in range(4)], f"x{i}") for k, n in ((1, 100), (None, 40), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k int, at int, m array<int>, s string").repartition(5)
    got = {(r.k, r.at): (r.before, r.s) for r in states_before(df, ["k"], ["at"], "m", 4, "before", block=block).collect()}
    assert len(got) == len(rows)
    state = {}
    for k, i, move, s in rows:
        assert got[k, i] == (state.get(k, 0), s)
        state[k] = move[state.get(k, 0)]


def brute_missing(calls):
    out = []
    for g in {c["group_hash"] for c in calls if c["group_hash"] is not None}:
        mine = [c for c in calls if c["group_hash"] == g]
        every = {c["op"] for c in mine}
        for r in {c["rank"] for c in mine}:
            own = {c["op"] for c in mine if c["rank"] == r}
            left = every - own
            if left:
                out.append((g, r, min(left), min(c["function"] for c in mine if c["op"] == min(left)), len(left), max(own)))
    return sorted(out)


def test_first_missing_call(make_calls):
    """Planted gaps: a rank that skipped one call, one that stopped, one in another bitmap, operation zero."""
    rows = [{"rank": r, "op": o, "t": o, "group_hash": g, "function": f"F{o % 3}"}
            for g in (7, -9) for r in range(4) for o in [*range(12), 32767, 32768, 70_000]
            if not (g == 7 and ((r, o) in {(1, 5), (1, 70_000), (2, 0)} or (r == 3 and o > 8)))]
    rows += [{"rank": 9, "op": 1, "t": 1, "group_hash": None, "function": "F"}]
    got = sorted(map(tuple, hang.missing_calls(make_calls(rows)).collect()))
    assert got == brute_missing(rows)
    assert got == [(7, 1, 5, "F2", 2, 32768), (7, 2, 0, "F0", 1, 70_000), (7, 3, 9, "F0", 6, 8)]
    assert hang.missing_calls(make_calls([{"rank": 0, "op": 1, "t": 1}])).count() == 0


def test_operation_and_transfer_gaps(make_calls):
    late = {"Send": (170, 190), "Recv": (181, 1), "AllToAll": (61, 59), "AllReduce": (500, 1)}
    rows = [{"rank": i, "op": o, "t": t, "stream": s, "function": f}
            for i, (f, gaps) in enumerate(late.items()) for s, gap in zip("ab", gaps) for o, t in ((1, 1000), (2, 1000 + gap))]
    got = sorted((r["rank"], r["stream"], r["limit_s"]) for r in hang.operation_gaps(make_calls(rows)).collect())
    assert got == [(0, "b", 180.0), (1, "a", 180.0), (2, "a", 60.0)]


def test_cut_hashes_are_completed(spark):
    rows = [(0, "F", 1, 1234, False), (1, "F", 1, 123, True),      # whole for the same call elsewhere
            (0, "F", 2, 1255, False), (0, "F", 2, 1266, False),
            (2, "F", 2, 12, True),                                  # two start so
            (3, "G", 9, 1266, False), (3, "F", 2, 12, True),        # this rank logged one of them whole
            (4, "F", 3, 99, True), (4, "F", 1, None, True),         # none; everything starts so, and only one does
            (5, "H", 1, -12, True), (6, "H", 1, -123, False), (6, "H", 1, 5, None), (7, None, None, 1, True)]
    df = spark.createDataFrame(rows, "rank int, function string, op_count bigint, group_hash bigint, cut boolean")
    got = [(r["rank"], r.op_count, r.group_hash, r.repair) for r in repair_hashes(df).collect() if r.repair != "kept"]
    assert sorted(got, key=str) == sorted([(1, 1, 1234, "repaired"), (2, 2, None, "ambiguous"), (3, 2, 1266, "repaired"),
                                           (4, 3, None, "unknown"), (4, 1, 1234, "repaired"), (5, 1, -123, "repaired"),
                                           (7, None, None, "unknown")], key=str)
    assert repair_hashes(df).count() == len(rows) and repair_hashes(df.limit(0)).count() == 0
    assert {r.repair for r in repair_hashes(df.where("NOT cut")).collect()} == {"kept"}


@pytest.mark.parametrize("row_floor", [None, 40])
def test_as_of_join(spark, row_floor):
    rng = random.Random(1)
    left = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(4)}", rng.randrange(500), i) for i in range(300)] + [("hot", None, -1)]
    right = [("hot" if rng.random() < 0.8 else f"k{rng.randrange(3)}", t, rng.random()) for t in rng.sample(range(100, 600), 200)]
    right += [("hot", None, 1.0)]
    a = spark.createDataFrame(left, "key string, t bigint, value int").withColumnRenamed("value", "id")
    b = spark.createDataFrame(right, "key string, t bigint, rate double")
    got = {r.id: (r.as_of_t, r.rate) for r in correlate.as_of(a, b, ["key"], "t", ["rate"], row_floor).collect()}
    assert len(got) == len(left)
    for k, t, i in left:
        match = [x for x in right if x[0] == k and x[1] is not None and t is not None and x[1] <= t]
        assert got[i] == (max(match, key=lambda x: x[1])[1:] if match else (None, None))


def test_logs_are_landed_once(spark, tmp_path):
    """Files added between triggers, a batch that comes twice, and lines that are no calls."""
    line = "[save_count 1] [%d.000000001] [Rank %d] Fun AllReduce Data 8 stream 0xab opCount %d groupHash %s"
    logs, out, state = f"{tmp_path}/logs", f"{tmp_path}/out", f"{tmp_path}/state"

    def add(name, lines):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_path}/raw/{name}")
        (tmp_path / "logs").mkdir(exist_ok=True)
        part = next((tmp_path / "raw" / name).glob("part-*"))
        part.rename(f"{logs}/{name}")
    add("rank_0.log", [line % (i, 0, i, 7) for i in range(5)] + ["## broken"])
    add("notes.pdf", [line % (1, 9, 9, 9)])
    log_stream.land(log_stream.follow_lines(spark, logs), out, state).awaitTermination()
    add("rank_1.log", [line % (i, 1, i, "1" * 60) for i in range(3)])
    for _ in range(2):
        log_stream.land(log_stream.follow_lines(spark, logs), out, state).awaitTermination()
    calls = log_stream.landed(spark, out)
    assert sorted((r["rank"], r.op_count, r.cut) for r in calls.collect()) == [
        *((0, i, False) for i in range(5)), *((1, i, True) for i in range(3))]
    assert [r.value for r in log_stream.landed(spark, out, "refused").collect()] == ["## broken"]
    assert calls.select(F.count_distinct("file")).first()[0] == 2
