"""Components of small and large graphs."""

from __future__ import annotations

import random

import pytest

from fleetlens.operators import rings


def transfers(spark, edges, grp=1):
    return spark.createDataFrame([(grp, 4, 1, 0, u, v) for u, v in edges],
                                 "grp BIGINT, func INT, func_times BIGINT, channel INT, from_rank INT, to_rank INT")


def brute(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            for n in nodes:
                if u in reach[n] and v not in reach[n]:
                    reach[n].add(v)
                    changed = True
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


def solved(df, limit):
    return {r["rank"]: r["scc"] for r in rings.components(df, limit).collect()}


@pytest.mark.parametrize("limit", [1000, 0])
def test_ring_with_leaf(spark, limit):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3)]
    rows = rings.components(transfers(spark, edges), limit).collect()
    assert {r["rank"]: (r["scc"], r["size"], r["is_cycle"]) for r in rows} == {
        0: (0, 3, True), 1: (0, 3, True), 2: (0, 3, True), 3: (3, 1, False)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_on_the_distributed_path(spark, seed):
    rng = random.Random(seed)
    edges = list({(rng.randrange(14), rng.randrange(14)) for _ in range(22)})
    df = transfers(spark, edges)
    assert solved(df, 0) == solved(df, 1000) == brute(edges)


def test_plain_ring_is_one_component(spark):
    ring = [(i, (i + 1) % 16) for i in range(16)]
    assert set(solved(transfers(spark, ring), 0).values()) == {0}


def test_self_loop_is_a_cycle_and_compat_lists_all(spark):
    df = transfers(spark, [(5, 5), (1, 2)])
    assert [r["rank"] for r in rings.cycles(df).collect()] == [5]
    assert rings.cycles(df, compat=True).count() == 3
