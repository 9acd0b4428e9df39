"""Hot keys cut into pieces give the results of the uncut window."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.operators import timing
from fleetlens.plans.ordered import OrderedGroups, attach
from fleetlens.plans.quantiles import at_index, quantile, ranked

FLOOR = 40


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most rows, one with long runs of equal order values, some small keys."""
    rng = random.Random(5)
    rows = [("hot", rng.randint(0, 10**9), i) for i in range(1500)]
    rows += [("ties", rng.choice([5, 6, 7]), i) for i in range(1500, 1800)]
    rows += [(f"k{i % 9}", rng.randint(0, 1000), i) for i in range(1800, 2100)]
    return spark.createDataFrame(rows, "key STRING, t BIGINT, id BIGINT").cache()


def rows_of(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_hot_keys_are_cut_and_others_are_not(skewed):
    groups = OrderedGroups(skewed, ["key"], ["t", "id"], row_floor=FLOOR)
    assert {r[0] for r in groups.hot_keys} == {"hot", "ties"}
    pieces = {r[0]: r[1] for r in groups.rows().groupBy("key").agg(
        F.count_distinct("_piece")).collect()}
    assert pieces["hot"] > 20 and pieces["k0"] == 1
    largest = groups.rows().where("key = 'hot'").groupBy("_piece").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * FLOOR
    assert not OrderedGroups(skewed, ["key"], ["t"]).split


@pytest.mark.parametrize("reach", [1, 5, 50])
def test_frames_cross_piece_borders(skewed, reach):
    plain = Window.partitionBy("key").orderBy("t", "id")
    want = skewed.select("id", F.lag("t", reach).over(plain).alias("b"),
                         F.sum("t").over(plain.rowsBetween(-reach, 0)).alias("s"))
    groups = OrderedGroups(skewed, ["key"], ["t", "id"], halo=reach, row_floor=FLOOR)
    w = groups.window()
    got = groups.trim(groups.rows().withColumns({
        "b": F.lag("t", reach).over(w), "s": F.sum("t").over(w.rowsBetween(-reach, 0))}))
    assert got.columns == ["key", "t", "id", "b", "s"]
    assert sorted(map(tuple, got.select("id", "b", "s").collect()), key=lambda r: r[0]) == sorted(
        map(tuple, want.collect()), key=lambda r: r[0])


def test_running_values_and_numbers(skewed):
    plain = Window.partitionBy("key").orderBy("t", "id")
    upto = plain.rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("id") % 37 == 0, F.col("t"))
    want = skewed.select("id", F.max(mark).over(upto).alias("m"), F.sum("id").over(upto).alias("s"),
                         (F.row_number().over(plain) - 1).alias("pos"),
                         F.count("*").over(Window.partitionBy("key")).alias("n"))
    groups = OrderedGroups(skewed, ["key"], ["t", "id"], row_floor=FLOOR)
    rows = groups.trim(groups.rows(), keep_piece=True)
    rows = groups.running(rows, mark, "m")
    rows = groups.finish(groups.running(rows, F.col("id"), "s", "sum"))
    numbered = groups.numbered("pos", "n").select("id", "pos", "n")
    got = rows.select("id", "m", "s").join(numbered, "id")
    key = {r[0]: tuple(r[1:]) for r in want.collect()}
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == key


def test_quantiles_equal_numpy(skewed):
    got = (ranked(skewed, ["key"], "t", row_floor=FLOOR).groupBy("key").agg(
        quantile("t", 0.5).alias("p50"), quantile("t", 0.95).alias("p95"),
        at_index("t", lambda n: F.floor(n / 4)).alias("q1")))
    data = skewed.toPandas()
    for r in got.collect():
        x = np.sort(data[data.key == r.key].t.to_numpy())
        assert r.p50 == pytest.approx(np.percentile(x, 50))
        assert r.p95 == pytest.approx(np.percentile(x, 95))
        assert r.q1 == x[len(x) // 4]


def test_attach_by_hot_and_cold_keys(skewed):
    facts = skewed.groupBy("key").agg(F.max("t").alias("top"))
    groups = OrderedGroups(skewed, ["key"], ["t"], row_floor=FLOOR)
    got = attach(skewed, facts, ["key"], groups.hot_keys)
    assert rows_of(got, "id", "top") == rows_of(skewed.join(facts, "key"), "id", "top")


def test_like_skips_counting_only_without_hot_keys(skewed):
    cold = OrderedGroups(skewed, ["key"], ["t"])
    assert not OrderedGroups(skewed, ["key"], ["t"], row_floor=FLOOR, like=cold).split
    hot = OrderedGroups(skewed, ["key"], ["t"], row_floor=FLOOR)
    assert OrderedGroups(skewed, ["key"], ["t"], row_floor=FLOOR, like=hot).split


def test_equal_gaps_of_a_hot_key_are_cut(spark):
    calls = spark.range(20_000).select(
        F.lit(0).alias("rank"), F.lit("AllReduce").alias("function"), F.lit(7).cast("bigint").alias("stream"),
        F.col("id").alias("op_count"), (F.col("id") * 10**9).alias("ts_ns"))
    by_time = OrderedGroups(calls, ["rank"], ["ts_ns"], halo=1, row_floor=100)
    gaps = timing.intervals(calls, ["rank"], 100).where("gap_s IS NOT NULL")
    groups = timing.gaps_by_length(gaps, ["rank"], by_time, 100)
    largest = groups.rows().groupBy("rank", "_piece").count().agg(F.max("count")).first()[0]
    assert largest <= 300
    numbered = groups.numbered()
    assert numbered.agg(F.min("_pos"), F.max("_pos"), F.count_distinct("_pos")).first()[:] == (0, 19_998, 19_999)


def test_pieces_do_not_grow_with_the_key(spark):
    rows = spark.range(40_000).select(F.lit("hot").alias("key"), F.col("id").alias("t"))
    groups = OrderedGroups(rows, ["key"], ["t"], row_floor=10)
    largest = groups.rows().groupBy("_piece").count().agg(F.max("count")).first()[0]
    assert largest <= 30
    assert "_cuts" not in groups.rows().columns
