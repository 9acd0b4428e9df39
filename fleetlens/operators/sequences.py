"""Gap-free call sequences and interval forecasts inside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import div
from fleetlens.params import SEQUENCE_PRESETS, SequenceLimits
from fleetlens.plans.durable import cut_lineage
from fleetlens.plans.ordered import OrderedGroups, attach

STREAM = ["rank", "stream", "save_count"]
ISLAND = [*STREAM, "start_op"]


TRAILING = 3
TRAINING_TENTHS = 7


def island_calls(calls: DataFrame, row_floor: int | None = None, gaps: bool = False) -> DataFrame:
    """Calls with their island and their index in it, on one shuffle by (rank, stream, batch).

    An operation number that does not follow its predecessor opens an island.  Numbers grow by one
    inside an island, so the index is ``op_count - start_op``.  A repeated number opens an island
    too; ``island_no`` keeps islands with equal start apart.  With ``gaps`` the last intervals (ns)
    come along: ``_g0`` ends at this call, ``_g1`` at the one before, null outside the island.
    """
    order = [c for c in ("op_count", "ts_ns", "event_id") if c in calls.columns]
    groups = OrderedGroups(calls, STREAM, order, halo=TRAILING + 2 if gaps else 1,
                           row_floor=row_floor)
    w = groups.window()
    before = F.lag("op_count").over(w)
    rows = groups.rows().withColumn(
        "_new", (before.isNull() | (F.col("op_count") != before + 1)).cast("int"))
    if gaps:
        rows = rows.withColumn("_gap", F.col("ts_ns") - F.lag("ts_ns").over(w))
        rows = rows.withColumns({f"_g{k}": F.when(
            F.max("_new").over(w.rowsBetween(-k, 0)) == 0, F.lag("_gap", k).over(w))
            for k in range(TRAILING + 1)}).drop("_gap")
    rows = groups.trim(rows, keep_piece=True)
    rows = groups.running(rows, F.when(F.col("_new") == 1, F.col("op_count")), "start_op")
    rows = groups.running(rows, F.col("_new").cast("bigint"), "island_no", "sum")
    return (groups.finish(rows).drop("_new")
            .withColumn("idx", F.col("op_count") - F.col("start_op")))


def sequences(calls: DataFrame, row_floor: int | None = None) -> DataFrame:
    """Islands of two or more consecutive operation numbers."""
    return (island_calls(calls, row_floor).groupBy(*ISLAND, "island_no")
            .agg(F.count(F.lit(1)).alias("length"), F.max("op_count").alias("end_op"),
                 F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))
            .where("length >= 2").drop("island_no"))


def island_gaps(calls: DataFrame, row_floor: int | None = None) -> DataFrame:
    """Intervals inside islands with the trailing forecast.

    Interval ``i`` (0-based) lies between calls ``i`` and ``i + 1``; its forecast is the mean of up
    to three intervals before it.
    """
    rows = island_calls(calls, row_floor, gaps=True).where(F.col("idx") >= 1)
    total = F.lit(0).cast("bigint")
    for k in range(1, TRAILING + 1):
        total = total + F.coalesce(F.col(f"_g{k}"), F.lit(0))
    known = F.least(F.col("idx") - 1, F.lit(TRAILING))
    return rows.select(
        *ISLAND, "island_no", (F.col("idx") - 1).alias("gap_idx"), "ts_ns",
        (F.col("_g0") / 1e9).alias("actual_s"),
        F.when(known > 0, total / known / 1e9).alias("predicted_s"))


Forecaster = Callable[[DataFrame], DataFrame]
_FORECASTERS: dict[str, Forecaster] = {"trailing_mean": lambda gaps: gaps}


def register_forecaster(name: str, forecaster: Forecaster) -> None:
    """Add a forecaster: a DataFrame of island gaps in, the same with ``predicted_s`` out."""
    _FORECASTERS[name] = forecaster


def _residuals(gaps: DataFrame, compat: bool) -> DataFrame:
    base = F.col("actual_s") if compat else F.abs(F.col("actual_s"))
    miss = F.abs(F.col("actual_s") - F.col("predicted_s"))
    return gaps.withColumn("deviation", F.when(F.col("actual_s") == 0, miss).otherwise(miss / base))


def forecast_anomalies(calls: DataFrame, limits: SequenceLimits = SequenceLimits(),
                       forecaster: str = "trailing_mean", compat: bool = False,
                       row_floor: int | None = None) -> DataFrame:
    """Intervals that miss their forecast by more than ``threshold`` times their own length."""
    gaps = _FORECASTERS[forecaster](island_gaps(calls, row_floor))
    return (_residuals(gaps.where(F.col("gap_idx") >= limits.lags), compat)
            .where(F.round("deviation", 9) > limits.threshold))


def linear_forecast(calls: DataFrame, lags: int = 10, row_floor: int | None = None,
                    penalty: float = 1e-3) -> DataFrame:
    """Lag-feature regression: ``lags`` intervals to the next, fitted on the earlier part of every
    island and applied to the rest.

    The first ``TRAINING_TENTHS`` tenths of an island's intervals train the model and give the minimum
    and maximum that scale the island, so no prediction knows what comes after it.  One model is
    fitted on all islands by a distributed solver.  Where no island is long enough to train on, the
    forecast is the mean of the last intervals, as in ``island_gaps``.  The intervals and their table of
    lags are written once each, as counting, fitting and predicting go over them several times.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    gaps = cut_lineage(island_gaps(calls, row_floor).withColumnRenamed("predicted_s", "_mean"))
    island = [*ISLAND, "island_no"]
    sized = OrderedGroups(gaps, island, ["gap_idx"], halo=lags, row_floor=row_floor)
    ends = gaps.groupBy(*island).agg(
        div((F.max("gap_idx") + 1) * TRAINING_TENTHS, 10).alias("_train"))
    w = sized.window()
    names = [f"_l{i}" for i in range(1, lags + 1)]
    lagged = attach(sized.trim(sized.rows().withColumns(
        {n: F.lag("actual_s", i).over(w) for i, n in enumerate(names, 1)})), ends, island, sized.hot_keys)
    span = (attach(gaps, ends, island, sized.hot_keys).where("gap_idx < _train").groupBy(*island)
            .agg(F.min("actual_s").alias("_lo"), F.max("actual_s").alias("_hi")))
    width = F.col("_hi") - F.col("_lo")

    def scaled(c):
        return F.when(width > 0, (F.col(c) - F.col("_lo")) / width).otherwise(F.col(c))
    table = cut_lineage(attach(lagged.where(F.col("gap_idx") >= lags), span, island, sized.hot_keys)
                        .withColumns({**{n: scaled(n) for n in names}, "_y": scaled("actual_s")}))
    vectors = VectorAssembler(inputCols=names, outputCol="_x").transform(table)
    known, asked = vectors.where("gap_idx < _train"), vectors.where("gap_idx >= _train")
    if known.isEmpty():
        out = asked.withColumn("predicted_s", F.col("_mean"))
    else:
        model = LinearRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", solver="normal",
                                 regParam=penalty).fit(known)
        back = F.when(width > 0, F.col("_p") * width + F.col("_lo")).otherwise(F.col("_p"))
        out = model.transform(asked).withColumn("predicted_s", back)
    return _residuals(out, False).select(*ISLAND, "gap_idx", "ts_ns", "actual_s", "predicted_s",
                                         "deviation")


def sequence_rollup(calls: DataFrame, limits: SequenceLimits = SequenceLimits(),
                    row_floor: int | None = None) -> DataFrame:
    """Anomaly count and largest deviation per sequence, per stream and per rank."""
    hits = forecast_anomalies(calls, limits, row_floor=row_floor)
    none = F.lit(None)
    levels = F.array(
        F.struct(F.lit("sequence").alias("level"), F.col("stream").alias("stream"),
                 F.col("save_count").alias("save_count"), F.col("start_op").alias("start_op")),
        F.struct(F.lit("stream").alias("level"), F.col("stream").alias("stream"),
                 none.cast("int").alias("save_count"), none.cast("bigint").alias("start_op")),
        F.struct(F.lit("rank").alias("level"), none.cast("string").alias("stream"),
                 none.cast("int").alias("save_count"), none.cast("bigint").alias("start_op")))
    return (hits.select("rank", "gap_idx", "deviation", F.explode(levels).alias("_l"))
            .groupBy("_l.level", "rank", "_l.stream", "_l.save_count", "_l.start_op")
            .agg(F.count(F.lit(1)).alias("anomalies"), F.max("deviation").alias("max_deviation"),
                 F.min("gap_idx").alias("first_idx"), F.max("gap_idx").alias("last_idx")))


def preset_sweep(calls: DataFrame, presets=SEQUENCE_PRESETS, row_floor: int | None = None
                 ) -> DataFrame:
    """Anomalies found under each preset, all presets in one pass over the residuals."""
    rows = _residuals(island_gaps(calls, row_floor), False)
    tests = F.array(*[F.struct(F.lit(k).alias("lags"), F.lit(float(t)).alias("threshold"))
                      for k, t in presets])
    return (rows.select("rank", "stream", "gap_idx", F.round("deviation", 9).alias("deviation"),
                        F.explode(tests).alias("_t"))
            .where((F.col("gap_idx") >= F.col("_t.lags")) &
                   (F.col("deviation") > F.col("_t.threshold")))
            .groupBy("_t.lags", "_t.threshold").agg(
                F.count(F.lit(1)).alias("anomalies"),
                F.max("deviation").alias("max_deviation")))
