"""Which rank hung, and on which stream?"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.params import HangLimits
from fleetlens.plans.sizes import bounded


def last_batch(calls: DataFrame) -> DataFrame:
    """Rows of each rank's last flush batch: a combined max per rank, joined back."""
    last = calls.groupBy("rank").agg(F.max("save_count").alias("save_count"))
    return calls.join(bounded(last), ["rank", "save_count"], "left_semi")


def last_calls(calls: DataFrame, batch_only: bool = True) -> DataFrame:
    """Last call per (rank, stream) with the time of the call before.

    ``place <= 2`` lets Spark keep two rows per key before the shuffle, so a stream with most of
    all rows costs no more than a quiet one.
    """
    rows = last_batch(calls) if batch_only else calls
    order = [c for c in ("ts_ns", "op_count", "event_id") if c in rows.columns]
    late = Window.partitionBy("rank", "stream").orderBy(*[F.col(c).desc() for c in order])
    two = rows.withColumn("place", F.row_number().over(late)).where(F.col("place") <= 2)
    first = F.col("place") == 1

    def of_last(name):
        return F.max(F.when(first, F.col(name))).alias(name)
    return two.groupBy("rank", "stream").agg(
        of_last("function"), of_last("op_count"), of_last("ts_ns"),
        F.max(F.when(~first, F.col("ts_ns"))).alias("before_ns"))


def _now(calls: DataFrame, as_of_ns) -> Column:
    """Judging time; by default the newest call of any rank."""
    return F.lit(as_of_ns) if as_of_ns is not None else calls.agg(F.max("ts_ns")).scalar()


def stream_hangs(calls: DataFrame, as_of_ns: int | None = None,
                 limits: HangLimits = HangLimits()) -> DataFrame:
    """Streams without a new call for longer than the limit."""
    idle = (_now(calls, as_of_ns) - F.col("ts_ns")) / 1e9
    return (last_calls(calls).withColumn("idle_s", idle)
            .where(F.col("idle_s") > limits.stream_idle_s)
            .select("rank", "stream", "function", "op_count", "idle_s",
                    F.when(F.col("idle_s") > limits.stream_idle_high_s, "high")
                    .otherwise("medium").alias("severity")))


def collective_hangs(calls: DataFrame, limits: HangLimits = HangLimits()) -> DataFrame:
    """Streams that end in a watched collective after a long gap."""
    gap = (F.col("ts_ns") - F.col("before_ns")) / 1e9
    return (last_calls(calls).where(F.col("function").isin(*limits.watched))
            .withColumn("gap_s", gap).where(F.col("gap_s") > limits.collective_gap_s)
            .select("rank", "stream", "function", "op_count", "gap_s",
                    F.lit("high").alias("severity")))


def sync_comparison(calls: DataFrame) -> DataFrame:
    """Last operation numbers: which are shared, by how many streams and ranks and functions."""
    return (last_calls(calls).groupBy("op_count")
            .agg(F.count(F.lit(1)).alias("streams"), F.min("rank").alias("first_rank"),
                 F.max("rank").alias("last_rank"),
                 F.concat_ws(",", F.sort_array(F.collect_set("function"))).alias("functions"))
            .withColumn("is_unique", F.col("streams") == 1))


def sync_ranks(calls: DataFrame) -> DataFrame:
    """Ranks per function at each last operation number that several streams share.

    Only last calls are grouped: a list holds every rank once at most, and the window over an
    operation number has a row per function.
    """
    each = (last_calls(calls).groupBy("op_count", "function")
            .agg(F.count(F.lit(1)).alias("streams"), F.concat_ws(",", F.sort_array(
                F.collect_set("rank")).cast("array<string>")).alias("ranks")))
    shared = F.sum("streams").over(Window.partitionBy("op_count"))
    return each.withColumn("_all", shared).where("_all > 1").drop("_all")


def hang_candidate(calls: DataFrame) -> DataFrame:
    """The stream that alone holds the smallest last operation number."""
    last = last_calls(calls)
    solo = last.groupBy("op_count").agg(F.count(F.lit(1)).alias("streams"),
                                        F.min("rank").alias("rank"),
                                        F.min("stream").alias("stream"),
                                        F.min("function").alias("function"))
    return (solo.where("streams = 1").orderBy("op_count").limit(1)
            .select("rank", "stream", "function", "op_count"))


def missing_calls(calls: DataFrame, group: str = "group_hash") -> DataFrame:
    """For every rank of a communicator, the first operation that others of it logged and the rank did not.

    ``missing`` counts such operations, ``last_op`` is the rank's own newest, ``function`` the (first) function
    that the others called.  Operation numbers become bitmaps of 32 768 per row before any shuffle; a
    communicator's bitmaps are combined and compared with each rank's.  Calls without communicator, rank or
    operation number say nothing.
    """
    rows = calls.where(F.col(group).isNotNull() & F.col("rank").isNotNull() & (F.col("op_count") >= 0))
    number = F.col("op_count") + 1  # the numbering of bitmaps starts at 1
    own = (rows.groupBy(group, "rank", F.bitmap_bucket_number(number).alias("_b"))
           .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_own"), F.max("op_count").alias("_last")))
    every = own.groupBy(group, "_b").agg(F.bitmap_or_agg("_own").alias("_all"))
    ranks = own.groupBy(group, "rank").agg(F.max("_last").alias("last_op"))
    absent = first_absent(F.col("_all"), F.col("_own"))
    found = (every.join(ranks, group).join(own.drop("_last"), [group, "rank", "_b"], "left")
             .select(group, "rank", "last_op", "_b", absent.alias("_a")).where("_a.n > 0")
             .groupBy(group, "rank", "last_op").agg(
                 F.min((F.col("_b") - 1) * 32768 + F.col("_a.first")).alias("op_count"), F.sum("_a.n").alias("missing")))
    asked = found.select(group, "op_count").distinct()
    said = rows.join(asked, [group, "op_count"]).groupBy(group, "op_count").agg(F.min("function").alias("function"))
    return found.join(said, [group, "op_count"]).select(group, "rank", "op_count", "function", "missing", "last_op")


def first_absent(every: Column, own: Column) -> Column:
    """Lowest bit set in ``every`` and not in ``own`` (null: none set), and how many there are."""

    @F.arrow_udf("struct<first: int, n: long>")
    def absent(every: pa.Array, own: pa.Array) -> pa.Array:
        first, n = [], []
        for a, b in zip(every, own):
            left = np.frombuffer(a.as_buffer(), np.uint8)
            if b.is_valid:
                left = left & ~np.frombuffer(b.as_buffer(), np.uint8)
            bits = np.flatnonzero(np.unpackbits(left, bitorder="little"))
            first.append(int(bits[0]) if len(bits) else None)
            n.append(len(bits))
        return pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(n, pa.int64())], ["first", "n"])

    return absent(every, own)


def operation_gaps(calls: DataFrame, limits: HangLimits = HangLimits()) -> DataFrame:
    """Streams whose last call came late: a send or receive after its own limit, any other call after the general
    one.  Watched collectives have their own job, ``collective_hangs``."""
    gap = (F.col("ts_ns") - F.col("before_ns")) / 1e9
    pair = F.col("function").isin(*limits.point_to_point)
    return (last_calls(calls).where(~F.col("function").isin(*limits.watched)).withColumn("gap_s", gap)
            .withColumn("limit_s", F.when(pair, limits.send_recv_gap_s).otherwise(limits.operation_gap_s))
            .where(F.col("gap_s") > F.col("limit_s"))
            .select("rank", "stream", "function", "op_count", "gap_s", "limit_s"))
