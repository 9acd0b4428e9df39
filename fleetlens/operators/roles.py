"""What is a stream used for? Labels are not exclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_roles(calls: DataFrame) -> DataFrame:
    """BARRIER / PP / TP / DP flags per (rank, stream).

    Distinct operation numbers are counted on deduplicated rows, so a hot stream is combined map
    side; the final pick per rank runs over one row per stream.
    """
    f = F.lower("function")
    traits = calls.groupBy("rank", "stream").agg(
        (F.max("data_size") < 1024).alias("is_barrier"),
        F.bool_and(f.contains("send") | f.contains("recv")).alias("is_pp"),
        F.bool_and(f.contains("reduce") | f.contains("allgather")).alias("_reduce"))
    ops = (calls.select("rank", "stream", "op_count").distinct().groupBy("rank", "stream")
           .agg(F.count(F.lit(1)).alias("op_counts")))
    streams = traits.join(ops, ["rank", "stream"])
    chosen = streams.where("_reduce").groupBy("rank").agg(
        F.min(F.struct((-F.col("op_counts")).alias("_c"), F.col("stream"))).alias("_tp"),
        F.min(F.struct(F.col("op_counts").alias("_c"), F.col("stream"))).alias("_dp"))
    return (streams.join(chosen, "rank", "left")
            .select("rank", "stream", "op_counts", "is_barrier", "is_pp",
                    F.coalesce(F.col("_tp.stream") == F.col("stream"), F.lit(False)).alias("is_tp"),
                    F.coalesce(F.col("_dp.stream") == F.col("stream"), F.lit(False)).alias("is_dp")))
