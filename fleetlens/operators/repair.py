"""Communicator hashes that the producer's buffer cut off, completed from the whole ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HASH_LENGTH = 20  # characters of a signed 64-bit number


def repair_hashes(calls: DataFrame, cut: str = "cut") -> DataFrame:
    """Calls with ``repair``: kept, repaired, ambiguous or unknown; the last two lose their ``group_hash``.

    ``cut`` marks calls whose hash may lack its end (null counts as not).  A cut hash is completed by the one
    hash that starts with it, was logged whole for the same function and operation by any rank, and whole by
    this rank for anything.  A rank that logged none such whole takes the one of the same function and
    operation.  Several are ambiguous, none is unknown.  Hashes meet by their prefixes of the lengths
    that occur, in equi-joins of distinct rows, so no row is made per pair of calls.
    """
    is_cut, text = F.coalesce(F.col(cut), F.lit(False)), F.coalesce(F.col("group_hash").cast("string"), F.lit(""))
    rows = calls.withColumn("_cut", F.when(is_cut, text))
    whole = calls.where(~is_cut & F.col("group_hash").isNotNull())
    asked = rows.where("_cut IS NOT NULL").select("rank", "function", "op_count", "_cut").distinct()
    # at most HASH_LENGTH + 1 lengths
    lengths = sorted(r.n for r in asked.select(F.length("_cut").alias("n")).distinct().collect())
    sizes = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")

    def starts(df, *columns):
        prefix = F.explode(F.transform(sizes, lambda n: F.substring(F.col("group_hash").cast("string"), F.lit(1), n)))
        return df.select(*columns, "group_hash").distinct().withColumn("_cut", prefix).distinct()
    there = starts(whole, "function", "op_count")
    mine = starts(whole, "rank")
    known = there.groupBy("function", "op_count", "_cut").agg(F.count(F.lit(1)).alias("_n2"), F.min("group_hash").alias("_h2"))
    own = (asked.join(mine, ["rank", "_cut"]).join(there, ["function", "op_count", "_cut", "group_hash"], "left_semi")
           .groupBy("rank", "function", "op_count", "_cut").agg(F.count(F.lit(1)).alias("_n1"), F.min("group_hash").alias("_h1")))
    said = (asked.join(own, ["rank", "function", "op_count", "_cut"], "left")
            .join(known, ["function", "op_count", "_cut"], "left")
            .select("rank", "function", "op_count", "_cut", F.coalesce("_n1", "_n2", F.lit(0)).alias("_n"),
                    F.when(F.col("_n1").isNotNull(), F.col("_h1")).otherwise(F.col("_h2")).alias("_h")))
    n = F.coalesce("_n", F.lit(0))
    out = rows.join(said, ["rank", "function", "op_count", "_cut"], "left")
    mark = (F.when(F.col("_cut").isNull(), "kept").when(n == 1, "repaired").when(n > 1, "ambiguous").otherwise("unknown"))
    value = F.when(F.col("_cut").isNull(), F.col("group_hash")).when(n == 1, F.col("_h"))
    return out.withColumns({"repair": mark, "group_hash": value}).select(*calls.columns, "repair")
