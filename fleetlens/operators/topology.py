"""Rank tables: 3-D coordinates, groups, model placement and its validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import div
from fleetlens.functions.topology import whole, with_coordinates
from fleetlens.params import Topology


def rank_table(spark, t: Topology) -> DataFrame:
    """One row per rank of the world."""
    return with_coordinates(spark.range(t.world_size).select(F.col("id").cast("int").alias("rank")),
                            t)


def topology_table(ranks: DataFrame, t: Topology) -> DataFrame:
    """Coordinates and stage flags of the ranks in ``ranks``."""
    return (with_coordinates(ranks.select("rank").distinct(), t)
            .withColumn("is_first_pp", F.col("pp_stage") == 0)
            .withColumn("is_last_pp", F.col("pp_stage") == t.pp - 1))


def parallel_groups(ranks: DataFrame, t: Topology) -> DataFrame:
    """Members of every TP, PP and DP group (a group is at most the world size)."""
    kinds = F.array(*[F.struct(F.lit(k).alias("group_type"), F.col(c).alias("gid"))
                      for k, c in (("TP", "tp_group"), ("PP", "pp_group"), ("DP", "dp_group"))])
    return (topology_table(ranks, t).select("rank", F.explode(kinds).alias("_k"))
            .groupBy("_k.group_type", "_k.gid")
            .agg(F.sort_array(F.collect_list("rank")).alias("ranks")))


def check_topologies(configs: DataFrame) -> DataFrame:
    """DP size and verdict of each (tp, pp, world_size) row."""
    product = F.col("tp") * F.col("pp")
    dp = whole(F.col("world_size"), product)
    return configs.withColumn("dp", dp).withColumn(
        "verdict", F.when(product > F.col("world_size"), "tp_pp_exceeds_world")
        .when(F.col("world_size") % product != 0, "not_divisible").otherwise("ok"))


def placement(configs: DataFrame) -> DataFrame:
    """Layer, parameter and memory share of every rank of each model configuration.

    Input: config_id, ranks, num_layers, model_size, hidden_size, vocab_size.  The last rank takes
    the remainder of layers and parameters; only rank 0 holds the embedding; 4 bytes per number.
    """
    n, r = F.col("ranks"), F.col("rank")
    rows = configs.where(n > 0).withColumn("rank", F.explode(F.sequence(F.lit(0), n - 1)))
    last = r == n - 1

    def share(total):
        each = div(F.col(total), n)
        return each * r, F.when(last, F.col(total)).otherwise(each * (r + 1))
    l0, l1 = share("num_layers")
    p0, p1 = share("model_size")
    square = F.col("hidden_size") * F.col("hidden_size") * 4
    attention = div(square, n)
    ffn = div(square * 4, n)
    embedding = F.when(r == 0, div(F.col("vocab_size") * F.col("hidden_size") * 4, n)
                       ).otherwise(0)
    mib = F.lit(1024.0 * 1024.0)
    return rows.select(
        "config_id", "rank",
        l0.cast("bigint").alias("start_layer"), l1.cast("bigint").alias("end_layer"),
        (100.0 * (l1 - l0) / F.col("num_layers")).alias("layer_pct"),
        p0.cast("bigint").alias("start_param"), p1.cast("bigint").alias("end_param"),
        (attention / mib).alias("attention_mb"), (ffn / mib).alias("ffn_mb"),
        (embedding / mib).alias("embedding_mb"),
        ((attention + ffn + embedding) / mib).alias("total_mb"),
        F.col("num_layers").cast("bigint").alias("allreduce_calls"),
        attention.cast("bigint").alias("volume_per_call"),
        (1.0 / n).alias("ideal_efficiency"), (n - 1).cast("bigint").alias("overhead_factor"))


def placement_mismatches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Ranks whose layer or parameter range differs, or that exist on one side only."""
    cols = ["start_layer", "end_layer", "start_param", "end_param"]
    keys = ["config_id", "rank"]
    left = expected.select(*keys, *[F.col(c).alias("e_" + c) for c in cols])
    both = left.join(actual.select(*keys, *cols), keys, "full_outer")

    def differs(*names):
        out = F.lit(False)
        for c in names:
            out = out | (F.col("e_" + c) != F.col(c))
        return out
    reason = (F.when(F.col("start_layer").isNull(), "missing_rank")
              .when(F.col("e_start_layer").isNull(), "unexpected_rank")
              .when(differs("start_layer", "end_layer"), "layers")
              .when(differs("start_param", "end_param"), "parameters"))
    return both.select(*keys, reason.alias("reason")).where(F.col("reason").isNotNull())
