"""States of a small automaton along the ordered rows of a key, in bounded pieces.

Every row carries its move: for each of ``n`` states, the state after it.  Moves compose, so a block of rows is
one small array again, whatever its length; blocks of blocks give each block the state it starts in (a parallel
prefix), and only then are rows visited, block by block.  No array grows with a key: blocks hold ``block`` rows,
and what is left of a key at the top is a row per ``block ** 2`` blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import div
from fleetlens.plans.ordered import OrderedGroups

BLOCK = 512


def _composed(moves: Column, n: int) -> Column:
    start = F.array(*[F.lit(s) for s in range(n)])
    return F.aggregate(moves, start, lambda acc, move: F.transform(acc, lambda s: F.get(move, s)))


def _states_before(moves: Column, start: Column) -> Column:
    """The state before every move of a short list."""
    begin = F.struct(start.cast("int").alias("s"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(moves, begin, lambda acc, move: F.struct(
        F.get(move, acc["s"]).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")))["out"]


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join by keys that may be null."""
    theirs = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(theirs, on).drop(*[f"_of_{k}" for k in keys])


def states_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], move: str, n: int, name: str,
                  block: int = BLOCK, row_floor: int | None = None, like: OrderedGroups | None = None,
                  sizes_from: DataFrame | None = None) -> DataFrame:
    """``df`` without ``move`` and with the state each row is met in; a key starts in state 0.

    ``move`` is an ``array<int>`` of length ``n``; rows of equal order go in any order.
    """
    keys = list(keys)
    groups = OrderedGroups(df, keys, order, row_floor=row_floor, like=like, sizes_from=sizes_from)
    columns = [c for c in df.columns if c not in (*keys, move)]
    rows = groups.numbered("_pos", None).select(
        *keys, div(F.col("_pos"), block).alias("_b0"),
        F.struct("_pos", F.col(move).alias("_move"), *columns).alias("_row"))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("_row._pos").alias("p"), F.col("_row").alias("r"))))
    blocks = rows.groupBy(*keys, "_b0").agg(ordered.alias("_l")).select(
        *keys, "_b0", F.transform("_l", lambda x: x["r"]).alias("_rows"))
    small = blocks.select(*keys, "_b0", _composed(F.transform("_rows", lambda r: r["_move"]), n).alias("_m"))

    def lists(parts, at, upper):
        """Blocks of blocks: the numbers and moves of the blocks inside, in order."""
        out = parts.groupBy(*keys, *upper).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("b"), "_m"))).alias("_l"))
        return out.select(*keys, *upper, F.transform("_l", lambda x: x["b"]).alias("_bs"),
                          F.transform("_l", lambda x: x["_m"]).alias("_ms"))

    def entered(parts, at, start):
        """Every block inside with the state it starts in."""
        pairs = F.arrays_zip(F.col("_bs").alias("b"), _states_before(F.col("_ms"), start).alias("s"))
        return parts.select(*keys, F.explode(pairs).alias("_e")).select(
            *keys, F.col("_e.b").alias(at), F.col("_e.s").alias("_start"))
    middle = lists(small.withColumn("_b1", div(F.col("_b0"), block)), "_b0", ["_b1"])
    top = lists(middle.select(*keys, "_b1", _composed(F.col("_ms"), n).alias("_m")), "_b1", [])
    middle = _join(middle, entered(top, "_b1", F.lit(0)), [*keys, "_b1"])
    blocks = _join(blocks, entered(middle, "_b0", F.col("_start")), [*keys, "_b0"])
    states = _states_before(F.transform("_rows", lambda r: r["_move"]), F.col("_start"))
    met = F.explode(F.arrays_zip(F.col("_rows").alias("r"), states.alias("s")))
    return blocks.select(*keys, met.alias("_e")).select(
        *[F.col(c) if c in keys else F.col(f"_e.r.{c}").alias(c) for c in df.columns if c != move],
        F.col("_e.s").alias(name))
