"""Parallel coordinates of a rank as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.numbers import div
from fleetlens.params import Topology


def whole(a, b) -> Column:
    return div(a, b).cast("int")


def tp_group(rank: Column, t: Topology) -> Column:
    return whole(rank, t.tp)


def pp_stage(rank: Column, t: Topology) -> Column:
    return whole(rank, t.world_size // t.pp)


def dp_group(rank: Column, t: Topology) -> Column:
    return (whole(rank, t.tp * t.dp) * t.tp + rank % t.tp).cast("int")


def with_coordinates(df: DataFrame, t: Topology, rank: str = "rank") -> DataFrame:
    r = F.col(rank)
    stage_width = t.world_size // t.pp
    return df.withColumns({
        "tp_pos": (r % t.tp).cast("int"),
        "tp_group": tp_group(r, t),
        "pp_stage": pp_stage(r, t),
        "pp_group": (r % stage_width).cast("int"),
        "dp_pos": (whole(r, t.tp) % t.dp).cast("int"),
        "dp_group": dp_group(r, t),
    })
