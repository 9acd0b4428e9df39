"""Lookups on communication calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.params import (LINK_FUNCTIONS, OPERATION_CLASSES, SIZE_BUCKETS, SLOW_SECONDS,
                              SLOW_SECONDS_DEFAULT)


def lookup(mapping: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def operation_class(function: Column) -> Column:
    flat = {name: kind for kind, names in OPERATION_CLASSES.items() for name in names}
    return F.coalesce(lookup(flat, function), F.lit("other"))


def size_bucket(size: Column) -> Column:
    """Largest bucket whose bound is not above the size, else ``tiny``."""
    out = F.lit("tiny")
    for name, bound in sorted(SIZE_BUCKETS.items(), key=lambda kv: kv[1]):
        out = F.when(size >= bound, F.lit(name)).otherwise(out)
    return out


def slow_limit(function: Column) -> Column:
    return F.coalesce(lookup(SLOW_SECONDS, function), F.lit(SLOW_SECONDS_DEFAULT))


def link_function(code: Column) -> Column:
    return F.coalesce(lookup(LINK_FUNCTIONS, code.cast("int")), F.lit("Unknown"))


def arrow(a: Column, b: Column) -> Column:
    return F.concat_ws("->", a.cast("string"), b.cast("string"))
