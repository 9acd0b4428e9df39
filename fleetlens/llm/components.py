"""Connected components of a graph given as links between ids, in a logarithmic number of rounds.

Alternates two star steps until no link changes: every node's larger neighbours are hung below the
smallest id around it, then every node's smaller neighbours are (Kiveris et al., 2014).  A node with
very many links never gathers them in one task: both steps are a minimum per node and a join.
Each round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import written


def _smallest(links: DataFrame) -> DataFrame:
    """Per node the smallest of its neighbours and itself; the aggregation combines map side."""
    return links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def _star(links: DataFrame, large: bool) -> DataFrame:
    if large:  # all neighbours, of which the larger are hung
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung = both.join(_smallest(both), "a").where("b > a")
        return hung.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _smallest(down)
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return (hung.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def _mark(links: DataFrame):
    """Equal for equal sets of links; different sets agree with a probability of about 2**-64."""
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``; component is the smallest id."""
    now = written(links.where("a <> b")
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while True:
        now = written(_star(_star(now, True), False), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def as_links(place: DataFrame, node: str = "node") -> DataFrame:
    """The fewest links that give these components again."""
    return place.where(F.col(node) != F.col("component")).select(F.col(node).alias("a"), F.col("component").alias("b"))
