"""Cycles of the rank flow: strongly connected components of many graphs at once.

Each (group, function, call number, channel) is a graph over ranks.  There are very many of them
and nearly all are small, so small graphs are solved one per row inside tasks.  Graphs above a
fixed edge count are solved together by rounds of joins that stay linear in nodes and edges (no
reachability pairs are built):

1. ``shrink``: nodes without an incoming or an outgoing edge are alone in their component and
   leave; a node with exactly one edge in and one out is bridged over (its neighbours are joined by
   one edge), chosen so that no two neighbours leave together.  Chains and rings, the usual
   shapes here, vanish in a logarithmic number of rounds.
2. ``colour``: on what is left every node takes the largest label that reaches it; nodes that reach
   the owner of their colour backwards form its component.
3. Bridged nodes come back in reverse order: they belong to the component of their neighbours if
   both neighbours share one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.durable import cut_lineage

GRAPH = ["grp", "func", "func_times", "channel"]
SMALL_GRAPH_EDGES = 4096


def rank_edges(transfers: DataFrame) -> DataFrame:
    return transfers.select(*GRAPH, F.col("from_rank").alias("u"),
                            F.col("to_rank").alias("v")).distinct()


def _degrees(edges: DataFrame, g: list[str]) -> DataFrame:
    """In/out degree and, where unique, the neighbour, per node still in the graph."""
    ends = F.array(
        F.struct(F.col("u").alias("x"), F.lit(None).cast("int").alias("_in"), F.col("v").alias("_out")),
        F.struct(F.col("v").alias("x"), F.col("u").alias("_in"), F.lit(None).cast("int").alias("_out")))
    return (edges.select(*g, F.explode(ends).alias("_e")).groupBy(*g, "_e.x")
            .agg(F.count("_e._in").alias("n_in"), F.count("_e._out").alias("n_out"),
                 F.max("_e._in").alias("pred"), F.max("_e._out").alias("succ")))


def _shrink(edges: DataFrame, g: list[str]):
    """Returns the core edges and the bridged nodes of each round."""
    bridged = []
    while True:
        edges = edges.where("u <> v")
        deg = cut_lineage(_degrees(edges, g))
        alone = deg.where("n_in = 0 OR n_out = 0").select(*g, "x")
        thin = (deg.where("n_in = 1 AND n_out = 1").select(*g, "x", "pred", "succ")
                .withColumn("h", F.xxhash64("x", F.lit(len(bridged)))))
        # a thin node leaves if its mark is the largest among itself and its thin neighbours
        mark = thin.select(*g, F.col("x").alias("_n"), F.col("h").alias("_h"))
        least = F.lit(-2**63)
        top = (thin.join(mark.withColumnsRenamed({"_n": "pred", "_h": "h_pred"}), [*g, "pred"], "left")
               .join(mark.withColumnsRenamed({"_n": "succ", "_h": "h_succ"}), [*g, "succ"], "left")
               .where((F.col("h") > F.coalesce("h_pred", least)) &
                      (F.col("h") > F.coalesce("h_succ", least)))
               .select(*g, "x", "pred", "succ"))
        top = cut_lineage(top)
        gone = alone.unionByName(top.select(*g, "x"))
        if gone.isEmpty():
            return edges, bridged
        bridged.append(top)
        # a bridged node's neighbours stay or leave as singles; both ends must still be there
        bridges = top.select(*g, F.col("pred").alias("u"), F.col("succ").alias("v"))
        edges = cut_lineage(
            edges.select(*g, "u", "v").unionByName(bridges).distinct()
            .join(gone.withColumnRenamed("x", "u"), [*g, "u"], "left_anti")
            .join(gone.withColumnRenamed("x", "v"), [*g, "v"], "left_anti").select(*g, "u", "v"))


def _spread(labels: DataFrame, edges: DataFrame, g: list[str]) -> DataFrame:
    """Largest label along edges until nothing changes."""
    while True:
        sent = (edges.join(labels.withColumnRenamed("x", "u"), [*g, "u"])
                .select(*g, F.col("v").alias("x"), "label"))
        new = cut_lineage(labels.unionByName(sent).groupBy(*g, "x").agg(F.max("label").alias("label")))
        grown = new.join(labels.withColumnRenamed("label", "_old"), [*g, "x"]).where("label <> _old")
        if grown.isEmpty():
            return new
        labels = new


def _reach_back(colours: DataFrame, edges: DataFrame, g: list[str]) -> DataFrame:
    """Nodes that reach the owner of their colour along edges of one colour."""
    cu = colours.withColumnsRenamed({"x": "u", "label": "cu"})
    cv = colours.withColumnsRenamed({"x": "v", "label": "cv"})
    inner = cut_lineage(edges.join(cu, [*g, "u"]).join(cv, [*g, "v"]).where("cu = cv")
                        .select(*g, "u", "v", F.col("cu").alias("label")))
    found = cut_lineage(colours.where("x = label"))
    front = found
    while True:
        nxt = (inner.join(front.withColumnRenamed("x", "v"), [*g, "v", "label"])
               .select(*g, F.col("u").alias("x"), "label").distinct()
               .join(found, [*g, "x"], "left_anti"))
        front = cut_lineage(nxt)
        if front.isEmpty():
            return found
        found = cut_lineage(found.unionByName(front))


def _large_components(edges: DataFrame) -> DataFrame:
    """(graph, x, scc, size) by the distributed rounds; any graph size."""
    g = GRAPH
    nodes = edges.select(*g, F.explode(F.array("u", "v")).alias("x")).distinct()
    core, bridged = _shrink(edges, g)
    known = None
    while not core.isEmpty():
        ids = core.select(*g, F.explode(F.array("u", "v")).alias("x")).distinct()
        colours = _spread(ids.withColumn("label", F.col("x")), core, g)
        done = _reach_back(colours, core, g)
        known = done if known is None else known.unionByName(done)
        rest = (core.join(done.select(*g, F.col("x").alias("u")), [*g, "u"], "left_anti")
                .join(done.select(*g, F.col("x").alias("v")), [*g, "v"], "left_anti"))
        core = cut_lineage(rest.select(*g, "u", "v"))
    # nodes that left the graph without a component are alone
    own = F.col("x")
    labels = nodes.select(*g, "x", own.alias("_own")) if known is None else (
        nodes.join(known, [*g, "x"], "left").select(*g, "x", F.coalesce("label", own).alias("_own")))
    labels = cut_lineage(labels)
    for top in reversed(bridged):
        pred = labels.withColumnsRenamed({"x": "pred", "_own": "cp"})
        succ = labels.withColumnsRenamed({"x": "succ", "_own": "cs"})
        fix = (top.join(pred, [*g, "pred"]).join(succ, [*g, "succ"]).where("cp = cs")
               .select(*g, "x", F.col("cp").alias("_new")))
        labels = cut_lineage(labels.join(fix, [*g, "x"], "left").select(
            *g, "x", F.coalesce("_new", "_own").alias("_own")))
    size = labels.groupBy(*g, "_own").agg(F.count(F.lit(1)).alias("size"), F.min("x").alias("scc"))
    return labels.join(size, [*g, "_own"]).select(*g, "x", "scc", "size")


def _component_of(us, vs) -> list[tuple[int, int, int]]:
    """(node, smallest node of its component, component size) of one small graph."""
    ahead, behind = {}, {}
    for u, v in zip(us, vs):
        ahead.setdefault(u, []).append(v)
        behind.setdefault(v, []).append(u)
    finished, seen = [], set()
    for root in set(ahead) | set(behind):
        trail = [] if root in seen else [(root, iter(ahead.get(root, ())))]
        seen.add(root)
        while trail:
            node, todo = trail[-1]
            step = next((w for w in todo if w not in seen), None)
            if step is None:
                finished.append(node)
                trail.pop()
            else:
                seen.add(step)
                trail.append((step, iter(ahead.get(step, ()))))
    out, taken = [], set()
    for root in reversed(finished):
        if root in taken:
            continue
        taken.add(root)
        members = [root]
        for node in members:
            fresh = [w for w in behind.get(node, ()) if w not in taken]
            taken.update(fresh)
            members.extend(dict.fromkeys(fresh))
        low = min(members)
        out.extend((m, low, len(members)) for m in members)
    return out


def _small_components(us: pd.Series, vs: pd.Series) -> pd.Series:
    return pd.Series([_component_of(a.tolist(), b.tolist()) for a, b in zip(us, vs)])


def components(transfers: DataFrame, edge_limit: int = SMALL_GRAPH_EDGES) -> DataFrame:
    """(graph, rank, scc, size, is_cycle): scc is the smallest rank of the component.

    Graphs of at most ``edge_limit`` distinct edges travel whole as one array row each; larger
    ones take the distributed rounds.
    """
    g = GRAPH
    edges = rank_edges(transfers)
    sized = edges.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
    large = sized.where(F.col("_n") > edge_limit).select(*g)
    some_large = not large.isEmpty()
    small = edges
    if some_large:
        edges = cut_lineage(edges)
        large = cut_lineage(large)
        small = edges.join(large, g, "left_anti")
    packed = small.groupBy(*g).agg(F.collect_list(F.struct("u", "v")).alias("_e"))
    solve = F.pandas_udf(_small_components, "array<struct<x:int,scc:int,size:bigint>>")
    found = (packed.select(*g, F.explode(solve("_e.u", "_e.v")).alias("_c"))
             .select(*g, "_c.x", "_c.scc", "_c.size"))
    if some_large:
        found = found.unionByName(_large_components(edges.join(large, g, "left_semi")))
    loops = edges.where("u = v").select(*g, F.col("u").alias("x"), F.lit(True).alias("_self"))
    return (found.join(loops, [*g, "x"], "left")
            .select(*g, F.col("x").alias("rank"), "scc", "size",
                    ((F.col("size") > 1) | F.coalesce("_self", F.lit(False))).alias("is_cycle")))


def cycles(transfers: DataFrame, compat: bool = False, edge_limit: int = SMALL_GRAPH_EDGES) -> DataFrame:
    """Components that are cycles; ``compat`` lists single ranks as well."""
    out = components(transfers, edge_limit)
    return out if compat else out.where("is_cycle")
