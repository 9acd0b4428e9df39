"""Nearest neighbours through learned partitions.

A sample of at most ``SAMPLE`` vectors (those with the smallest hash of their id) gets its neighbour
graph; the graph is partitioned into parts of nearly equal size with few cut edges (grown from far
seeds, then moved along majorities under a size limit), and a small classifier learns to tell from
a vector in which parts its neighbours lie.  The classifier then places *every* row in its most probable
part, and sends a query to its ``probes`` most probable parts, and to further ones until they hold enough
rows.  Candidates there are ranked by their exact distance in double precision (Dong et al., 2020).

What the driver holds is bounded by the sample and the number of parts.  Parts are cut into blocks of at
most about ``BLOCK_ROWS`` rows and queries into groups of ``QUERY_ROWS`` (a block is sent once for each), so one
part, or one vector that very many rows repeat, never fills a task; each block and group of queries yields the best
``k`` rows per query, which are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import written

SAMPLE = 8192
PARTS = 16
# vectors without any structure need most parts for a recall above 0.9; clustered ones few
PROBES = 13
NEIGHBOURS = 30
BLOCK_ROWS = 4096
QUERY_ROWS = 16384
SLACK = 1.05


@dataclass(frozen=True)
class Router:
    """A classifier with one hidden layer; ``scores`` gives the log-probability of each part."""

    mean: np.ndarray
    scale: float
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum((x - self.mean) / self.scale @ self.first + self.first_bias, 0)
        z = hidden @ self.second + self.second_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The nearest other rows of each row (fewer than ``k`` only if there are fewer rows)."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), max(k, 0)), np.int64)
    square = (x * x).sum(1)
    for i in range(0, len(x) if k > 0 else 0, 512):
        d = square[None] - 2 * x[i:i + 512] @ x.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i:i + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for every node: at most ``SLACK`` times the mean size each, few edges between parts."""
    n = len(graph)
    room = int(np.ceil(n / parts * SLACK))
    seeds = [int(rng.integers(n))]
    far = np.full(n, np.inf)
    while len(seeds) < parts:  # far from each other
        far = np.minimum(far, ((x - x[seeds[-1]]) ** 2).sum(1))
        seeds.append(int(far.argmax()))
    part, size = np.full(n, -1), np.zeros(parts, np.int64)
    both = [[] for _ in range(n)]
    for a, row in enumerate(graph):
        for b in row.tolist():
            both[a].append(b)
            both[b].append(a)
    edge = [[s] for s in seeds]
    while (part < 0).any():  # the smallest part takes a node at its edge, or the nearest free one
        order = size.argsort(kind="stable")
        p = int(order[0])
        node = -1
        while edge[p]:
            node = edge[p].pop()
            if part[node] < 0:
                break
            node = -1
        if node < 0:
            free = np.flatnonzero(part < 0)
            node = int(free[((x[free] - x[seeds[p]]) ** 2).sum(1).argmin()])
        part[node] = p
        size[p] += 1
        edge[p] = [b for b in both[node] if part[b] < 0] + edge[p]
    for _ in range(10):
        moved = 0
        for a in rng.permutation(n).tolist():
            votes = np.bincount(part[both[a]], minlength=parts) if both[a] else np.zeros(parts)
            votes = np.where(size < room, votes, 0)
            best, own = int(votes.argmax()), part[a]
            if best != own and votes[best] > np.count_nonzero(part[both[a]] == own):
                size[own] -= 1
                size[best] += 1
                part[a], moved = best, moved + 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, parts: int = PARTS, seed: int = 5) -> Router:
    """Partition the neighbour graph of the sample, and learn the parts of each row's neighbours."""
    rng = np.random.default_rng(seed)
    parts = max(1, min(parts, len(x) // 8))
    graph = neighbour_graph(x, NEIGHBOURS)
    part = balanced_partition(x, graph, parts, rng)
    want = np.zeros((len(x), parts))
    np.add.at(want, (np.arange(len(x)), part), 1.0)
    for column in graph.T:
        np.add.at(want, (np.arange(len(x)), part[column]), 1.0)
    want /= want.sum(1, keepdims=True)
    mean, scale = x.mean(0), float(x.std() or 1.0)
    z = (x - mean) / scale
    dims, hidden = x.shape[1], 128
    w = [rng.normal(0, (2 / dims) ** 0.5, (dims, hidden)), np.zeros(hidden),
         rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(40):
        for some in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            h = np.maximum(z[some] @ w[0] + w[1], 0)
            s = h @ w[2] + w[3]
            p = np.exp(s - s.max(1, keepdims=True))
            e = (p / p.sum(1, keepdims=True) - want[some]) / len(some)
            back = (e @ w[2].T) * (h > 0)
            grads = [z[some].T @ back + 1e-4 * w[0], back.sum(0), h.T @ e + 1e-4 * w[2], e.sum(0)]
            t += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - 2e-3 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    return Router(mean, scale, *w)


def usable(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``(vec_id, v)`` as doubles.  Vectors that are null, zero, hold a null or a number that is not
    finite, or have not the most frequent length (the smaller of two), and rows without id, are out."""
    v = F.col(column).cast("array<double>")
    rows = (vectors.select(F.col(key).alias("vec_id"), v.alias("v"))
            .where("vec_id IS NOT NULL AND v IS NOT NULL")
            .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
            .where(F.exists("v", lambda x: x != 0.0)))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].n if sizes else 0))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def ranked_parts(v: Column, router: Router) -> Column:
    """All parts of a vector, the most probable first."""

    @F.arrow_udf("array<int>")
    def parts(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.int32()))
        order = np.argsort(-router.scores(_matrix(column, len(router.mean))), axis=1, kind="stable").astype(np.int32)
        ends = np.arange(len(order) + 1, dtype=np.int32) * order.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(order.ravel()))

    return parts(v)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, probes: int = PROBES, parts: int = PARTS,
            sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query, by Euclidean
    distance and then id, without the query's own id.  Repeated rows are candidates of their own; an id that
    several query rows have is one query, with the smallest of their vectors."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    # at most ``sample`` vectors
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = fit_router(np.array([r.v for r in some], float), parts)
    dims = len(router.mean)
    placed = written(rows.withColumn("parts", ranked_parts(F.col("v"), router))
                     .select("vec_id", "v", F.col("parts")[0].alias("part"),
                             F.when(is_query, F.col("parts")).alias("ask")), "placed")
    counts = dict(placed.groupBy("part").count().collect())  # one row per part
    n_parts = len(router.second_bias)
    blocks = {p: -(-n // BLOCK_ROWS) for p, n in counts.items()}
    # an id that is repeated asks once, with its smallest vector
    asking = (placed.where("ask IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("v", "ask")).alias("q"))
              .select("vec_id", "q.v", "q.ask"))
    n_queries = asking.count()
    groups = max(1, -(-n_queries // QUERY_ROWS))
    held = F.array(*[F.lit(int(counts.get(p, 0))) for p in range(n_parts)])
    cut = F.array(*[F.lit(int(blocks.get(p, 0))) for p in range(n_parts)])
    group = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")
    # parts are taken in order while fewer than ``probes`` of them, or fewer rows than k + 1, came before
    before = F.transform(F.sequence(F.lit(0), F.lit(n_parts - 1)), lambda i: F.aggregate(
        F.slice("ask", F.lit(1), i), F.lit(0).cast("long"), lambda s, p: s + F.element_at(held, p + 1)))
    queries = (asking.select(
        F.col("vec_id").alias("query_id"), F.col("v").alias("q"), group.alias("grp"),
        F.posexplode(F.arrays_zip(F.col("ask").alias("part"), before.alias("before"))).alias("i", "x"))
        .where((F.col("i") < probes) | (F.col("x.before") < k + 1))
        .select("query_id", "q", "grp", F.col("x.part").alias("part"))
        .withColumn("blk", F.explode(F.sequence(F.lit(1), F.greatest(F.element_at(cut, F.col("part") + 1), F.lit(1))))))
    owner = (F.pmod(F.xxhash64("vec_id", F.lit(2)), F.element_at(cut, F.col("part") + 1).cast("long")) + 1).cast("int")
    candidates = (placed.select("vec_id", "v", "part", owner.alias("blk"))
                  .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))

    def search(asked: pa.Table, held_rows: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if asked.num_rows and held_rows.num_rows:
            q, v = _matrix(asked.column("q"), dims), _matrix(held_rows.column("v"), dims)
            ids = np.asarray(held_rows.column("vec_id"))
            for query, one in zip(np.asarray(asked.column("query_id")).tolist(), q):
                d = v - one
                score = np.sqrt((d * d).sum(1))
                score[ids == query] = np.inf
                order = np.lexsort((ids, score)) if len(ids) <= 4 * k else None
                if order is None:  # all ties of the k-th place come along before the sort
                    near = np.flatnonzero(score <= np.partition(score, k)[k])
                    order = near[np.lexsort((ids[near], score[near]))]
                order = [i for i in order[:k] if np.isfinite(score[i])]
                out["query_id"] += [query] * len(order)
                out["vec_id"] += ids[order].tolist()
                out["score"] += score[order].tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})

    keys = ["part", "blk", "grp"]
    found = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(
        search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
