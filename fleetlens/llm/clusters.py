"""Centroid clustering of integer vectors, with centroids filtered by an n-simplex projection.

A vector's exact distances to a few pivots are computed once and kept as the coordinates of an apex
over the simplex of the pivots: a point in as many dimensions as there are pivots, the last of them its
height over the simplex.  For two vectors with apexes ``a`` and ``b``, the Euclidean distance of the
apexes is a lower bound of their distance, and the one with the height of ``b`` turned to the other
side is an upper bound (Connor et al., 2017).  A centroid whose lower bound is above the smallest upper
bound cannot be nearest; the squared distances to the other centroids are compared as exact integers.

The vectors and their apexes are one written table.  A round is one pass over it: every task adds up
its vectors per cluster, Spark adds the tasks' sums, and the driver sees one row for each of the
``k`` clusters and components.  Nothing else reaches the driver but ``k`` vectors and the pivots.

Rows: a vector takes part if it has ``dims`` components, none null or not finite, and none of them beyond
2**27 once it is an integer (the squared distance would not fit a long).  Rows without id take part, but
never start a centroid.  Repeated rows count as often as they occur; equal vectors may start several
centroids, of which the first gets their vectors.  Fewer vectors than ``k`` start fewer centroids;
vectors without any id give no centroid and no rows, like an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import written

DIMS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = 3
PIVOTS = 12
PIVOT_SAMPLE = 64
#: a pivot's height over the pivots before it, as a share of its distance to the first, is at least this
MIN_HEIGHT = 0.2
LARGEST = 1 << 27
#: rounding of the bounds, as a share of the squared lengths that they are computed from
SLACK = 1e-6


@dataclass(frozen=True)
class Simplex:
    """Pivots as integer rows, and the coordinates of all but the first of them with the first at 0."""

    pivots: np.ndarray
    base: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Apex of each row of ``x``: coordinates in the span of the pivots, then the height."""
        to_pivots = np.stack([squared(x, p) for p in self.pivots], 1).astype(float)
        out = np.zeros((len(x), len(self.pivots)))
        for i, corner in enumerate(self.base):  # forward substitution
            dot = (to_pivots[:, 0] + corner @ corner - to_pivots[:, i + 1]) / 2
            out[:, i] = (dot - out[:, :i] @ corner[:i]) / corner[i]
        out[:, -1] = np.sqrt(np.maximum(to_pivots[:, 0] - (out[:, :-1] ** 2).sum(1), 0))
        return out


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distance of every row of ``x`` to ``y``."""
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def simplex(candidates: np.ndarray, most: int = PIVOTS) -> Simplex:
    """The first candidates that stand clear of the span of those before them."""
    found = Simplex(candidates[:1], np.zeros((0, 0)))
    for one in candidates[1:]:
        if len(found.pivots) == most:
            break
        apex = found.project(one[None])[0]
        if apex[-1] > MIN_HEIGHT * np.sqrt(float(squared(one[None], found.pivots[0])[0])):
            n = len(found.base)
            base = np.zeros((n + 1, n + 1))
            base[:n, :n], base[n] = found.base, apex
            found = Simplex(np.vstack([found.pivots, one]), base)
    return found


def candidates_of(apexes: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For every row, which centroids the bounds leave: always all that are nearest."""
    inner = ((apexes[:, None, :-1] - centroids[None, :, :-1]) ** 2).sum(2)
    heights, tops = apexes[:, None, -1], centroids[None, :, -1]
    slack = SLACK * ((apexes ** 2).sum(1)[:, None] + (centroids ** 2).sum(1)[None] + 1)
    lower, upper = inner + (heights - tops) ** 2 - slack, inner + (heights + tops) ** 2 + slack
    return lower <= upper.min(1, keepdims=True)


def assign(x: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, base: Simplex
           ) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row: the nearest centroid, the smaller number of equal ones."""
    near = candidates_of(apexes, base.project(centroids))
    best, cluster = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int32)
    for c in range(len(centroids)):
        rows = np.flatnonzero(near[:, c])
        d = squared(x[rows], centroids[c])
        nearer = d < best[rows]
        best[rows[nearer]], cluster[rows[nearer]] = d[nearer], c
    return cluster, best


def usable(vectors: DataFrame, column: str, key: str, dims: int) -> DataFrame:
    """``(id, v)`` of the vectors that take part, as integers."""
    v = F.col(column).cast("array<double>")
    rows = vectors.select(F.col(key).alias("id"), v.alias("_v")).where(F.size("_v") == dims)
    # a null makes the comparison null, so it counts as outside; NaN is above every number
    inside = F.forall("_v", lambda x: F.coalesce(F.abs(x * SCALE) <= LARGEST, F.lit(False)))
    return rows.where(inside).select("id", F.transform("_v", lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(table: DataFrame, centroids: np.ndarray, base: Simplex) -> dict[tuple[int, int], int]:
    """Exact sums per (cluster, component); component -1 counts the vectors."""
    k, dims, apex = len(centroids), centroids.shape[1], len(base.pivots)

    def add(batches):
        sums = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            cluster, _ = assign(x, _matrix(batch.column("apex"), apex), centroids, base)
            for c in np.unique(cluster):
                own = x[cluster == c]
                sums[c, 0] += len(own)
                sums[c, 1:] += own.sum(0)
        held = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(held, dims + 1), pa.int32()),
            "component": pa.array(np.tile(np.arange(-1, dims), len(held)), pa.int32()),
            "total": pa.array(sums[held].ravel(), pa.int64())})

    rows = (table.select("v", "apex").mapInArrow(add, "cluster int, component int, total long")
            .groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    return {(r.cluster, r.component): int(r.total) for r in rows.collect()}  # k * (dims + 1) rows


def moved(centroids: np.ndarray, sums: dict[tuple[int, int], int]) -> np.ndarray:
    """Every centroid at the floor of its vectors' mean; one without vectors stays."""
    out = centroids.copy()
    for c in range(len(out)):
        if n := sums.get((c, -1)):
            out[c] = [sums[c, i] // n for i in range(out.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED,
            pivots: int = PIVOTS, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part.

    Centroids start as the ``k`` vectors with the smallest hash of ``seed:id`` (equal ones by the vector).
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    empty = f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    rows = usable(vectors, column, key, dims)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    # at most this many rows
    first = rows.where("id IS NOT NULL").orderBy(order, "v").limit(max(k, PIVOT_SAMPLE)).select("v").collect()
    if not first:
        return spark.createDataFrame([], empty)
    some = np.array([r.v for r in first], np.int64)
    base, centroids = simplex(some, pivots), some[:k]

    @F.arrow_udf("array<double>")
    def apex(v: pa.Array) -> pa.Array:
        apexes = base.project(_matrix(v, dims))
        ends = np.arange(len(apexes) + 1, dtype=np.int32) * apexes.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(apexes.ravel()))

    table = written(rows.withColumn("apex", apex("v")), "apexes")
    for _ in range(rounds):
        new = moved(centroids, _sums(table, centroids, base))
        if (new == centroids).all():  # later rounds change nothing either
            break
        centroids = new

    def last(batches):
        for batch in batches:
            number, distance = assign(_matrix(batch.column("v"), dims), _matrix(batch.column("apex"), len(base.pivots)),
                                      centroids, base)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(number, pa.int32()),
                                              pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    out = written(table.mapInArrow(last, f"id {kind}, cluster int, distance long"), "clusters")
    inertia = {r.cluster: int(r.total) for r in out.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # k rows
    each = spark.createDataFrame([(c, inertia[c], sum(inertia.values()), ",".join(map(str, centroids[c].tolist())))
                                  for c in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, _c string")
    each = each.withColumn("centroid_sha256", F.sha2(F.col("_c").cast("binary"), 256)).drop("_c")
    # at most ``k`` rows
    return out.join(F.broadcast(each), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia",
                                                         "centroid_sha256")


def sql(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> str:
    """The same result by plain rounds over all centroids."""
    steps = [f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
  [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
 WHERE len(embedding) = {dims} AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
cells AS MATERIALIZED (SELECT r, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM kept),
c0 AS MATERIALIZED (SELECT c, generate_subscripts(v, 1) AS i, unnest(v) AS y FROM
 (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM kept
  WHERE vec_id IS NOT NULL QUALIFY c < {k}))"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT r, CAST(min(d * {k} + c) % {k} AS INTEGER) AS c, CAST(min(d) AS BIGINT) AS d FROM
 (SELECT r, c, CAST(sum((x - y) * (x - y)) AS BIGINT) AS d FROM cells JOIN c{n} USING (i) GROUP BY r, c) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce(m, y) AS y FROM c{n} LEFT JOIN
 (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM
  (SELECT c, i, sum(x) AS s, count(*) AS n FROM cells JOIN a{n} USING (r) GROUP BY c, i)) USING (c, i))""")
    return ",".join(steps) + f"""
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
 CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN
 (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)"""
