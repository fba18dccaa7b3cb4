"""Operator 13: centroid clustering of integer vectors with Orchard's search.

Every centroid has the list of its neighbours by distance.  A vector starts at one centroid and walks its list; a
closer centroid takes over with its own list, centroids met are marked and not measured again, and the walk ends
strictly beyond twice the current distance, where by the triangle inequality nothing closer, nor equally close, can
stand.  All arithmetic is on integers, so sums and ties are exact.  Vectors stay where Spark has them; a round
sends one row per task and cluster, and only the sums per cluster and component reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ship

#: Vectors that a task walks at a time.
SLICE_VECTORS = 2048
LONG_MAX = (1 << 63) - 1


def largest(dims: int) -> int:
    """Magnitude to which components are held, so that four times a squared distance fits 64 bits (2**26 at 64)."""
    return math.isqrt((1 << 58) // dims)


def whole_vectors(vectors: DataFrame, dims: int = 64, scale: int = 1024) -> DataFrame:
    """Rows (vec_id, x) of integer vectors floor(scale * component).

    Vectors that are null, have another length or a null or non-finite component are left out.  Components beyond
    ``largest(dims)`` are set to it.
    """
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    bound = float(largest(dims))
    whole = F.transform("x", lambda v: F.floor(F.greatest(F.least(v * float(scale), F.lit(bound)), F.lit(-bound))).cast("int"))
    return own.where(F.col("x").isNotNull() & (F.size("x") == dims)).where(finite).select("vec_id", whole.alias("x"))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Orchard:
    """Centroids with their sorted neighbour lists."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres, k = centres, len(centres)
        self.lists, self.gaps = np.empty((k, max(0, k - 1)), np.int64), np.empty((k, max(0, k - 1)), np.int64)
        for c in range(k):
            gap = squares(centres, centres[c])
            order = np.argsort(gap, kind="stable")
            order = order[order != c]
            self.lists[c], self.gaps[c] = order, gap[order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid of each vector (of equals the smaller number), its squared distance, distances measured."""
        n, k = len(x), len(self.centres)
        cur, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        dist = squares(x, self.centres[0])
        met = np.zeros((n, k), bool)
        met[:, 0] = True
        live, measured = np.arange(n if k > 1 else 0), n
        while len(live):
            c, p = cur[live], at[live]
            near = self.gaps[c, p] <= 4 * dist[live]
            live, to = live[near], self.lists[c, p][near]
            at[live] += 1
            new = ~met[live, to]
            i, to = live[new], to[new]
            d = squares(x[i], self.centres[to])
            measured += len(i)
            met[i, to] = True
            closer = (d < dist[i]) | ((d == dist[i]) & (to < cur[i]))
            i = i[closer]
            cur[i], dist[i], at[i] = to[closer], d[closer], 0
            live = live[at[live] < k - 1]
        return cur, dist, measured


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_VECTORS):
            part = batch.slice(at, SLICE_VECTORS)
            yield part, part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _sums(orchard: Orchard, dims: int):
    """A task's count and component sums per cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(orchard.centres)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in _slices(batches, dims):
            cur, _, _ = orchard.nearest(x)
            order = np.argsort(cur, kind="stable")
            own, first = np.unique(cur[order], return_index=True)
            sums[own] += np.add.reduceat(x[order], first, axis=0)
            counts += np.bincount(cur, minlength=k)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(counts[own]), pa.array(list(sums[own]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assign(orchard: Orchard, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _slices(batches, dims):
            cur, dist, _ = orchard.nearest(x)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(cur, pa.int32()), pa.array(dist)], names=["vec_id", "cluster", "distance"])

    return run


def first_centres(whole: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors of smallest sha256 of ``seed`` and vec_id, in that order; of equal ids the smaller vector first."""
    name = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = whole.select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def moved(whole: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor of the mean of their vectors, empty ones as they were."""
    dims = centres.shape[1]
    parts = whole.select("vec_id", "x").mapInArrow(_sums(Orchard(centres), dims), "cluster int, n long, sums array<long>")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("i", "s")).groupBy("cluster", "i")
    out = centres.copy()
    for r in each.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k * dims rows
        out[r["cluster"], r["i"]] = int(r["s"]) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """Lloyd's rounds over all vectors: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256).

    ``k`` is a parameter of the model: the centroids, their lists (k * k) and k * dims sums stand on the driver and
    in each task.  Vectors that ``whole_vectors`` leaves out give no row; a null id counts as an empty one in the
    choice of first centroids; repeated rows count as often as they stand there.  Fewer vectors than ``k`` make as
    many centroids as there are; no vectors give no rows.  Sums of distances beyond 64 bits are set to the largest long.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = cut(whole_vectors(vectors, dims, scale), "vectors")
    centres = first_centres(whole, k, seed)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centres):
        return whole.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    for _ in range(rounds):
        centres = moved(whole, centres)
    found = cut(whole.select("vec_id", "x").mapInArrow(_assign(Orchard(centres), dims), f"vec_id {id_type}, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(inertia.values()), LONG_MAX)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    of_cluster = spark.createDataFrame([(c, min(inertia.get(c, 0), LONG_MAX), total, digest[c]) for c in range(len(centres))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int, rounds: int, dims: int, scale: int, seed: str) -> str:
    """The same rounds as one statement, each a join of all components with all centroids."""

    def assigned(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
  SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
    SELECT v.n, k.c, CAST(sum((v.x - k.x) * (v.x - k.x)) AS BIGINT) AS d FROM v JOIN c{r} k USING (i) GROUP BY v.n, k.c
  ) GROUP BY n
)"""

    steps = [assigned(0)]
    for r in range(1, rounds + 1):
        steps.append(f"""c{r} AS MATERIALIZED (
  SELECT k.c, k.i, coalesce(m.x, k.x) AS x FROM c{r - 1} k
  LEFT JOIN (SELECT a.c, v.i, CAST(sum(v.x) // count(*) - CASE WHEN sum(v.x) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT) AS x FROM v JOIN a{r - 1} a USING (n) GROUP BY a.c, v.i) m USING (c, i)
)""")
        steps.append(assigned(r))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}' || vec_id), embedding) AS n, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
),
v AS MATERIALIZED (
  SELECT n, i, CAST(floor({scale} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {dims + 1}) t(i)
),
c0 AS MATERIALIZED (SELECT n - 1 AS c, i, x FROM v WHERE n <= {k}),
{', '.join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, s.centroid_sha256
FROM kept JOIN a{rounds} a USING (n)
JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) s ON s.c = a.c
"""


OP13_SQL = _sql(k=8, rounds=10, dims=64, scale=1024, seed="3:")
