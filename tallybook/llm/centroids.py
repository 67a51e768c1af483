"""Centroid clustering in whole numbers, with n-simplex projection as the filter.

Some of the starting centroids are pivots. The distances of a vector to them are measured once and kept as the apex of a simplex on the pivots:
as many coordinates as pivots. The distance of two apexes is at most the distance of their vectors, and the distance to the apex mirrored at the base is
at least that. In each round, whatever centroid lies farther by the first bound than another one by the second is out; the
others are compared exactly, in whole numbers.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.session import stored

DIMS = 64
SCALE = 256
K = 40
ROUNDS = 5
PIVOTS = 16
SALT = "2:"
LIMIT = 1 << 26         # of a whole component: squared distances of 64 of them stay below 2**62
_ROUGH = 1e3            # condition of the base; the apexes are then right to about 1e-10 of the distances
_SLACK = 1e-6           # of the squared distances, added to both bounds
_POINT = "vec_id long, v array<bigint>, apex array<double>"


class Simplex:
    """Base of the projection: as many of the given points as stand well apart from what the ones before span."""

    def __init__(self, points: np.ndarray, most: int = PIVOTS):
        chosen, rest = [0], list(range(1, len(points)))
        base = (points - points[0]).astype(np.float64)
        left = base.copy()                                       # what the chosen ones do not span
        while rest and len(chosen) < most:
            height = (left[rest] ** 2).sum(1)
            i = rest[int(height.argmax())]
            if height.max() < 0.5 or np.linalg.cond(base[[*chosen[1:], i]]) > _ROUGH:
                break
            chosen.append(i)
            rest.remove(i)
            axis = left[i] / np.linalg.norm(left[i])
            left -= np.outer(left @ axis, axis)
        self.pivots = points[chosen]
        edges = self.pivots[1:] - self.pivots[0]
        self.lengths = (edges * edges).sum(1)
        self.inverse = np.linalg.inv(np.linalg.cholesky((edges @ edges.T).astype(np.float64))) if len(edges) else np.zeros((0, 0))

    def apexes(self, v: np.ndarray) -> np.ndarray:
        """Coordinates in the base, and the height above it, from the distances to the pivots."""
        d = np.stack([squared(v, p) for p in self.pivots], 1)
        inside = ((d[:, :1] - d[:, 1:] + self.lengths[None]) / 2.0) @ self.inverse.T
        height = np.sqrt(np.maximum(0.0, d[:, 0] - (inside * inside).sum(1)))
        return np.column_stack((inside, height))


def squared(v: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole vectors."""
    apart = v - point
    return np.einsum("ij,ij->i", apart, apart)


def bounds(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance of each vector to each centroid, from their apexes."""
    x2, c2 = (x * x).sum(1)[:, None], (c * c).sum(1)[None]
    flat = x2 + c2 - 2 * x[:, :-1] @ c[:, :-1].T
    twice = 2 * x[:, -1:] * c[:, -1][None]
    slack = _SLACK * (x2 + c2 + 1)
    return flat - twice - slack, flat + twice + slack


def nearest(v: np.ndarray, apex: np.ndarray, centroids: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector: the number of its nearest centroid (the smaller one of equals), the squared distance, how many were compared exactly."""
    low, high = bounds(apex, corners)
    who = low.argmin(1).astype(np.int32)                         # likely the nearest: its true distance is a bound, too
    best = squared(v, centroids[who])
    open_ = low <= np.minimum(high.min(1), best * (1 + _SLACK))[:, None]
    open_[np.arange(len(v)), who] = False
    for j, centroid in enumerate(centroids):
        rows = np.flatnonzero(open_[:, j])
        d = squared(v[rows], centroid)
        closer = (d < best[rows]) | (d == best[rows]) & (j < who[rows])
        best[rows[closer]], who[rows[closer]] = d[closer], j
    return who, best, open_.sum(1).astype(np.int32) + 1


def _matrix(batch: pa.RecordBatch, name: str, kind) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(batch.num_rows, -1)


def whole(rows: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the vectors that take part, in whole numbers."""
    fine: Column = (F.size("embedding") == dims) & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < LIMIT / scale, F.lit(False)) & ~F.isnan(x))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v"))


class Clusters:
    """Rounds of assignment and exact means. ``assigned()``: vec_id, cluster, distance, n_compared; ``centroids``: k whole vectors on the driver."""

    def __init__(self, rows: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, pivots: int = PIVOTS, salt: str = SALT):
        points = whole(rows, dims, scale)
        name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
        starts = points.withColumn("name", name).orderBy(F.col("name").asc_nulls_last(), "v").limit(k).collect()        # k vectors
        self.centroids = np.array([r["v"] for r in starts], np.int64).reshape(-1, dims)
        self.simplex = Simplex(self.centroids, pivots) if starts else None
        self.points = stored(points.mapInArrow(self._projected(), _POINT)) if starts else None
        for _ in range(rounds if starts else 0):
            self._step(dims)

    def _projected(self):
        simplex = self.simplex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    apex = simplex.apexes(_matrix(b, "v", np.int64))
                    ends = np.arange(0, apex.size + 1, apex.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.ListArray.from_arrays(pa.array(ends), pa.array(apex.reshape(-1)))], ["vec_id", "v", "apex"])
        return run

    def _step(self, dims: int) -> None:
        """The centroids become the means of their vectors: sums of each task, then of each cluster; k rows reach the driver."""
        centroids, corners = self.centroids, self.simplex.apexes(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
            for b in batches:
                if b.num_rows:
                    v = _matrix(b, "v", np.int64)
                    who, _, _ = nearest(v, _matrix(b, "apex", np.float64), centroids, corners)
                    order = np.argsort(who, kind="stable")
                    found, first = np.unique(who[order], return_index=True)
                    sums[found] += np.add.reduceat(v[order], first, axis=0)
                    n += np.bincount(who, minlength=len(n))
            at = np.flatnonzero(n)
            ends = np.arange(0, len(at) * sums.shape[1] + 1, sums.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.ListArray.from_arrays(pa.array(ends), pa.array(sums[at].reshape(-1)))], ["cluster", "n", "sums"])
        parts = self.points.mapInArrow(run, "cluster long, n long, sums array<bigint>").groupBy("cluster")
        found = parts.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums")).collect()
        moved = self.centroids.copy()
        for r in found:
            moved[r["cluster"]] = [s // r["n"] for s in r["sums"]]
        self.centroids = moved

    def assigned(self) -> DataFrame:
        centroids, corners = self.centroids, self.simplex.apexes(self.centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    found = nearest(_matrix(b, "v", np.int64), _matrix(b, "apex", np.float64), centroids, corners)
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), *map(pa.array, found)], ["vec_id", "cluster", "distance", "n_compared"])
        return self.points.mapInArrow(run, "vec_id long, cluster int, distance long, n_compared int")


def clustered(rows: DataFrame, **settings) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_compared): one row for each row of (vec_id, embedding) that takes part.

    That is a vector of ``dims`` components, none null or non-finite (nor beyond 2**26 in whole numbers, where squares leave 64 bits). Repeated rows and
    equal vectors count one by one; among the starts equal names go by their components. A vector without vec_id is a start only if the others
    do not suffice. Fewer vectors than ``k``: as many centroids. Of equally near centroids the smaller number wins, an empty one stays where it is.
    A sum of distances beyond 64 bits is null. Other columns are dropped. Empty in, empty out.
    """
    spark = rows.sparkSession
    made = Clusters(rows, **settings)
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_compared int"
    if made.points is None:
        return spark.createDataFrame([], out)
    found = stored(made.assigned())
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}    # k rows
    fits = lambda n: n if n < 1 << 63 else None                  # noqa: E731
    told = [(j, fits(sums.get(j, 0)), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(made.centroids)]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")       # k rows
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_compared")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("n_compared")


def _sql() -> str:
    steps = ["""points AS (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             "cells AS (SELECT row, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM points)",
             """c0 AS (SELECT cluster, unnest(v) AS y, generate_subscripts(v, 1) AS dim FROM
  (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR) NULLS LAST, v) - 1 AS cluster FROM points) WHERE cluster < 40)"""]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS (SELECT row, min({{'d': d, 'c': cluster}}) AS near FROM
  (SELECT row, cluster, sum((x - y) * (x - y))::BIGINT AS d FROM cells JOIN c{i} USING (dim) GROUP BY row, cluster) GROUP BY row)""")
        steps.append(f"""m{i} AS (SELECT near.c AS cluster, dim, sum(x)::BIGINT AS s, count(*) AS n FROM cells JOIN a{i} USING (row) GROUP BY 1, 2)""")
        steps.append(f"""c{i + 1} AS (SELECT cluster, dim, coalesce((s - ((s % n) + n) % n) // n, y) AS y FROM c{i} LEFT JOIN m{i} USING (cluster, dim))""")
    last = f"a{ROUNDS}"
    return "WITH " + ",\n".join(steps[:-2]) + f""",
h AS (SELECT cluster, sha256(string_agg(y::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY cluster)
SELECT vec_id, near.c::INTEGER AS cluster, near.d AS distance, sum(near.d) OVER (PARTITION BY near.c)::BIGINT AS cluster_inertia,
  sum(near.d) OVER ()::BIGINT AS inertia, centroid_sha256 FROM {last} JOIN points USING (row) JOIN h ON h.cluster = near.c"""


OP11_SQL = _sql()
