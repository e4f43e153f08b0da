"""Centroid clustering (Lloyd's rounds) in exact fixed-point arithmetic, assigned by annulus search.

Vectors become integers floor(``SCALE`` * x). A round broadcasts the centroids, which are ``k`` rows whatever the
input: each task sorts them by norm, takes the nearer of the two centroids whose norms are next to a vector's
as an upper bound, binary-searches the centroids whose norms lie within that bound of the vector's norm (all
others are farther by the triangle inequality) and compares those exactly, boundary ties included. Tasks add
up counts and component sums by cluster, so a shuffle carries at most ``k`` rows a task, and a cluster that holds
most vectors is no hot key. Of the vectors, nothing but the seeds and these sums reaches the driver.

Defined cases: vectors that are null, of another length than ``dims``, or hold null or non-finite components take
no part; components beyond +-``LIMIT`` / ``SCALE`` (2^19) count as that limit, so that squared distances fit in
64 bits; repeated rows are vectors each; rows without vec_id take part, as seeds only after all others; seeds of
equal ids are ordered by their components; fewer vectors than ``k`` give that many clusters; equal distances go to
the smaller cluster number; a sum of distances beyond 64 bits is null; an empty table gives an empty table;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from piiguard.llm.common import materialize

CLUSTERS = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
#: Largest absolute component after scaling.
LIMIT = 1 << 27
#: Up to this component all sums of products are integers that double precision holds exactly (up to 64 dimensions).
DOUBLE_LIMIT = 1 << 22
#: Vectors that are compared at once.
SLICE_ROWS = 8192


def fixed_point(v: Column) -> Column:
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    return F.transform(scaled, lambda x: F.greatest(F.least(x, F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"))


def usable(v: Column, dims: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) == dims) & F.coalesce(finite, F.lit(False))


class Annulus:
    """Centroids sorted by norm, for exact nearest-centroid search."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids.astype(np.int64) ** 2).sum(1)
        self.number = np.lexsort((np.arange(len(centroids)), squares))
        self.rows, self.squares = centroids[self.number].astype(np.int64), squares[self.number]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.top = int(np.abs(self.rows).max(initial=0))

    def _distances(self, x: np.ndarray, squares: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        """Squared distances of rows of ``x`` to one centroid, or each to its own."""
        if x.dtype == np.float64:
            c = self.rows[at].astype(np.float64)
            inner = x @ c if isinstance(at, int) else np.einsum("ij,ij->i", x, c)
            return squares + self.squares[at] - 2 * inner.astype(np.int64)
        return ((x - self.rows[at]) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of and squared distance to the nearest centroid of each row, and how many were compared."""
        x = x.astype(np.int64)
        squares = (x**2).sum(1)
        if max(self.top, int(np.abs(x).max(initial=0))) <= DOUBLE_LIMIT and x.shape[1] <= DIMS:
            x = x.astype(np.float64)
        norms = np.sqrt(squares.astype(np.float64))
        right = np.searchsorted(self.norms, norms).clip(0, len(self.norms) - 1)
        left = np.maximum(right - 1, 0)
        bound = np.sqrt(np.minimum(self._distances(x, squares, left), self._distances(x, squares, right)).astype(np.float64))
        slack = 1e-9 * (norms + bound) + 1e-6  # rounding of the roots must not lose a tie on the boundary
        low = np.searchsorted(self.norms, norms - bound - slack, side="left")
        high = np.searchsorted(self.norms, norms + bound + slack, side="right")
        best, number = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.number))
        for at in range(int(low.min(initial=len(self.number))), int(high.max(initial=0))):
            rows = np.flatnonzero((low <= at) & (at < high))
            found, own = self._distances(x[rows], squares[rows], at), int(self.number[at])
            better = (found < best[rows]) | ((found == best[rows]) & (own < number[rows]))
            best[rows[better]], number[rows[better]] = found[better], own
        return number, best, int((high - low).sum())


def _slices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def move(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round over ``vectors`` (vec_id, q): floors of the means; those without vectors stay."""
    k, dims = centroids.shape
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # k rows, whatever the input
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, n, sums = Annulus(shared.value), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, x in _slices(batches, dims):
            number = search.nearest(x)[0]
            order = np.argsort(number, kind="stable")
            edges = np.flatnonzero(np.diff(number[order], prepend=-1))
            if len(edges):
                own = number[order][edges]
                n[own] += np.diff(np.append(edges, len(order)))
                sums[own] += np.add.reduceat(x[order].astype(np.int64), edges, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), schema[2].type)], schema=schema)

    parts = vectors.mapInArrow(run, "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums"))
    moved = centroids.copy()
    for r in totals.collect():  # k rows at most
        moved[r["cluster"]] = np.array(r["sums"], np.int64) // r["n"]
    shared.destroy()
    return moved


def seeds(vectors: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the least hashes of their ids, in that order."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "q").limit(k).select("q").collect()
    return np.array([r["q"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and squared distance of each usable row of ``vectors`` (vec_id, embedding), and the centroids."""
    rows = vectors.where(usable(F.col("embedding"), dims)).select(F.col("vec_id").cast("long").alias("vec_id"), fixed_point(F.col("embedding")).alias("q"))
    rows = materialize(rows, "vectors")
    centroids = seeds(rows, k)
    if not len(centroids):
        return rows.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = move(rows, centroids)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Annulus(shared.value)
        for ids, x in _slices(batches, dims):
            number, distance, _ = search.nearest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array(distance)], schema=schema)

    return materialize(rows.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters"), centroids


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with the sums of distances of each row's cluster and of all, and the digest of its centroid."""
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # k rows at most
    total = sum(sums.values()) if None not in sums.values() else None
    total = total if total is not None and total < 1 << 63 else None
    rows = [(i, sums[i], total, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids) if i in sums]
    facts = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


# ----------------------------------------------------------------------------------------------
def op13_centroids(spark, sf_dir):
    return report(*cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _sql() -> str:
    """All rounds as common table expressions; the products of these integers are exact in doubles."""
    nearest = """
a{r} AS MATERIALIZED (
  SELECT v.r, arg_min(c.cluster, (d, c.cluster)) AS cluster, min(d) AS d FROM (
    SELECT v.r, c.cluster, list_inner_product(v.q, v.q) + list_inner_product(c.q, c.q) - 2 * list_inner_product(v.q, c.q) AS d
    FROM v, c{r} c) AS p JOIN v USING (r) JOIN c{r} c USING (cluster) GROUP BY v.r)"""
    move = """
s{r} AS (SELECT a.cluster, i, sum(v.q[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{r} a JOIN v USING (r), range(1, 65) AS t(i) GROUP BY a.cluster, i),
m{r} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS q FROM s{r} GROUP BY cluster),
c{n} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (cluster))"""
    parts = [
        """
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q, sha256('2:' || vec_id) AS h
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, q) - 1)::INTEGER AS cluster, q FROM (SELECT * FROM v ORDER BY h, q LIMIT 40))"""
    ]
    for r in range(ROUNDS):
        parts += [nearest.format(r=r), move.format(r=r, n=r + 1)]
    parts.append(nearest.format(r=ROUNDS))
    return (
        "WITH " + ",".join(parts) + f"""
SELECT v.vec_id, a.cluster::INTEGER AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.q, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} c USING (cluster)"""
    )


QUERIES = {"op13_centroids": op13_centroids}
ORACLES = {"op13_centroids": _sql()}
