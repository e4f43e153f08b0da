"""Nearest neighbours of a stated query set: a block matrix join over int8 tiles.

Queries and candidates are dealt to the rows and columns of a grid whose sides hold about as many vectors
as the root of the input, up to ``SIDE_BYTES``: a row is copied to as many cells as the other side has,
so copies grow with the root until a side is full. A cell multiplies its vectors as int8 tiles and carries
the k best scores of each query from tile to tile. Each product has an error bound from the rounding of
both vectors, so a pair whose upper bound is below the k-th largest lower bound of its query in the tile,
or below its k-th best score so far, can't be among the k nearest. The surviving pairs are computed again
in double precision, component after component, and the k best of each cell are merged by one heap a
query. The result is exact: nothing is capped.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components take no
part; vectors of different lengths are not compared; a query's own row is any row with its vec_id;
repeated query rows each get their list, and repeated candidate rows are candidates each; equal scores
rank by smaller vec_id; a product beyond the range of double precision is infinite and ranks as that,
and one that is no number (infinities that cancel) as the least; rows without vec_id take no part; an empty table gives an empty table; extra
columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

K = 20
#: Vectors of a side of a cell: a multiple of the input's root, from ``LEAST_SIDE`` up to ``SIDE_BYTES`` in doubles; and
#: the least number of candidate columns.
ROOTS, LEAST_SIDE, SIDE_BYTES = 16, 4096, 64 << 20
LEAST_COLUMNS = 24
#: Queries and candidates of a tile, and bytes of vectors that are gathered at once to compute surviving pairs again.
TILE_QUERIES, TILE_CANDIDATES = 256, 8192
GATHER_BYTES = 32 << 20
#: Largest length at which int8 products add up exactly in single precision.
SINGLE_DIMS = (1 << 24) // (127 * 127)


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return values.to_numpy(zero_copy_only=False).reshape(-1, dim)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes and scales; each component is its code times the scale within half a scale."""
    scale = np.abs(v).max(1).astype(np.float64) / 127.0
    scale[scale == 0] = np.finfo(np.float64).tiny
    return np.rint(v / scale[:, None]).clip(-127, 127).astype(np.int8), scale


def tile(queries: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of int8 codes, rescaled, and bounds of their errors."""
    (a, sa), (b, sb) = quantise(queries), quantise(candidates)
    kind = np.float32 if a.shape[1] <= SINGLE_DIMS else np.float64  # integers are exact in either
    near = (a.astype(kind) @ b.astype(kind).T).astype(np.float64) * sa[:, None] * sb[None, :]
    one_b = np.abs(candidates.astype(np.float64)).sum(1)
    one_a = np.abs(a.astype(np.int64)).sum(1) * sa
    bound = 0.5 * sa[:, None] * one_b[None, :] + 0.5 * sb[None, :] * one_a[:, None]
    return near, bound * (1 + 1e-6) + 1e-12 * np.abs(near) + np.finfo(np.float64).tiny


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, added in order of components."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j].astype(np.float64) * b[:, j].astype(np.float64)
    return total


def pairs(q: np.ndarray, c: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Exact products of rows of ``q`` and ``c``, in slices of bounded size."""
    step = max(1, GATHER_BYTES // (8 * max(q.shape[1], 1)))
    return np.concatenate([np.zeros(0), *(exact(q[row[i : i + step]], c[col[i : i + step]]) for i in range(0, len(row), step))])


def can_win(c: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of candidates that can be among some query's ``k`` nearest, by vector and id alone.

    Equal vectors have equal products and rank by id. Of one vector and id ``k`` rows are enough, and
    of one vector the first 2 ``k`` rows, as a query's own id takes at most ``k`` of them away.
    """
    kinds = np.unique(np.ascontiguousarray(c).view(np.dtype((np.void, c.dtype.itemsize * c.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, kinds))
    at = np.arange(len(order))

    def rank(starts: np.ndarray) -> np.ndarray:
        return at[: len(starts)] - np.maximum.accumulate(np.where(starts, at[: len(starts)], 0))

    first = np.diff(kinds[order], prepend=-1) != 0
    order = order[rank(first | (np.diff(ids[order], prepend=ids[order[:1]]) != 0)) < k]
    return np.sort(order[rank(np.diff(kinds[order], prepend=-1) != 0) < 2 * k])


def _carry(q: np.ndarray, q_id: np.ndarray, c: np.ndarray, c_id: np.ndarray, held: tuple, k: int) -> tuple:
    """Query row, vec_id and score of the ``k`` best of ``held`` (the like, of earlier tiles) and this tile, by row and rank."""
    with np.errstate(over="ignore", invalid="ignore"):
        near, bound = tile(q, c)
        low, high = near - bound, near + bound
        low[~np.isfinite(low)], high[~np.isfinite(high)] = -np.inf, np.inf  # beyond double precision: no bound
    own = q_id[:, None] == c_id[None, :]
    low[own] = -np.inf
    least = np.partition(low, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(q), -np.inf)
    full = np.flatnonzero(np.bincount(held[0], minlength=len(q)) == k)
    least[full] = np.maximum(least[full], held[2][np.searchsorted(held[0], full, side="right") - 1])
    row, col = np.nonzero(~own & (high >= least[:, None]))
    with np.errstate(over="ignore", invalid="ignore"):
        score = pairs(q, c, row, col)
    score[np.isnan(score)] = -np.inf
    row, ids, score = (np.concatenate(x) for x in zip(held, (row, c_id[col], score), strict=True))
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    first = np.searchsorted(row, row)
    best = np.arange(len(row)) - first < k
    return row[best], ids[best], score[best]


def _cell(k: int):
    schema = pa.schema([("_q", pa.int64()), ("query_id", pa.int64()), ("vec_ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return schema.empty_table()
        dim = queries["_dim"][0].as_py()
        q, c = _matrix(queries["_v"], dim), _matrix(candidates["_v"], dim)
        q_key, q_id, c_id = (t[n].to_numpy() for t, n in ((queries, "_q"), (queries, "vec_id"), (candidates, "vec_id")))
        able = can_win(c, c_id, k)
        c, c_id = c[able], c_id[able]
        keys, ids, lists, scores = [], [], [], []
        for at in range(0, len(q), TILE_QUERIES):
            part = slice(at, at + TILE_QUERIES)
            n = len(q[part])
            held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for low in range(0, len(c), TILE_CANDIDATES):
                held = _carry(q[part], q_id[part], c[low : low + TILE_CANDIDATES], c_id[low : low + TILE_CANDIDATES], held, k)
            edges = np.searchsorted(held[0], np.arange(n + 1))
            for i in range(n):
                keys.append(q_key[at + i])
                ids.append(q_id[at + i])
                lists.append(held[1][edges[i] : edges[i + 1]])
                scores.append(held[2][edges[i] : edges[i + 1]])
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((keys, ids, lists, scores), schema, strict=True)], schema=schema)

    return run


def _merge(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for batch in batches:
            for key, query, ids, scores in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                heap = heaps.setdefault((key, query), [])
                for v, s in zip(ids, scores, strict=True):
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -v))
                    elif (s, -v) > heap[0]:
                        heapq.heapreplace(heap, (s, -v))
        rows = [(query, rank, -v, s) for (_, query), heap in heaps.items() for rank, (s, v) in enumerate(sorted(heap, reverse=True), 1)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each query row."""
    spark = vectors.sparkSession
    v = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("_v"), is_query.alias("_is")).where(F.col("vec_id").isNotNull() & usable(F.col("_v")))
    rows = rows.withColumn("_dim", F.size("_v"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("_is").alias("q"), F.coalesce(F.max("_dim"), F.lit(1)).alias("dim")).first()
    side = min(max(LEAST_SIDE, ROOTS * math.isqrt(sizes["n"])), max(1, SIDE_BYTES // (8 * sizes["dim"])))
    down, across = max(1, -(-sizes["q"] // side)), max(LEAST_COLUMNS, -(-sizes["n"] // side))
    queries = rows.where("_is").select("vec_id", "_v", "_dim", F.monotonically_increasing_id().alias("_q"))
    queries = queries.withColumn("_down", F.pmod(F.xxhash64("_q"), F.lit(down))).withColumn("_across", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(across))
    candidates = rows.select("vec_id", "_v", "_dim", place.alias("_across")).withColumn("_down", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))
    key = ["_dim", "_down", "_across"]
    cells = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(_cell(k), "_q long, query_id long, vec_ids array<long>, scores array<double>")
    dealt = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_q")
    return dealt.mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")


# ----------------------------------------------------------------------------------------------
def op7_nearest(spark, sf_dir):
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

QUERIES = {"op7_nearest": op7_nearest}
ORACLES = {"op7_nearest": _SQL}
