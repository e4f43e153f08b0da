"""Nearest neighbours: equal vectors, repeated rows, bounded gathering."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from piiguard.llm import nearest


def brute(ids, v, k):
    out = {}
    for q in [i for i in ids if i % 20 == 0]:
        a = v[ids.index(q)].astype(float)
        scored = sorted((-float(sum(x * y for x, y in zip(a, b.astype(float)))), i) for i, b in zip(ids, v) if i != q)[:k]
        out.setdefault(q, []).append([i for _, i in scored])
    return out


def found(spark, rows, k=20):
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), F.col("vec_id") % 20 == 0, k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    return {q: [v for _, v in sorted(x)] for q, x in got.items()}


def test_one_very_common_vector(spark):
    v = np.ones((1500, 4), np.float32)
    v[::7] = np.random.default_rng(2).integers(-3, 4, (215, 4))
    v[(v == 0).all(1)] = 1
    ids = list(range(1500))
    got = found(spark, [(i, x.tolist(), "x") for i, x in zip(ids, v)])
    assert got == {q: lists[0] for q, lists in brute(ids, v, 20).items()}


@pytest.mark.parametrize("k", [1, 3])
def test_can_win_keeps_enough(k):
    rng = np.random.default_rng(5)
    for _ in range(200):
        c, ids = rng.integers(0, 2, (30, 1)).astype(np.float32), rng.integers(0, 6, 30)
        able = nearest.can_win(c, ids, k)
        for own in range(7):
            best = lambda rows: sorted((-c[i, 0], ids[i]) for i in rows if ids[i] != own)[:k]  # noqa: E731, B023
            assert best(able) == best(range(30))


def test_repeated_rows_and_empty_table(spark):
    rows = [(0, [1.0, 0.0], "x")] * 2 + [(1, [2.0, 0.0], "x")] * 3 + [(2, [1.0, 5.0], "x")]
    out = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"), F.col("vec_id") == 0, 2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out) == [(0, 1, 1, 2.0)] * 2 + [(0, 2, 1, 2.0)] * 2
    assert found(spark, [(0, None, "x")]) == {} and nearest.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") == 0).count() == 0


def test_pairs_are_gathered_in_slices(monkeypatch):
    monkeypatch.setattr(nearest, "GATHER_BYTES", 100)
    q, c = np.random.default_rng(1).normal(size=(2, 9, 4))
    row, col = np.repeat(np.arange(9), 9), np.tile(np.arange(9), 9)
    assert np.array_equal(nearest.pairs(q, c, row, col), nearest.exact(q[row], c[col]))


@pytest.mark.parametrize("k", [1, 4, 30])
def test_tiles_carry_the_best(monkeypatch, k):
    monkeypatch.setattr(nearest, "TILE_CANDIDATES", 7)
    rng = np.random.default_rng(k)
    q, c = rng.integers(-3, 4, (5, 3)).astype(float), rng.integers(-3, 4, (60, 3)).astype(float)
    q_id, c_id = np.arange(5), rng.permutation(60)
    held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for low in range(0, 60, 7):
        held = nearest._carry(q, q_id, c[low : low + 7], c_id[low : low + 7], held, k)
    want = [(i, v, s) for i in range(5) for s, v in sorted(((float(q[i] @ c[j]), -int(c_id[j])) for j in range(60) if c_id[j] != i), reverse=True)[:k] for v in [-v]]
    assert list(zip(*(x.tolist() for x in held), strict=True)) == want


def test_products_beyond_double_precision(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1.0]), (2, [1e200, -1e200]), (3, [1.0, 1.0]), (4, [-1e200, 1.0])]
    out = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 4).collect()
    inf = float("inf")
    assert [(r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"])] == [(1, inf), (3, 2e200), (2, -inf), (4, -inf)]


def test_copies_grow_with_the_root():
    side = lambda n: min(max(nearest.LEAST_SIDE, nearest.ROOTS * int(n**0.5)), nearest.SIDE_BYTES // (8 * 64))
    assert side(10**4) == nearest.LEAST_SIDE and side(10**7) == nearest.ROOTS * int(10**3.5) and side(10**12) == 131072
