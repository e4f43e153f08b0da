"""Centroid clustering against rounds that compare every vector with every centroid."""

import hashlib
import math

import numpy as np
import pytest

from piiguard.llm import centroids

ALL = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256".split(", ")


def brute(rows, k, rounds, dims):
    kept = [(i, [max(-centroids.LIMIT, min(centroids.LIMIT, math.floor(256 * float(x)))) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    means = [q for _, q in order[:k]]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(means))

    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for j in range(len(means)):
            mine = [q for (_, q), o in zip(kept, own, strict=True) if o == j]
            if mine:
                means[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [near(q) for _, q in kept]
    sums = {j: sum(d for d, o in last if o == j) for _, j in last}
    return sorted((str(i), j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, means[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True))


def got(spark, rows, k, rounds, dims, parts=3):
    table = spark.createDataFrame([(i, e, 7) for i, e in rows], "vec_id long, embedding array<double>, cluster int").repartition(parts)
    out = centroids.report(*centroids.cluster(table, k, rounds, dims))
    assert out.columns == ALL
    return sorted((str(r["vec_id"]), *r[1:]) for r in out.collect())


def test_rounds_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1 + i % 3, 6).round(2).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)]  # a third of the rows alike
    rows += [(5, rows[5][1]), (5, rows[5][1]), (6, [1.0] * 6), (None, [0.25] * 6), (None, [0.0] * 6)]
    rows += [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0, None] * 3), (504, [float("nan")] * 6), (505, [float("inf")] * 6), (506, [-1e30, 1e30, 0.0, 0.0, 0.0, 0.0])]
    for k, rounds in ((8, 3), (1, 2), (40, 5)):
        assert got(spark, rows, k, rounds, 6) == brute(rows, k, rounds, 6)


def test_few_none_and_ties(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, -1.0])]
    assert got(spark, rows, 9, 2, 2) == brute(rows, 9, 2, 2)
    assert got(spark, rows * 4, 3, 0, 2) == brute(rows * 4, 3, 0, 2)
    assert got(spark, [(1, None)], 3, 2, 2) == []


@pytest.mark.parametrize("top", [40, 1 << 24])
def test_annulus_keeps_boundary_ties(top):
    rng = np.random.default_rng(top)
    c, x = rng.integers(-top, top + 1, (30, 3)), rng.integers(-top, top + 1, (500, 3))
    c[7], c[20], x[:30] = -c[3], c[3], c
    d = ((x[:, None, :] - c[None]) ** 2).sum(2)
    number, distance, compared = centroids.Annulus(c).nearest(x)
    assert (number == d.argmin(1)).all() and (distance == d.min(1)).all() and compared < d.size


def test_annulus_skips_far_norms():
    rng = np.random.default_rng(1)
    c = np.arange(1, 41)[:, None] * np.array([[300, 0, 0, 0]])
    x = c[rng.integers(0, 40, 1000)] + rng.integers(-20, 21, (1000, 4))
    assert centroids.Annulus(c).nearest(x)[2] < 1000 * 4
