"""The grid join against all pairs, suppression against the greedy fold."""

import random

import pytest
from pyarrow.fs import FileSelector

from piiguard import shared
from piiguard.operators import geometry as G


def made(seed, n, pages=3):
    rng = random.Random(seed)
    size = lambda: rng.choice([0.0, 1.0, 5.0, 30.0, 400.0, rng.random() * 60, -8.0])
    rows = [(rng.randrange(pages), i, rng.choice([rng.uniform(-200, 200), 16.0 * rng.randrange(-8, 8)]), rng.uniform(-100, 100), size(), size(), rng.randrange(11) / 10) for i in range(n)]
    return rows + [(0, n, None, 1.0, 5.0, 5.0, 0.5), (0, n + 1, float("nan"), 1.0, 5.0, 5.0, 0.5), (0, n + 2, 1.0, 1.0, 2000.0, 2000.0, 0.95)]


DDL = "page_id long, box_id long, x double, y double, w double, h double, score double"


def test_grid_join_equals_all_pairs(spark):
    rows = made(1, 150)
    table = spark.createDataFrame(rows, DDL).repartition(4)
    side = lambda p: table.selectExpr("page_id", f"box_id AS {p}_id", *[f"{c} AS {p}{c}" for c in "xywh"])
    got = sorted((r["page_id"], r["a_id"], r["b_id"]) for r in G.overlapping(side("a"), side("b")).collect())
    ok = lambda v: v is not None and v == v
    want = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and ok(a[2]) and ok(b[2]) and a[2] < b[2] + b[4] and b[2] < a[2] + a[4] and a[3] < b[3] + b[5] and b[3] < a[3] + a[5])
    assert set(got) - set(want) == set() and set(want) - set(got) == set()
    assert got == want and len(want) > 400


def greedy(rows, most, limit):
    kept = []
    for r in sorted(set(rows), key=lambda r: (-r[6], r[1], *r[2:6])):
        _, _, x, y, w, h, _ = r

        def over(k, x=x, y=y, w=w, h=h):
            iw, ih = max(0.0, min(x + w, k[2] + k[4]) - max(x, k[2])), max(0.0, min(y + h, k[3] + k[5]) - max(y, k[3]))
            return iw * ih > 0 and iw * ih / (w * h + k[4] * k[5] - iw * ih) > limit

        if not any(over(k) for k in kept):
            kept.append(r)
            if most and len(kept) >= most:
                break
    return kept


@pytest.mark.parametrize(("most", "seed"), [(10, 1), (None, 2)])
def test_rounds_equal_the_greedy_fold(spark, most, seed):
    rng = random.Random(seed)
    rows = [(p, rng.randrange(60), float(rng.randrange(300)), float(rng.randrange(60)), 20.0 + rng.randrange(30), 15.0 + rng.randrange(20), rng.randrange(4) / 4) for p in range(3) for _ in range(120)]
    rows += rows[:5]
    got = sorted(tuple(r) for r in G.suppress(spark.createDataFrame(rows, DDL).repartition(4), most).collect())
    assert got == sorted(k for p in range(3) for k in greedy([r for r in rows if r[0] == p], most, 0.3))


def test_no_boxes(spark):
    assert G.suppress(spark.createDataFrame([], DDL)).count() == 0


def test_suppression_keeps_narrow_threats_and_no_past_rounds(spark):
    """threats held both boxes whole, and those of all rounds stayed on disk."""
    rows = [r for r in made(3, 200, 1) if r[2] is not None]
    before = set(_tables(spark))
    kept = G.suppress(spark.createDataFrame(rows, DDL), None)
    after = {t: n for t, n in _tables(spark).items() if t not in before}
    assert sorted(after.values()).count("threats") == 0 and "lost" in after.values()
    assert "_id" not in kept.columns and kept.count() < len(rows)
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString()


def _tables(spark):
    files, path = shared.open_folder(shared._run_dir(spark))
    found = files.get_file_info(FileSelector(path, recursive=True, allow_not_found=True))
    return {f.path: f.base_name for f in found if f.base_name in ("threats", "lost", "boxes")}


def test_boxes_of_far_levels_do_not_threaten(spark):
    """Levels that are further apart than the limit allows are left out of the join; the fold knows no levels."""
    rng = random.Random(5)
    size = lambda: 2.0 ** rng.uniform(-3, 8)
    rows = [(0, i, rng.uniform(0, 120), rng.uniform(0, 120), w := size(), w * rng.uniform(0.3, 3), rng.randrange(20) / 20) for i in range(400)]
    got = sorted(tuple(r) for r in G.suppress(spark.createDataFrame(rows, DDL), None, 0.1).collect())
    assert got == sorted(greedy(rows, None, 0.1)) and len(got) < 350
