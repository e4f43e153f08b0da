"""The hash tree: weights, growth, changed weights, edge cases."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from piiguard.llm import sharding
from piiguard.llm.sharding import Leaf


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(20000).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text").cache()


def places(ids, leaves):
    half = lambda at: F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), at, 7), 16, 10).cast("long")
    rows = sharding.descend(ids.select("doc_id", half(1).alias("_x"), half(8).alias("_y")), leaves, "s").select("doc_id", "s").collect()
    return {r["doc_id"]: r["s"] for r in rows}


def shares(found):
    return {s: sum(v == s for v in found.values()) / len(found) for s in set(found.values())}


def test_shards_get_their_weights(ids):
    leaves = tuple(replace(leaf, weight=1.0 + leaf.shard % 3) for leaf in sharding.tree(12, 12, 2, 2))
    total = sum(leaf.weight for leaf in leaves)
    got = shares(places(ids, leaves))
    assert all(abs(got[leaf.shard] - leaf.weight / total) < 0.02 for leaf in leaves)


def test_growth_takes_rows_only_into_new_weight(ids):
    leaves = sharding.tree(8, 8, 2, 2)
    before = places(ids, leaves)
    new_shard = places(ids, leaves + (Leaf(2, 4, 8, 1.0, 1),))
    assert {new_shard[i] for i in before if before[i] != new_shard[i]} == {8} and abs(shares(new_shard)[8] - 1 / 9) < 0.02
    heavier = places(ids, leaves + (Leaf(0, 1, 3, 2.0, 1),))
    assert {heavier[i] for i in before if before[i] != heavier[i]} == {3} and abs(shares(heavier)[3] - 3 / 10) < 0.02


def test_less_weight_moves_rows_only_out_of_its_subtrees(ids):
    leaves = sharding.tree(12, 12, 2, 2)
    lighter = tuple(replace(leaf, weight=0.25) if leaf.shard == 5 else leaf for leaf in leaves)
    where = {leaf.shard: (leaf.region, leaf.rack, leaf.shard) for leaf in leaves}
    before, after = places(ids, leaves), places(ids, lighter)
    own = where[5]
    moved = [(where[before[i]], where[after[i]]) for i in before if before[i] != after[i]]
    assert moved
    for a, b in moved:  # at the first level where the ways part, the old way was the lighter subtree
        level = next(k for k in range(3) if a[k] != b[k])
        assert a[: level + 1] == own[: level + 1] and b[level] != own[level]


def test_draws_are_the_sum_of_fan_outs():
    levels = sharding._levels(sharding.tree(41))
    assert [len(options) for options in levels[0]] == [3] and {len(o) for o in levels[1]} == {5, 1} and {len(o) for o in levels[2]} == {4, 1}


def test_grown_trees_must_extend(spark):
    with pytest.raises(ValueError, match="extend"):
        sharding.assign(spark.createDataFrame([], "doc_id long, text string"), sharding.tree(4), sharding.tree(5)[1:])


def test_null_ids_repeated_rows_and_clashing_columns(spark):
    rows = [(None, "a", 1, 2), (None, "a", 1, 2), (7, "b", 1, 2), (7, "b", 1, 2), (7, None, 1, 2), (8, "x" * 300_000, 1, 2)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, shard int, _x int")).collect()
    assert len(got) == 6 and len({r["shard"] for r in got if r["doc_id"] == 7}) == 1 and len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
