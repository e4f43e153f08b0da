"""Plans: each pattern is searched once, each action parsed once, page-wise work stays with Spark's own operators."""

import re

from piiguard.functions import actions as A
from piiguard.operators import pages as O
from piiguard.registry import QUERIES


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


ELEMENTS = (
    "page_id long, elem_idx int, selector string, tag string, attributes map<string,string>, text string, aria_label string, label_text string, form_id string, visible boolean, interactive boolean, "
    "x double, y double, w double, h double, svg_idx int"
)


def test_each_pattern_is_searched_once(spark):
    plan = optimized(O.with_layers(spark.createDataFrame([], ELEMENTS)))
    assert plan.count("regexp_extract_all(") == 7 and "Python" not in plan


def test_gate_tells_words_once(spark):
    plan = optimized(spark.createDataFrame([], ELEMENTS).select(O.signals().alias("s")))
    assert plan.count("concat_ws(") == 1


def test_actions_are_parsed_once(spark):
    table = spark.createDataFrame([("{}",)], "raw string").repartition(2)
    plan = optimized(A.parsed(table))
    assert plan.lower().count("parsejson(") + plan.lower().count("parse_json(") == 1


def test_parsed_actions(spark):
    good = '{"action": "click", "target": "#a", "reasoning_id": "r", "value_ref": "v", "parameters": [1]}'
    rows = [good, "[]", "{", None, '{"action": "click"}', good[:-1] + ', "more": 1}', good.replace('"#a"', "null"), good.replace("[1]", "null"), good.replace('"v"', "1"), '{"action": "a", "action": "b", "target": "t", "reasoning_id": "r"}']
    got = A.parsed(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")).collect()
    told = {r["i"]: (bool(r["formed"]), r["unknown"], r["action"], r["target"]) for r in got}
    assert told[0] == (True, [], "click", "#a") and told[5][:2] == (False, ["more"]) and told[4][2:] == ("click", None)
    assert {i for i, t in told.items() if t[0]} == {0} and len(told) == len(rows)


def test_customers_are_dealt_before_their_rows_are_parsed(spark):
    """A file of one row group is one split, so its rows must be dealt below the parsing."""
    for name in ("rsn_schema", "el_aria_label", "el_label_text"):
        plan = optimized(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "RepartitionByExpression [c_custkey" in plan and plan.count("RepartitionByExpression") == plan.count("parquet"), name


def test_strategies_run_the_layers_once(spark):
    """one pass over the elements, not one for each of counts, first elements and gates."""
    plan = optimized(O.strategies(O.with_layers(spark.createDataFrame([], ELEMENTS))))
    assert plan.count("regexp_extract_all(") == 7 and "Join" not in plan


def test_boxes_are_dealt_before_they_are_copied_to_cells(spark):
    """a small file of one row group is one task, which made all copies and pairs."""
    for name in ("geo_overlap", "geo_overlap_page"):
        plan = optimized(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert plan.count("RepartitionByExpression") == 2 and plan.index("Generate") < plan.index("RepartitionByExpression")


def test_overlaps_are_sorted_by_cell_first(spark):
    """with page or level first, most rows tie in the sort's prefix."""
    plan = optimized(QUERIES["geo_overlap_page"](spark, "/root/testdata/sf0.001"))
    keys = re.findall(r"(_cx|_cy|_level)#\d+L? = \1#", plan.split("Join Inner, ", 1)[1].splitlines()[0])
    assert keys == ["_cx", "_cy", "_level"]


def test_tables_by_page_are_not_broadcast(spark):
    """Kept tables are small as files, so their rows, some for each page, went whole to the driver."""
    for name in ("ev_security", "val_mock_actions"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan, name
