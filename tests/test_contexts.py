"""Behaviour of the page operators on small hand-made elements."""

import pytest
from pyspark.sql import functions as F

from piiguard.functions import elements as E
from piiguard.operators import pages as O, statistics as S

SCHEMA = (
    "page_id long, elem_idx int, selector string, tag string, attributes map<string,string>, text string, aria_label string, label_text string, form_id string, "
    "visible boolean, interactive boolean, x double, y double, w double, h double, svg_idx int"
)


def elements(spark, *rows):
    base = {"page_id": 1, "text": None, "aria_label": None, "label_text": None, "form_id": None, "visible": True, "interactive": True, "x": 0.0, "y": 0.0, "w": 100.0, "h": 50.0, "svg_idx": None}
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    full = [base | {"elem_idx": i, "selector": f"#e{i}", "attributes": {"id": f"e{i}"} | r.pop("attributes", {})} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], SCHEMA)


def run(spark, *rows):
    e = elements(spark, *rows)
    found = O.detections(O.with_layers(e))
    return e, found, O.annotated(e, O.group(e, found))


def pages(spark, url="https://example.test/x"):
    return spark.createDataFrame([(1, url)], "page_id long, url string")


def test_layers_in_order_with_sources_and_gate(spark):
    mail = {"tag": "P", "text": "write to a@b.org or 555-123-4567"}
    field = {"tag": "INPUT", "attributes": {"type": "password"}, "text": "s3cret"}
    face = {"tag": "IMG", "attributes": {"alt": "my face", "src": "avatar.png"}}
    _, found, _ = run(spark, mail, field, face, {"tag": "P", "text": "a@b.org", "visible": False})
    got = [(r["seq"], r["elem_idx"], r["type"], r["source"], r["confidence"]) for r in found.orderBy("seq").collect()]
    assert got[0] == (0, 1, "password", "layer1_typed_field", 0.95) and got[1] == (1, 0, "email", "layer2_regex", 0.8)
    assert got[-1] == (len(got) - 1, 2, "face", "layer3_visual", 0.8) and {g[1] for g in got} == {0, 1, 2}


def test_faces_of_drawings(spark):
    def drawing(eyes, face, mouth):
        rows = [{"tag": "SVG"}] + [{"tag": "CIRCLE", "svg_idx": 0, "attributes": {"r": r}} for r in [*eyes, face]] + [{"tag": "PATH", "svg_idx": 0, "attributes": {"d": mouth}}]
        return O.with_face_indicators(elements(spark, *rows)).where("tag = 'SVG'").first()["indicators"]

    assert drawing(["5", "6"], "40", "M40,70 Q50,80 60,70") == 3 and drawing(["5", "6"], "20", "") == 0 and drawing(["5", "bad"], "40", "Qmouth") == 1


def test_group_goes_to_the_first_element_of_a_selector(spark):
    e, found, full = run(spark, {"tag": "P", "text": "x", "selector": "#a"}, {"tag": "P", "text": "m@n.org", "selector": "#a"}, {"tag": "P", "text": "o@p.org", "selector": None})
    grouped = {r["elem_idx"]: [d["original_value"] for d in r["detections"]] for r in O.group(e, found).collect()}
    assert grouped == {0: ["m@n.org"]}
    assert [(r["position"], r["elem_idx"]) for r in O.flat(O.group(e, found)).collect()] == [(0, 0)] and full.count() == 3


def test_contexts_hide_values_and_pass_the_leak_check(spark):
    rows = ({"tag": "INPUT", "attributes": {"type": "password", "value": "hunter2"}, "text": "hunter2"}, {"tag": "P", "text": "Mail A@B.org, a@b.ORG"}, {"tag": "P", "text": "z@z.org", "visible": False})
    _, _, full = run(spark, *rows)
    clean = O.sanitized_deep(full)
    got = {r["elem_idx"]: r for r in clean.collect()}
    assert set(got) == {0, 1} and got[1]["text"] == "Mail [EMAIL], [EMAIL]" and got[0]["text"] == "[PASSWORD]" and got[0]["attributes"]["value"] == "[PASSWORD]"
    assert [d["original_value"] for d in got[0]["detections"]] == ["[PASSWORD]"]
    raw = O.leak_checks(full.where("visible"), pages(spark)).first()
    assert raw["email"] and raw["residual"] and raw["password_text"] and raw["password_value"] and not raw["phone"] and not raw["valid"]
    assert O.leak_checks(clean, pages(spark)).first()["valid"]
    assert O.context(clean, pages(spark)).first()["placeholders"] == 3


def test_structured_context(spark):
    rows = ({"tag": "H1", "text": "Title"}, {"tag": "P", "visible": False}, {"tag": "INPUT", "attributes": {"name": "n", "placeholder": "p"}}, {"tag": "P", "text": "a@b.org"})
    got = [(r["id"], r["role"], r["label"], r["sensitive"]) for r in O.structured(run(spark, *rows)[2]).orderBy("id").collect()]
    assert got == [("element-0", "h1", "Title", False), ("element-1", "textbox", "n", False), ("element-2", "p", "[EMAIL]", True)]


ACTION = '{"action": "click", "target": "%s", "reasoning_id": "r"%s}'


@pytest.mark.parametrize("raw,reason", [
    (ACTION % ("#e0", ""), None), ('{"action": "click", "target": "#e0"}', "INVALID_SCHEMA"), ('{"action": "click", "target": null, "reasoning_id": "r"}', "INVALID_SCHEMA"),
    ('{"action": 1, "target": "#e0", "reasoning_id": "r"}', "INVALID_SCHEMA"), ('{"parameters": {"action": "click", "target": "#e0", "reasoning_id": "r"}}', "INVALID_SCHEMA"),
    (ACTION % ("#e0", ', "parameters": null'), "INVALID_SCHEMA"), (ACTION % ("#e0", ', "parameters": "x"'), "INVALID_SCHEMA"), (ACTION % ("#e0", ', "value_ref": 1'), "INVALID_SCHEMA"),
    (ACTION % ("#e0", ', "more": 1'), "INVALID_SCHEMA"), ("{", "INVALID_SCHEMA"), ("[1]", "INVALID_SCHEMA"), (None, "INVALID_SCHEMA"),
    ((ACTION % ("#e0", "")).replace("click", "wait"), "UNSUPPORTED_ACTION"), ((ACTION % ("#e0", "")).replace('"r"', '"q"'), "MISSING_REASONING_ID"), ((ACTION % ("#e0", "")).replace('"r"', '""'), "MISSING_REASONING_ID"),
    (ACTION % ("#none", ""), "TARGET_NOT_FOUND"), (ACTION % ("div > p", ""), "TARGET_NOT_FOUND"), (ACTION % ("button", ""), "AMBIGUOUS_TARGET"), (ACTION % ("BUTTON", ""), "TARGET_NOT_FOUND"),
    (ACTION % ("#e1", ""), "INVISIBLE_TARGET"), (ACTION % ("#e2", ""), "DISABLED_TARGET"), (ACTION % ("[disabled]", ""), "TARGET_NOT_FOUND"), (ACTION % ("[title]", ""), None),
    (ACTION % ('[name=\\"q\\"]', ""), "SENSITIVE_ACTION"), (ACTION % ("#e4", ', "value_ref": "none"'), "SENSITIVE_ACTION"), (ACTION % ("#e0", ', "value_ref": "none"'), "INVALID_VALUE_REF"),
    (ACTION % ("#e0", ', "value_ref": "empty"'), "INVALID_VALUE_REF"), (ACTION % ("#e0", ', "value_ref": "v"'), None), (ACTION % ("#e0", ', "value_ref": ""'), None),
])
def test_validation_order(spark, full, raw, reason):
    asked = spark.createDataFrame([(1, 1, raw)], "action_id long, page_id long, raw string")
    kw = {"origins": ["https://example.test"], "reasoning_ids": ["r"], "values": {"v": "x", "empty": ""}}
    got = O.validate(asked, full, pages(spark), **kw).first()
    assert (got["valid"], got["reason"]) == (reason is None, reason)
    if raw == ACTION % ("#e0", ""):
        assert O.validate(asked, full, pages(spark, "https://other.test"), **kw).first()["reason"] == "ORIGIN_MISMATCH"


@pytest.fixture(scope="module")
def full(spark):
    rows = (
        {"tag": "BUTTON", "attributes": {"title": "t"}}, {"tag": "BUTTON", "visible": False}, {"tag": "BUTTON", "attributes": {"disabled": ""}},
        {"tag": "INPUT", "attributes": {"type": "email", "name": "q"}, "form_id": "f"}, {"tag": "A", "form_id": "f"},
    )
    return run(spark, *rows)[2].cache()


def test_mock_actions_name_their_targets(spark, full):
    got = {r["name"]: r["raw"] for r in O.mock_actions(full).collect()}
    assert len(got) == 13 and '"#e0"' in got["valid_click"] and '"#e1"' in got["invisible_target"] and '"#e2"' in got["disabled_target"] and "target" not in got["malformed"]


def test_reasoning_follows_the_task(spark):
    rows = ({"tag": "INPUT", "attributes": {"type": "email"}}, {"tag": "INPUT", "attributes": {"placeholder": "Any"}}, {"tag": "INPUT", "attributes": {"name": "display"}}, {"tag": "BUTTON"})
    clean = O.sanitized_deep(run(spark, *rows)[2])
    tasks = spark.createDataFrame([(1, t) for t in ("fill it", "fill the DISPLAY", "click", "scroll", "hm")] + [(2, "fill")], "page_id long, task string")
    got = {(r["page_id"], r["task"]): (r["action"], r["target"]) for r in O.decide(O.reasoning_input(clean), tasks).collect()}
    assert got == {(1, "fill it"): ("fill", "#e1"), (1, "fill the DISPLAY"): ("fill", "#e2"), (1, "click"): ("click", "#e3"), (1, "scroll"): ("fill", "#e1"), (1, "hm"): ("fill", "#e1"), (2, "fill"): ("wait", None)}


def test_strategies(spark):
    e = O.with_layers(elements(spark, {"tag": "P", "text": "a@b.org"}, {"tag": "IMG", "attributes": {"alt": "face portrait"}}))
    got = {(r["strategy"], r["mode"]): r for r in O.strategies(e).collect()}
    assert len(got) == 12 and got["dom_only", "heuristic"]["detections"] == 1 and got["dom_gated_vision", "heuristic"]["detections"] == 2
    assert got["unconditional_vision", "local_model_wasm"]["model_success"] is False and got["dom_only", "heuristic"]["model_success"] is None


def test_empty_role_falls_through(spark):
    row = spark.createDataFrame([("A", ""), ("A", "tab"), ("P", None)], "tag string, role string").select(E.role_of(F.col("tag"), F.col("role")).alias("r")).collect()
    assert [r["r"] for r in row] == ["link", "tab", None]


def test_percentiles_of_hot_groups_and_nulls(spark):
    rows = [(1, float(v)) for v in [5] * 50 + [1, 2, 9]] + [(2, None), (3, 4.0), (3, float("nan"))]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    got = {r["g"]: r for r in S.summary(df, "g", "v", {"p": 0.5, "q": 0.99}).collect()}
    assert (got[1]["p"], round(got[1]["q"], 6), got[2]["count"], got[2]["p"], got[3]["p"]) == (5.0, 6.92, 0, 0.0, 4.0)
    assert {r["g"]: r["n"] for r in S.nearest(df, "g", "v", {"n": 0.95}).collect()} == {1: 5.0, 3: 4.0}


def test_leak_checks_look_for_the_values_as_they_were_found(spark):
    """A detection's placeholder is no value left over, a value left in another element is one; a name that holds a short number is none."""
    field = {"tag": "INPUT", "attributes": {"type": "text"}, "text": "12 Main Street", "aria_label": "Shipping address"}
    valid = lambda *rows: O.leak_checks(O.sanitized_deep(O.with_values(run(spark, *rows)[2])), pages(spark)).first()["valid"]
    assert valid(field, {"tag": "INPUT", "attributes": {"name": "n12"}})
    assert not valid(field, {"tag": "P", "text": "at 12 Main Street", "selector": "#e0"})
    assert not valid(field, {"tag": "IMG", "attributes": {"alt": "at 12 Main Street"}})
