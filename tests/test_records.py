"""Nested records against the plain recursion."""

import json
import random
import re

from piiguard.functions import patterns as P
from piiguard.operators import records as R


def plain(value, found):
    if isinstance(value, str):
        for v, kind in found:
            if v and v.strip():
                value = re.sub(re.escape(v), lambda _, k=kind: P.PLACEHOLDERS[k], value, flags=re.I)
        value = re.sub(P.SANITIZE_EMAIL, "[EMAIL]", value)
        return re.sub(P.SANITIZE_PHONE, "[PHONE]", value, flags=re.A)
    if isinstance(value, list):
        return [plain(v, found) for v in value]
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            same = next((kind for w, kind in found if w == v), None) if k == "originalValue" and isinstance(v, str) and v else None
            out[k] = P.PLACEHOLDERS[same] if same else plain(v, found)
        return out
    return value


def grow(rng, depth):
    kind = rng.randint(0, 9)
    if depth and kind < 3:
        return {rng.choice(["a", "b", "originalValue", "é \"q\"", "", "z.x"]): grow(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if depth and kind < 6:
        return [grow(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return rng.choice(["Ann Lee", "call ANN LEE now", "mail x@y.test or (555) 123-4567", "", "  ", "plain", "4532015112830366", "a.b*c", "A.B*C and a1b*c", 1, -2.5, 0, True, False, None, "line\nbreak \"quoted\" \\ back", "\\E tail"])


def test_records_of_any_depth_equal_the_recursion(spark):
    rng = random.Random(6)
    found = [("Ann Lee", "name"), ("4532015112830366", "credit_card"), ("a.b*c", "ssn"), ("Ann Lee", "email"), ("", "phone"), ("\\E tail", "address")]
    rows, want = [], {}
    for i in range(300):
        value = grow(rng, rng.randint(0, 7))
        deep = value
        for _ in range(rng.choice([0, 0, 0, 12])):
            deep = {"in": [deep]}
        own = found[: rng.randint(0, 6)]
        rows.append((i, json.dumps(deep, ensure_ascii=rng.random() < 0.5), own))
        want[i] = plain(deep, own)
    rows += [(900, None, []), (901, "{not json", []), (902, "{}", None), (903, "[]", []), (904, '"Ann Lee"', found)]
    want |= {902: {}, 903: [], 904: "[NAME]"}
    table = spark.createDataFrame(rows, "key long, json string, detections array<struct<value:string,type:string>>").repartition(3)
    got = {r["key"]: r["json"] for r in R.sanitize_records(table).collect()}
    assert len(got) == len(rows) and got[900] is None and got[901] is None
    assert {k: json.loads(got[k]) for k in want} == want


def test_records_stay_in_their_rows(spark):
    """each level was kept with all that is below it, 61 times the input on disk; nothing is shuffled now."""
    table = spark.createDataFrame([(1, '{"a":["x@y.test",{"originalValue":"\\\\\\"z"}]}', [('\\"z', "name")])] * 2, "key long, json string, detections array<struct<value:string,type:string>>")
    plan = R.sanitize_records(table)
    assert [r["json"] for r in plan.collect()] == ['{"a":["[EMAIL]",{"originalValue":"[NAME]"}]}'] * 2
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_strings_of_many_escapes(spark):
    text = '\\"\n\x01\x02:' * 50_000 + "a@b.test"
    table = spark.createDataFrame([(1, json.dumps({'k"\\': text, "l": [text]}), [])], "key long, json string, detections array<struct<value:string,type:string>>")
    want = text.replace("a@b.test", "[EMAIL]")
    assert json.loads(R.sanitize_records(table).first()["json"]) == {'k"\\': want, "l": [want]}
