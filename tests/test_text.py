from pyspark.sql import functions as F

from piiguard.functions import patterns as P
from piiguard.operators import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first()["v"]


def found(spark, name, text):
    return one(spark, P.matches(F.col("t"), name), t=text)


def test_patterns(spark):
    assert found(spark, "l2_email", "mail a.b@c.org now") == ["a.b@c.org"]
    for phone in ("555-123-4567", "555.123.4567"):
        assert found(spark, "l2_phone_nanp", f"call {phone}.") == [phone]
    assert found(spark, "l2_ssn", "123-45-6789 123 45 6789 123.45.6789") == ["123-45-6789", "123 45 6789", "123.45.6789"]
    assert found(spark, "l2_pobox", "po box 12 and P.O. Box 7") == ["po box 12", "P.O. Box 7"]
    assert found(spark, "l2_credit_card", "4532015112830366 1234567890123456") == ["4532015112830366"]
    assert found(spark, "l2_phone_e164", "é12 34") == ["12", "34"]
    assert found(spark, "l2_email", None) == []


def test_spans_are_real_offsets(spark):
    spans = one(spark, P.spans(F.col("t"), "l2_phone_e164"), t="a12 12 zz 34")
    assert [(s["start"], s["end"]) for s in spans] == [(4, 6), (10, 12)]


def test_redaction_keeps_first_of_overlapping(spark):
    text = "x a@b.com y 555-123-4567 z"
    row = T.redact_spans(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t", ["l2_email", "l2_phone_nanp", "l2_phone_e164"]).orderBy("id").collect()
    assert row[0]["redacted"] == "x [EMAIL] y [PHONE] z" and row[0]["n_redactions"] == 2
    assert [r["redacted"] for r in row[1:]] == ["", ""]


def test_control_characters_do_not_move_spans(spark):
    row = T.redact_spans(spark.createDataFrame([(1, "a\x01b\x02 x@y.org\x01 12")], "id int, t string"), "id", "t", ["l2_email", "l2_phone_e164"]).first()
    assert row["redacted"] == "a\x01b\x02 [EMAIL]\x01 [PHONE]" and [(i["start"], i["end"]) for i in row["infos"]] == [(5, 12), (14, 21)]


def test_missing_offsets_insert_at_the_start(spark):
    infos = F.array(F.struct(F.lit("email").alias("type"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end")))
    assert one(spark, T.redact_values(F.col("t"), infos), t="abc") == "[EMAIL]abc"


def test_plans_search_once(spark):
    """Each pattern once in extraction and once in the split of texts that have it; nothing is written out twice."""
    docs = spark.createDataFrame([(1, "x")], "id int, t string")
    plan = T.redact_spans(docs, "id", "t", ["l2_email", "l2_phone_nanp", "l2_credit_card"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 3 and plan.count("split(") == 3


def test_adjacent_spans_both_go(spark):
    spans = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(i).alias("ordinal"), F.lit(e).alias("end"), F.lit("email").alias("type")) for i, (s, e) in enumerate([(0, 3), (3, 6), (1, 5)])])
    assert [(k["start"], k["end"]) for k in one(spark, T.keep_disjoint(spans), t="")] == [(0, 3), (3, 6)]


def test_value_replacement_is_literal(spark):
    values = F.array(F.struct(F.lit("a.b(c").alias("value"), F.lit("name").alias("type")), F.struct(F.lit(" ").alias("value"), F.lit("name").alias("type")))
    assert one(spark, T.sanitize_values(F.col("t"), values), t="A.B(C axb(c 555-123-4567") == "[NAME] axb(c [PHONE]"


def test_leak_check_fails_closed(spark):
    assert one(spark, P.leaks(F.col("t")), t=None) is True
    assert one(spark, P.leaks(F.col("t")), t="nothing") is False


def test_detected_values_go_and_are_checked(spark):
    card = "pay 4532015112830366 to P.O. Box 77"
    clean = one(spark, T.sanitize_values(F.col("t"), T.detected_values("t")), t=card)
    assert clean == "pay [CREDIT_CARD] to P.O. Box [PHONE]"
    assert one(spark, P.leaks(F.col("t")), t=card) is False
    assert one(spark, T.leaks_values(F.col("t"), T.detected_values("t")), t=card) is True
    assert one(spark, T.leaks_values(F.lit(clean), T.detected_values("t")), t=card) is False
    assert one(spark, T.leaks_values(F.col("t"), T.detected_values("t")), t=None) is True
    password = F.array(F.struct(F.lit("hunter").alias("value"), F.lit("password").alias("type")))
    assert [one(spark, T.leaks_values(F.col("t"), password), t=t) for t in ("secret", "[PASSWORD]", "")] == [True, False, False]


def test_url_origin(spark):
    for url, origin in {"https://u:p@A.test:443/x?y": "https://a.test", "http://a.test:8080": "http://a.test:8080", "nonsense": "unknown", "mailto:a@b.org": "null", "wss://A.test:443": "wss://a.test"}.items():
        assert one(spark, P.url_origin(F.col("t")), t=url) == origin
