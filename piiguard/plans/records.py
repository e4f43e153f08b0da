"""Queries over nested JSON: sanitizing at any depth, and the schemas of requests and actions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from piiguard.functions import actions as A, schema as SC
from piiguard.operators import records as R, text as T
from piiguard.plans import contexts as C, elements as EL, text as TX

QUERIES, ORACLES = {}, {}

#: A document's record: the text is 1 to 6 levels deep; ``first`` is the first value that is detected in it, else the text.
LEVELS = 6


def _wrapped(concat, quote, number, text, lang, first, own) -> list:
    """The record with its text at each depth, as an expression of either engine; names are in order."""
    inner = concat('{"flag":true,"n":', number, ',"nil":null,"originalValue":', own, ',"text":', quote(text), "}")
    out = [inner]
    for depth in range(2, LEVELS + 1):
        inner = concat('{"inner":', inner, ',"list":[', str(depth), ",", quote(lang), ',[],{},{"originalValue":', own, '}],"originalValue":[', quote(first), "]}")
        out.append(inner)
    return out


def records(spark, sf_dir):
    """key, json and detections of each document's record."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", T.detected_values("text").alias("detections"))
    first = F.coalesce(F.get("detections", F.lit(0))["value"], F.col("text"))
    concat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    quote = lambda c: R._quoted(c)
    made = _wrapped(concat, quote, F.col("doc_id").cast("string"), F.col("text"), F.col("lang"), F.col("first"), quote(F.col("first")))
    json = F.element_at(F.array(*made), (F.col("doc_id") % LEVELS + 1).cast("int"))
    return found.withColumn("first", first).select(F.col("doc_id").alias("key"), json.alias("json"), "detections")


def san_deep_records(spark, sf_dir):
    """Nested records of documents with every string sanitized, at any depth."""
    return R.sanitize_records(records(spark, sf_dir)).withColumnRenamed("key", "doc_id")


def _sql_concat(*parts: str) -> str:
    return " || ".join(p if p.startswith("(") else TX.q(p) for p in parts)


_QUOTE = lambda c: f"(to_json({c})::VARCHAR)"
_MADE = _wrapped(lambda *p: "(" + _sql_concat(*p) + ")", _QUOTE, "(doc_id::VARCHAR)", "clean", "lang", "clean_first", "(to_json(own)::VARCHAR)")
_DEEP = f"""SELECT doc_id, [{', '.join(_MADE)}][doc_id % {LEVELS} + 1] AS json FROM (SELECT doc_id, lang, {C.tail_sql(TX._fold_sql('v'))} AS clean,
 CASE WHEN len(v) > 0 THEN split_part(v[1], chr(0), 2) ELSE {C.tail_sql('text')} END AS own,
 {C.tail_sql("list_reduce(list_prepend(CASE WHEN len(v) > 0 THEN split_part(v[1], chr(0), 1) ELSE text END, v), lambda a, v: regexp_replace(a, regexp_escape(split_part(v, chr(0), 1)), split_part(v, chr(0), 2), 'gi'))")} AS clean_first
 FROM (SELECT doc_id, lang, coalesce(text, '') AS text, flatten({TX._VALUES}) AS v FROM documents))"""
QUERIES["san_deep_records"] = san_deep_records
ORACLES["san_deep_records"] = _DEEP


# ---- schemas ------------------------------------------------------------------------------------
def request(spark, sf_dir):
    """A whole request a customer; each has one fault of :data:`FAULTS`, or none."""
    fault = (F.col("c_custkey") % (len(FAULTS) + 1)).cast("int")
    concat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    pick = lambda place, good: F.element_at(F.create_map(*[F.lit(x) for i, (p, bad, _) in enumerate(FAULTS) if p == place for x in (i + 1, bad)]), fault) if any(p == place for p, _, _ in FAULTS) else None

    def part(place: str, good: str | Column) -> Column:
        bad = pick(place, good)
        own = F.lit(good) if isinstance(good, str) else good
        return own if bad is None else F.coalesce(bad, own)

    raw = SC.template(REQUEST, part, lambda parts: concat(*parts))
    return EL.customers(spark, sf_dir).select("c_custkey", raw.alias("raw"))


_BOX = SC.Record({k: SC.Number() for k in ("x", "y", "width", "height")})
#: The schema of a request to the reasoning step, and of an action.
REQUEST = SC.Record({
    "context": SC.Record({
        "metadata": SC.Record({
            "url": SC.Text(), "timestamp": SC.Number(),
            "domElements": SC.List(SC.Record({
                "tagName": SC.Text(), "attributes": SC.Values(SC.Text()), "boundingBox": _BOX, "textContent": SC.Optional(SC.Text()), "isInteractive": SC.Flag(),
                "piiDetections": SC.List(SC.Record({"type": SC.Text(), "confidence": SC.Number(), "location": SC.Values(SC.Anything()), "originalValue": SC.Optional(SC.Text())})),
            })),
            "visualRegions": SC.Optional(SC.List(SC.Record({
                "boundingBox": _BOX, "description": SC.Text(), "piiDetections": SC.List(SC.Values(SC.Anything())), "requiresVisionModel": SC.Flag(),
            }))),
        }),
        "redactions": SC.List(SC.Record({"type": SC.Text(), "target": SC.Values(SC.Anything()), "replacement": SC.Optional(SC.Text())})),
    }),
    "task": SC.Optional(SC.Text()),
})
ACTION = SC.Record({
    "action": SC.OneOf(A.ACTION_TYPES), "target": SC.Optional(SC.Text()), "parameters": SC.Optional(SC.Values(SC.Anything())), "reasoning_id": SC.Text(), "value_ref": SC.Optional(SC.Text()),
})
#: Of each field: its place in the template, JSON of another kind, and the path that is then reported; and each required one missing.
FAULTS = SC.faults(REQUEST)


def rsn_schema(spark, sf_dir):
    """Whole requests against the schema: the path of the first value that is missing or of another kind."""
    told = request(spark, sf_dir).select("c_custkey", SC.first_fault(REQUEST, F.try_parse_json("raw")).alias("fault"))
    return told.select(F.col("c_custkey").alias("page_id"), F.col("fault").isNull().alias("valid"), "fault")


ORACLES["rsn_schema"] = f"""SELECT c_custkey AS page_id, c_custkey % {len(FAULTS) + 1} = 0 AS valid, [{', '.join(TX.q(f) for _, _, f in FAULTS)}][c_custkey % {len(FAULTS) + 1}] AS fault FROM customer"""


def rsn_action_schema(spark, sf_dir):
    """Raw actions of the log against the reasoning step's own schema of actions."""
    told = EL.actions(spark, sf_dir).select("action_id", SC.first_fault(ACTION, F.try_parse_json("raw")).alias("fault"))
    return told.select("action_id", F.col("fault").isNull().alias("valid"), "fault")


_KIND = C._JSON
ORACLES["rsn_action_schema"] = f"""SELECT action_id, fault IS NULL AS valid, fault FROM (SELECT action_id, CASE WHEN coalesce(json_type(CASE WHEN json_valid(raw) THEN raw END), '') <> 'OBJECT' THEN '$'
 WHEN coalesce({_KIND('action')} = 'VARCHAR' AND {C._GET('action')} IN {EL._IN(A.ACTION_TYPES)}, false) = false THEN '$.action' WHEN coalesce({_KIND('target')}, 'VARCHAR') <> 'VARCHAR' THEN '$.target'
 WHEN coalesce({_KIND('parameters')}, 'OBJECT') <> 'OBJECT' THEN '$.parameters' WHEN coalesce({_KIND('reasoning_id')}, '') <> 'VARCHAR' THEN '$.reasoning_id'
 WHEN coalesce({_KIND('value_ref')}, 'VARCHAR') <> 'VARCHAR' THEN '$.value_ref' END AS fault FROM ({EL.ACTIONS_SQL}))"""
QUERIES |= {"rsn_schema": rsn_schema, "rsn_action_schema": rsn_action_schema}
