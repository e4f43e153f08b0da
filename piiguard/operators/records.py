"""Sanitizing of nested records of any depth.

A JSON record is written anew by VARIANT, so that quotes stand around names and strings only, and is cut at its quotes: every second
piece is a name or a string. Strings are sanitized in place and the pieces joined again. So a record is never walked by a
recursive function, its depth costs nothing, and no record leaves its row: nothing is shuffled, and records are kept once.

Objects come out with their names in order and without repeated ones, as a VARIANT keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from piiguard.functions import patterns as P
from piiguard.operators import text as T
from piiguard.shared import materialize

#: A string under this name is the value of a detection itself.
OWN_VALUE = "originalValue"
#: Stand for an escaped backslash and an escaped quote while a record is cut. JSON has control characters only as escapes.
_ESCAPED = {"\\\\": "\x01", '\\"': "\x02"}

#: What each phone number ends with, as a piece spells it: a white space between may be an escape.
_NUMBER = "[0-9]{3}[^0-9]{0,6}[0-9]{4}"


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def pieces(json: Column) -> Column:
    """A record cut at the quotes of its names and strings, which are the pieces of odd place; null of what is no JSON."""
    marked = F.to_json(F.try_parse_json(json))
    for escape, mark in _ESCAPED.items():
        marked = F.replace(marked, F.lit(escape), F.lit(mark))
    return F.split(marked, '"', -1)


def _unmarked(piece: Column) -> Column:
    for escape, mark in _ESCAPED.items():
        piece = F.replace(piece, F.lit(mark), F.lit(escape))
    return piece


def _text(piece: Column) -> Column:
    """The string that a piece spells."""
    return F.variant_get(F.parse_json(F.concat(F.lit('"'), _unmarked(piece), F.lit('"'))), "$", "string")


def _piece(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(3), F.length(listed) - 4)


def _clean(text: Column, own: Column, values: Column) -> Column:
    """A string sanitized; one under :data:`OWN_VALUE` that equals a detected value is that detection's placeholder."""
    same = F.get(F.filter(values, lambda d: d["value"] == text), F.lit(0))
    return F.when(own & (text != "") & same.isNotNull(), P.placeholder(same["type"])).otherwise(T.sanitize_values(text, values))


def sanitized(json: Column, detections: Column) -> Column:
    """A record with every string sanitized; names stay as they are. A string that nothing can be replaced in is not looked at further."""
    none = F.array().cast("array<struct<value:string,type:string>>")
    values = F.filter(F.coalesce(detections, none), lambda d: d["value"].isNotNull())

    def joined(r: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before, after = F.get(r["pieces"], i - 1), F.get(r["pieces"], i + 1)
            own = (before == ":") & (F.get(r["pieces"], i - 2) == OWN_VALUE)
            able = (F.size(r["values"]) > 0) | F.contains(x, F.lit("@")) | x.rlike(_NUMBER)
            cleaned = P.bind(_text(x), lambda text: _piece(_clean(text, own, r["values"])))
            return F.when((i % 2 == 1) & ~after.startswith(":") & able, cleaned).otherwise(x)

        return F.array_join(F.transform(r["pieces"], piece), '"')

    return _unmarked(P.bind(F.struct(pieces(json).alias("pieces"), values.alias("values")), joined))


def sanitize_records(records: DataFrame) -> DataFrame:
    """key and json of ``records`` (key, json, detections as an array of struct value and type), every string sanitized.

    A non-empty string under ``originalValue`` that equals a detected value becomes the placeholder of the first such
    detection; all others have the detected values and the tail patterns replaced. Names stay as they are. What is no
    JSON has a null.
    """
    records = materialize(records, "records")  # made by compiled code; in the lambdas below, which are not, it takes long
    return records.select("key", sanitized(F.col("json"), F.col("detections")).alias("json"))
