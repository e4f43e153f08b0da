"""Detection, redaction, sanitizing and leak checks over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from piiguard.functions import patterns as P


def detect(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """One row a match: key, match_ordinal, match."""
    return df.select(key, F.posexplode(P.matches(F.col(text), name)).alias("pos", "match")).select(key, (F.col("pos") + 1).cast("long").alias("match_ordinal"), "match")


def detections(df: DataFrame, key: str, text: str) -> DataFrame:
    """All pattern matches with type, source, severity and confidence; one pass over each text."""
    found = F.flatten(F.array(*[_tagged(n, text) for n in P.PATTERNS]))
    return df.select(key, F.explode(found).alias("d")).select(key, "d.type", F.lit(P.SOURCES[2]).alias("source"), "d.severity", F.lit(0.8).alias("confidence"), "d.original_value")


def _tagged(name: str, text: str) -> Column:
    kind = P.KINDS[name]
    return F.transform(P.matches(F.col(text), name), lambda m: F.struct(F.lit(kind).alias("type"), F.lit(P.SEVERITY[kind]).alias("severity"), m.alias("original_value")))


def span_array(text: Column, names: list[str]) -> Column:
    """Spans of several patterns with type and order of emission."""

    def tagged(ordinal: int, name: str) -> Column:
        kind = P.KINDS[name]
        return F.transform(P.spans(text, name), lambda s: F.struct(s["start"].alias("start"), F.lit(ordinal).alias("ordinal"), s["end"].alias("end"), F.lit(kind).alias("type"), s["match"].alias("match")))

    return F.flatten(F.array(*[tagged(i, n) for i, n in enumerate(names)]))


def keep_disjoint(spans: Column) -> Column:
    """Greedy by start, then by order of emission: a span that overlaps a kept one is dropped.

    Spans come in order of start, so only the end of the last kept one matters.
    """
    step = lambda a, s: F.when(s["start"] < a["end"], a).otherwise(F.struct(s["end"].alias("end"), F.array_append(a["kept"], s).alias("kept")))
    start = lambda s: F.struct(F.lit(0).alias("end"), F.slice(s, 1, 0).alias("kept"))
    return P.bind(F.sort_array(spans), lambda s: F.aggregate(s, start(s), step, lambda a: a["kept"]))


def redact(text: Column, kept: Column) -> Column:
    """Replace kept spans by placeholders: the pieces between them, joined."""
    body = F.coalesce(text, F.lit(""))

    def joined(k: Column) -> Column:
        end = lambda i: F.coalesce(F.get(k, i)["end"], F.lit(0))
        piece = lambda s, i: F.concat(F.substr(body, end(i - 1) + 1, s["start"] - end(i - 1)), P.placeholder(s["type"]))
        return F.concat(F.array_join(F.transform(k, piece), ""), F.substr(body, end(F.size(k) - 1) + 1))

    return P.bind(kept, lambda k: F.when(F.size(k) == 0, body).otherwise(joined(k)))


def redact_spans(df: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """key, redacted text, how many spans went, and what they were (infos).

    The spans of a row are found once, in a lambda variable that redaction and infos share.
    """
    def info(s: Column) -> Column:
        place = P.placeholder(s["type"])
        end = (s["start"] + F.length(place)).alias("end")
        return F.struct(s["type"].alias("type"), s["match"].alias("original_value"), place.alias("replacement"), s["start"].alias("start"), end)

    def body(k: Column) -> Column:
        return F.struct(redact(F.col(text), k).alias("redacted"), F.size(k).cast("long").alias("n_redactions"), F.transform(k, info).alias("infos"))

    done = P.bind(keep_disjoint(span_array(F.col(text), names)), body)
    return df.select(key, F.inline(F.array(done)))


def redact_values(text: Column, infos: Column) -> Column:
    """Redaction by given infos (array of struct type, start, end; null offsets insert the placeholder at the start)."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    fields = lambda s, i: F.struct(
        zero(s["start"]).alias("start"), i.cast("int").alias("ordinal"), zero(s["end"]).alias("end"), s["type"].alias("type"), F.lit("").alias("match")
    )
    return redact(text, keep_disjoint(F.transform(infos, fields)))


def sanitize_values(text: Column, values: Column) -> Column:
    """Replace each value (array of struct value, type) wherever it stands, then the tail patterns."""
    literal = lambda v: F.concat(F.lit("(?iu)\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    folded = F.aggregate(F.filter(values, lambda d: F.trim(d["value"]) != ""), text, lambda s, d: F.regexp_replace(s, literal(d["value"]), P.placeholder(d["type"])))
    return P.sanitize(folded)


def detected_values(text: str) -> Column:
    """All matches of the seven patterns as structs of value and type, in order of emission."""
    found = F.flatten(F.array(*[_tagged(n, text) for n in P.PATTERNS]))
    return F.transform(found, lambda d: F.struct(d["original_value"].alias("value"), d["type"].alias("type")))


def leaks_values(text: Column, values: Column) -> Column:
    """Fail closed like :func:`P.leaks`; also true where a detected value is left, or a password has no placeholder."""
    left = F.exists(values, lambda d: (d["value"] != "") & (d["value"] != P.placeholder(d["type"])) & F.contains(text, d["value"]))
    password = F.exists(values, lambda d: d["type"] == "password") & (text != "") & ~F.contains(text, F.lit("[PASSWORD]"))
    return F.coalesce(P.leaks(text) | left | password, F.lit(True))
