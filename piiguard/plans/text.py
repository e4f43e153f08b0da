"""Queries over texts: layer-two detections, redaction, sanitizing, leak checks, web origins."""

from __future__ import annotations

from pyspark.sql import functions as F

from piiguard.functions import patterns as P
from piiguard.operators import text as T

QUERIES, ORACLES = {}, {}
_SPANS = list(P.PATTERNS)


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


LUHN_SQL = (
    "length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr({d}, -i, 1)::INT "
    "WHEN substr({d}, -i, 1)::INT * 2 > 9 THEN substr({d}, -i, 1)::INT * 2 - 9 ELSE substr({d}, -i, 1)::INT * 2 END)) % 10 = 0"
)


def found_sql(name: str) -> str:
    base = f"regexp_extract_all(coalesce(text, ''), {q(P.PATTERNS[name])})"
    if name != "l2_credit_card":
        return base
    return f"list_filter({base}, lambda m: {LUHN_SQL.format(d='regexp_replace(m, ' + q('[^0-9]') + ', ' + q('') + ', ' + q('g') + ')')})"


#: Notes on customers, with post boxes and numbers that the documents have none of; in SQL that Spark and DuckDB share.
NOTES = """SELECT -c_custkey AS doc_id, concat('Write to PO Box ', c_custkey, ' or p.o. box 7, not to Box 9; number ', 100 + c_custkey % 900, '-45-', 1000 + c_custkey % 9000,
 ' or ', 100 + c_custkey % 900, ' 45 ', 1000 + c_custkey % 9000, ', not ', c_custkey, '-4-5') AS text FROM customer"""
NOTED = ("l2_ssn", "l2_pobox")


def _noted(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return _docs(spark, sf_dir).select("doc_id", "text").unionByName(spark.sql(NOTES.replace("FROM customer", "FROM {customer}"), customer=customer))


for _n in P.PATTERNS:
    QUERIES[_n] = lambda spark, sf_dir, n=_n: T.detect((_noted if n in NOTED else _docs)(spark, sf_dir), "doc_id", "text", n)
    _from = f"(SELECT doc_id, text FROM documents UNION ALL {NOTES})" if _n in NOTED else "documents"
    ORACLES[_n] = f"SELECT doc_id, unnest(range(1, len(f) + 1)) AS match_ordinal, unnest(f) AS match FROM (SELECT doc_id, {found_sql(_n)} AS f FROM {_from})"


def l2_luhn(spark, sf_dir):
    found = F.explode(F.regexp_extract_all("text", F.lit("[0-9][0-9 -]{11,22}[0-9]"), F.lit(0)))
    return _docs(spark, sf_dir).select("doc_id", found.alias("candidate")).select("doc_id", "candidate", P.luhn(F.col("candidate")).alias("valid"))


def l2_find_matches(spark, sf_dir):
    spans = F.explode(T.span_array(F.col("text"), list(P.PATTERNS))).alias("s")
    return _docs(spark, sf_dir).select("doc_id", spans).select("doc_id", "s.type", "s.start", "s.end", "s.match")


def l2_detect(spark, sf_dir):
    """Detections of the patterns in documents, counted by type."""
    found = T.detections(_docs(spark, sf_dir), "doc_id", "text")
    return found.groupBy("doc_id", "type", "source", "severity").agg(F.count("*").alias("n"))


def red_placeholder(spark, sf_dir):
    found = T.detections(_docs(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", "type", P.placeholder(F.col("type")).alias("placeholder")).distinct()


def red_spans(spark, sf_dir):
    return T.redact_spans(_docs(spark, sf_dir), "doc_id", "text", _SPANS).drop("infos")


def red_infos(spark, sf_dir):
    out = T.redact_spans(_docs(spark, sf_dir), "doc_id", "text", _SPANS)
    return out.select("doc_id", F.explode("infos").alias("i")).select("doc_id", "i.type", "i.original_value", "i.replacement", "i.start", "i.end")


def red_actions(spark, sf_dir):
    found = T.detections(_docs(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", F.lit("placeholder").alias("action"), "type", P.placeholder(F.col("type")).alias("replacement"))


def san_string(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", P.sanitize(F.col("text")).alias("sanitized"))


def san_string_turns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", P.sanitize(F.col("text")).alias("sanitized"))


def san_fold(spark, sf_dir):
    values = F.transform(T.span_array(F.col("text"), _SPANS), lambda s: F.struct(s["match"].alias("value"), s["type"].alias("type")))
    return _docs(spark, sf_dir).select("doc_id", T.sanitize_values(F.col("text"), values).alias("sanitized"))


def san_validate_text(spark, sf_dir):
    """The pattern part of the leak check, of raw texts and of texts after the tail of sanitizing."""
    return _docs(spark, sf_dir).select("doc_id", P.leaks(F.col("text")).alias("leak_raw"), P.bind(P.sanitize(F.col("text")), P.leaks).alias("leak_sanitized"))


def san_string_detected(spark, sf_dir):
    """The whole of text sanitizing: detected values of all patterns, then the tail of ``san_string``."""
    return _docs(spark, sf_dir).select("doc_id", T.sanitize_values(F.col("text"), T.detected_values("text")).alias("sanitized"))


def san_validate_detected(spark, sf_dir):
    """The whole leak check, with detected values and the password rule, of raw and wholly sanitized texts."""
    text = F.col("text")

    def both(v):
        clean = P.bind(T.sanitize_values(text, v), lambda c: T.leaks_values(c, v))
        return F.struct(T.leaks_values(text, v).alias("leak_raw"), clean.alias("leak_sanitized"))

    return _docs(spark, sf_dir).select("doc_id", F.inline(F.array(P.bind(T.detected_values("text"), both))))


def url_origin(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", P.url_origin(F.col("url")).alias("origin"))


def flagship(spark, sf_dir):
    """Documents with detections by language and type, and how many of them leak before and after sanitizing.

    One pass over the documents: types are counted within the row, then rows by language and type.
    """
    text = F.col("text")
    found = P.bind(F.flatten(F.array(*[F.transform(P.matches(text, n), _named(P.KINDS[n])) for n in P.PATTERNS])), _by_type)
    rows = _docs(spark, sf_dir).select("lang", P.leaks(text).alias("raw"), P.bind(P.sanitize(text), P.leaks).alias("clean"), found.alias("found"))
    each = rows.select("lang", "raw", "clean", F.explode("found").alias("t"))
    return each.groupBy("lang", F.col("t.type").alias("type")).agg(
        F.count("*").alias("n_documents"), F.sum("t.n").cast("long").alias("n_detections"), F.count_if("raw").alias("n_leaking_raw"), F.count_if("clean").alias("n_leaking_sanitized")
    )


def _named(kind: str):
    return lambda _: F.lit(kind)


def _by_type(types):
    """The types of an array with how often each is there."""
    count = lambda t: F.struct(t.alias("type"), F.size(F.filter(types, lambda x: x == t)).alias("n"))
    return F.transform(F.array_distinct(types), count)


_DETECTED = " UNION ALL ".join(
    f"SELECT doc_id, '{P.KINDS[n]}' AS type, 'layer2_regex' AS source, '{P.SEVERITY[P.KINDS[n]]}' AS severity, unnest({found_sql(n)}) AS m FROM documents" for n in P.PATTERNS
)
_PLACE = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.PLACEHOLDERS.items()) + " END"
_SAN = "regexp_replace(regexp_replace(text, {e}, '[EMAIL]', 'g'), {p}, '[PHONE]', 'g')".format(e=q(P.SANITIZE_EMAIL), p=q(P.SANITIZE_PHONE))
_LEAK = "coalesce(regexp_matches({t}, {e}) OR regexp_matches({t}, {p}), true)"
_leak = lambda t: _LEAK.format(t=t, e=q(P.SANITIZE_EMAIL), p=q(P.LEAK_PHONE))

for _f in (l2_luhn, l2_find_matches, l2_detect, red_placeholder, red_spans, red_infos, red_actions, san_string, san_string_turns, san_fold, san_validate_text, san_string_detected, san_validate_detected, url_origin, flagship):
    QUERIES[_f.__name__] = _f


def _spans_sql(names: list[str]) -> str:
    """Matches with their places: the lengths of the pieces between matches and of the matches before."""
    def of(i: int, n: str) -> str:
        flat = q(P.PATTERNS[n])
        at = "list_sum(list_transform(p[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: length(x))), 0)"
        luhn = " WHERE " + LUHN_SQL.format(d="regexp_replace(match, '[^0-9]', '', 'g')") if n == "l2_credit_card" else ""
        return f"""SELECT * FROM (SELECT doc_id, text, '{P.KINDS[n]}' AS type, {i} AS ordinal, ({at})::INTEGER AS start, m[k] AS match
 FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, text, regexp_extract_all(text, {flat}) AS m, string_split_regex(text, {flat}) AS p FROM documents WHERE text IS NOT NULL))){luhn}"""

    return f"SELECT *, (start + length(match))::INTEGER AS end_ FROM ({' UNION ALL '.join(of(i, n) for i, n in enumerate(names))})"


_PLACES = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.PLACEHOLDERS.items()) + " END"
#: Spans kept from left to right: each is kept if it starts behind the end of the last kept one.
_KEPT = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, type, start, end_, match, row_number() OVER (PARTITION BY doc_id ORDER BY start, ordinal) AS n FROM ({_spans_sql(_SPANS)})),
w(doc_id, n, kept, last) AS (SELECT doc_id, n, true, end_ FROM s WHERE n = 1 UNION ALL SELECT s.doc_id, s.n, s.start >= w.last, CASE WHEN s.start >= w.last THEN s.end_ ELSE w.last END FROM w JOIN s ON s.doc_id = w.doc_id AND s.n = w.n + 1),
k AS (SELECT s.*, coalesce(lag(end_) OVER (PARTITION BY s.doc_id ORDER BY s.n), 0) AS before FROM s JOIN w USING (doc_id, n) WHERE kept)"""
_VALUES = f"[{', '.join(f'list_transform({found_sql(n)}, lambda x: x || chr(0) || {q(P.PLACEHOLDERS[P.KINDS[n]])})' for n in P.PATTERNS)}]"


def _fold_sql(values: str) -> str:
    step = "regexp_replace(a, regexp_escape(split_part(v, chr(0), 1)), split_part(v, chr(0), 2), 'gi')"
    return f"list_reduce(list_prepend(text, {values}), lambda a, v: {step})"


_WHOLE = "regexp_replace(regexp_replace({t}, {e}, '[EMAIL]', 'g'), {p}, '[PHONE]', 'g')".format(t=_fold_sql(f"flatten({_VALUES})"), e=q(P.SANITIZE_EMAIL), p=q(P.SANITIZE_PHONE))
_SOME = "[" + ", ".join(f"list_transform({found_sql(n)}, lambda x: x || chr(0) || {q(P.PLACEHOLDERS[P.KINDS[n]])})" for n in _SPANS) + "]"
_LEFT = "len(list_filter(flatten({v}), lambda v: split_part(v, chr(0), 1) <> split_part(v, chr(0), 2) AND contains({t}, split_part(v, chr(0), 1)))) > 0"
ORACLES |= {
    "l2_find_matches": f"SELECT doc_id, type, start, end_ AS \"end\", match FROM ({_spans_sql(list(P.PATTERNS))})",
    "red_spans": f"{_KEPT} SELECT d.doc_id, coalesce(r, coalesce(d.text, '')) AS redacted, coalesce(n, 0) AS n_redactions FROM documents d LEFT JOIN (SELECT k.doc_id, string_agg(substr(text, before + 1, start - before) || {_PLACES}, '' ORDER BY k.n) || substr(first(text), max(end_) + 1) AS r, count(*) AS n FROM k JOIN documents t ON t.doc_id = k.doc_id GROUP BY k.doc_id) USING (doc_id)",
    "red_infos": f"{_KEPT} SELECT doc_id, type, match AS original_value, {_PLACES} AS replacement, start, (start + length({_PLACES}))::INTEGER AS \"end\" FROM k",
    "san_fold": "SELECT doc_id, regexp_replace(regexp_replace({t}, {e}, '[EMAIL]', 'g'), {p}, '[PHONE]', 'g') AS sanitized FROM documents".format(t=_fold_sql(f"flatten({_SOME})"), e=q(P.SANITIZE_EMAIL), p=q(P.SANITIZE_PHONE)),
    "san_string_detected": f"SELECT doc_id, {_WHOLE} AS sanitized FROM documents",
    "san_validate_detected": f"SELECT doc_id, {_leak('text')} OR {_LEFT.format(v=_VALUES, t='text')} AS leak_raw, {_leak('c')} OR {_LEFT.format(v=_VALUES, t='c')} AS leak_sanitized FROM (SELECT doc_id, text, {_WHOLE} AS c FROM documents)",
    "l2_luhn": "SELECT doc_id, candidate, " + LUHN_SQL.format(d="regexp_replace(candidate, '[^0-9]', '', 'g')") + " AS valid FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9 -]{11,22}[0-9]')) AS candidate FROM documents)",
    "l2_detect": f"SELECT doc_id, type, source, severity, count(*) AS n FROM ({_DETECTED}) GROUP BY ALL",
    "red_placeholder": f"SELECT DISTINCT doc_id, type, {_PLACE} AS placeholder FROM ({_DETECTED})",
    "red_actions": f"SELECT doc_id, 'placeholder' AS action, type, {_PLACE} AS replacement FROM ({_DETECTED})",
    "san_string": f"SELECT doc_id, {_SAN} AS sanitized FROM documents",
    "san_string_turns": f"SELECT conv_id, turn, {_SAN} AS sanitized FROM conversations",
    "san_validate_text": f"SELECT doc_id, {_leak('text')} AS leak_raw, {_leak('(' + _SAN + ')')} AS leak_sanitized FROM documents",
    "url_origin": "SELECT page_id, CASE WHEN h <> '' THEN lower(regexp_extract(url, '^([A-Za-z]+://)', 1)) || h ELSE 'unknown' END AS origin FROM (SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h FROM pages)",
    "flagship": f"""WITH f AS (SELECT doc_id, type, count(*) AS n FROM ({_DETECTED}) GROUP BY ALL), c AS (SELECT doc_id, lang, {_leak('text')} AS r, {_leak('(' + _SAN + ')')} AS s FROM documents)
SELECT lang, type, count(*) AS n_documents, sum(n)::BIGINT AS n_detections, count(*) FILTER (r) AS n_leaking_raw, count(*) FILTER (s) AS n_leaking_sanitized FROM c JOIN f USING (doc_id) GROUP BY ALL""",
}
