"""Queries over whole pages: the detection pipeline, sanitized contexts, actions, reasoning, strategies."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from piiguard.functions import actions as A, elements as E, patterns as P
from piiguard.operators import geometry as G, pages as O
from piiguard.plans import elements as EL, text as TX
from piiguard.shared import materialize

QUERIES, ORACLES = {}, {}
_E, _P, _A, _IN = EL.ELEMENTS_SQL, EL.PAGES_SQL, EL.ACTIONS_SQL, EL._IN
#: A session's allowed origins, known reasoning ids and stored values.
ORIGINS, REASONING, VALUES = ["https://example.test"], ["r1", "r2"], {"v1": "kept value", "v0": ""}
TASKS = ("Fill in the name", "Please click the button", "Enter my e-mail", "Scroll down", "Press submit", "Focus the display field and type", "Do it")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- the same in SQL ----------------------------------------------------------------------------
_SEVERE = EL._CASE("type", P.SEVERITY)
_L2 = " UNION ALL ".join(
    f"SELECT page_id, elem_idx, id, x, y, w, h, 2 AS layer, {i} * 1000 + unnest(range(1, len(f) + 1)) AS nth, '{P.KINDS[n]}' AS type, unnest(f) AS original_value FROM (SELECT *, {TX.found_sql(n)} AS f FROM ({_E}) WHERE visible)"
    for i, n in enumerate(P.PATTERNS)
)
_COLUMNS = "page_id, elem_idx, id, x, y, w, h, layer, nth, type, source, confidence, severity, original_value"
_DOM = f"""SELECT page_id, elem_idx, id, x, y, w, h, 1 AS layer, 0 AS nth, type, 'layer1_typed_field' AS source, 0.95::DOUBLE AS confidence, severity, nullif(text, '') AS original_value FROM ({EL._L1})
UNION ALL SELECT page_id, elem_idx, id, x, y, w, h, layer, nth, type, 'layer2_regex' AS source, 0.8::DOUBLE, {_SEVERE} AS severity, original_value FROM ({_L2})"""
_SEEN = f"SELECT f.page_id, elem_idx, id, x, y, w, h, 3 AS layer, 0 AS nth, 'face' AS type, 'layer3_visual' AS source, confidence, 'critical' AS severity, NULL AS original_value FROM ({EL._FACES}) f"
_DET = f"""SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY layer, elem_idx, nth) - 1)::BIGINT AS seq
FROM ({_DOM} UNION ALL {_SEEN} JOIN ({EL._GATE}) g ON g.page_id = f.page_id AND g.should_run)"""
_FIRST = f"SELECT page_id AS fp, id AS fid, min(elem_idx) AS first FROM ({_E}) WHERE id <> '' GROUP BY ALL"
_GROUPED = f"SELECT d.* EXCLUDE (elem_idx), first AS elem_idx FROM ({_DET}) d JOIN ({_FIRST}) ON fp = page_id AND fid = id"
_PLACE = EL._CASE("type", P.PLACEHOLDERS)


def tail_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, {TX.q(P.SANITIZE_EMAIL)}, '[EMAIL]', 'g'), {TX.q(P.SANITIZE_PHONE)}, '[PHONE]', 'g')"


def fold_sql(text: str, pairs: str) -> str:
    """Values to placeholders one after another; ``pairs`` is a list of value, chr(0), placeholder."""
    step = "regexp_replace(a, regexp_escape(split_part(v, chr(0), 1)), split_part(v, chr(0), 2), 'gi')"
    return tail_sql(f"list_reduce(list_prepend({text}, coalesce({pairs}, [])), lambda a, v: {step})")


_PAIRS = f"""SELECT page_id AS dp, elem_idx AS de, list(original_value || chr(0) || {_PLACE} ORDER BY seq) FILTER (trim(coalesce(original_value, '')) <> '') AS pairs, count(*) AS n, count(*) FILTER (layer = 3) AS n3,
 first({_PLACE} ORDER BY seq) AS place, list(type ORDER BY seq) AS types, list(severity) AS severities, list_distinct(list(original_value) FILTER (original_value <> '' AND original_value <> {_PLACE})) AS vals,
 string_agg(type || '/' || source, ',' ORDER BY seq) AS shown, list(original_value ORDER BY seq) AS raws FROM ({_GROUPED}) GROUP BY ALL"""
_ANNOTATED = f"SELECT e.*, coalesce(n, 0) AS n, coalesce(n3, 0) AS n3, place, pairs, types, severities, vals, shown, raws FROM ({_E}) e LEFT JOIN ({_PAIRS}) ON dp = page_id AND de = elem_idx"


class Base(NamedTuple):
    """Elements with the detections of each layer, detections by page, and the elements with the detections of their selectors."""

    elements: DataFrame
    found: DataFrame
    full: DataFrame


def base(spark, sf_dir, pages=None) -> Base:
    """The base of a query, made once and passed down: layers are run once, over the elements of ``pages`` (page_id) if given."""
    e = EL.elements(spark, sf_dir)
    if pages is not None:
        e = e.join(pages.select("page_id").distinct(), "page_id", "left_semi")
    layered = materialize(O.with_layers(e), "layered")
    found = O.detections(layered)
    slim = layered.drop("l1", "l2", "l3", "signals")
    return Base(layered, found, O.annotated(slim, O.group(slim, found)))


def clean(spark, sf_dir) -> DataFrame:
    """The sanitized records of the visible elements and the values that were detected, for queries that read them more than once."""
    return materialize(O.sanitized_deep(O.with_values(base(spark, sf_dir).full)), "clean")


# ---- detection ----------------------------------------------------------------------------------
@query(f"SELECT page_id, seq, elem_idx, type, source, confidence, severity, original_value FROM ({_DET})")
def pipe_detect(spark, sf_dir):
    """All detections of a page in order: typed fields, patterns, and faces where the gate lets vision run."""
    return O.detections(O.with_layers(EL.elements(spark, sf_dir))).select("page_id", "seq", "elem_idx", "type", "source", "confidence", "severity", "original_value")


@query(f"SELECT page_id, elem_idx, count(*) AS n, string_agg(type || '/' || source, ',' ORDER BY seq) AS detections FROM ({_GROUPED}) GROUP BY ALL")
def pipe_group(spark, sf_dir):
    e, found, _ = base(spark, sf_dir)
    shown = F.array_join(F.transform("detections", lambda d: F.concat(d["type"], F.lit("/"), d["source"])), ",")
    return O.group(e, found).select("page_id", "elem_idx", F.size("detections").cast("long").alias("n"), shown.alias("detections"))


@query(f"SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY elem_idx, seq) - 1)::BIGINT AS position, elem_idx, type, source FROM ({_GROUPED})")
def pipe_flatten(spark, sf_dir):
    e, found, _ = base(spark, sf_dir)
    return O.flat(O.group(e, found)).select("page_id", "position", "elem_idx", "type", "source")


_TARGETED = f"""SELECT d.page_id AS dp, layer, t.elem_idx AS te, coalesce(t.visible, false) AS shown, CASE WHEN t.visible AND t.tag IN {_IN(E.VISUAL_TAGS)} THEN 2 WHEN t.visible THEN 1 ELSE 0 END AS times
FROM ({_DOM} UNION ALL {_SEEN}) d LEFT JOIN ({_FIRST}) f ON fp = d.page_id AND fid = d.id LEFT JOIN ({_E}) t ON t.page_id = d.page_id AND t.elem_idx = f.first"""
_RUNS = f"""SELECT g.page_id, s.strategy, m.mode, strategy = 'unconditional_vision' OR (strategy = 'dom_gated_vision' AND should_run) AS invoked,
 CASE WHEN strategy = 'dom_only' THEN 'dom_only_strategy' ELSE reason END AS reason, coalesce(dom, 0) AS dom, coalesce(seen, 0) AS seen, coalesce(dom_redactions, 0) AS dom_redactions, coalesce(seen_redactions, 0) AS seen_redactions,
 coalesce(dom_sensitive, 0) AS dom_sensitive, coalesce(all_sensitive, 0) AS all_sensitive
FROM ({EL._GATE}) g CROSS JOIN (SELECT unnest({list(O.STRATEGIES)}) AS strategy) s CROSS JOIN (SELECT unnest({list(O.MODES)}) AS mode) m
LEFT JOIN (SELECT dp, count(*) FILTER (layer < 3) AS dom, count(*) FILTER (layer = 3) AS seen, sum(times) FILTER (layer < 3) AS dom_redactions, sum(times) FILTER (layer = 3) AS seen_redactions,
 count(DISTINCT te) FILTER (shown AND layer < 3) AS dom_sensitive, count(DISTINCT te) FILTER (shown) AS all_sensitive FROM ({_TARGETED}) GROUP BY dp) ON dp = g.page_id"""
RUNS_SQL = f"""SELECT page_id, strategy, mode, invoked, reason, CASE WHEN invoked THEN mode = 'heuristic' END AS model_success, (dom + CASE WHEN invoked AND mode = 'heuristic' THEN seen ELSE 0 END)::BIGINT AS detections,
 (dom_redactions + CASE WHEN invoked AND mode = 'heuristic' THEN seen_redactions ELSE 0 END)::BIGINT AS redactions, (CASE WHEN invoked AND mode = 'heuristic' THEN all_sensitive ELSE dom_sensitive END)::BIGINT AS sensitive FROM ({_RUNS})"""


def runs(spark, sf_dir):
    return O.strategies(O.with_layers(EL.elements(spark, sf_dir)))


@query(f"SELECT strategy, mode, count(*) AS pages, count(*) FILTER (invoked) AS invocations, sum(detections)::BIGINT AS detections, sum(redactions)::BIGINT AS redactions, sum(sensitive)::BIGINT AS sensitive, count(*) FILTER (model_success) AS model_successes FROM ({RUNS_SQL}) GROUP BY ALL")
def strat_run(spark, sf_dir):
    n = [F.sum(c).cast("long").alias(c) for c in ("detections", "redactions", "sensitive")]
    counts = [F.count("*").alias("pages"), F.count_if("invoked").alias("invocations"), *n, F.count_if("model_success").alias("model_successes")]
    return runs(spark, sf_dir).groupBy("strategy", "mode").agg(*counts)


@query(f"SELECT page_id, elem_idx, x, y, w, h FROM ({_DET}) WHERE x IS NOT NULL")
def vis_regions_from_det(spark, sf_dir):
    """The regions to redact: the boxes of the detections that have one."""
    return base(spark, sf_dir)[1].where("x IS NOT NULL").select("page_id", "elem_idx", "x", "y", "w", "h")


@query(f"""SELECT r.page_id, r.elem_idx, count(*) AS detections FROM ({_E}) r JOIN ({_DET}) d ON d.page_id = r.page_id AND r.x < d.x + d.w AND d.x < r.x + r.w AND r.y < d.y + d.h AND d.y < r.y + r.h
WHERE r.region IS NOT NULL GROUP BY ALL""")
def vis_perceive(spark, sf_dir):
    """Visual regions with the number of detections that overlap them; regions with none go."""
    e, found, _ = base(spark, sf_dir)
    regions = e.where(O.region().isNotNull()).select("page_id", "elem_idx", *[F.col(c).alias(f"a{c}") for c in "xywh"])
    boxes = found.select("page_id", *[F.col(c).alias(f"b{c}") for c in "xywh"])
    return G.overlapping(regions, boxes).groupBy("page_id", "elem_idx").agg(F.count("*").alias("detections"))


# ---- contexts -----------------------------------------------------------------------------------
_TEXT = "nullif(text, '')"
_CLEAN = f"SELECT * REPLACE (CASE WHEN text <> '' THEN {fold_sql('text', 'pairs')} END AS text, {fold_sql('aria_label', 'pairs')} AS aria_label, {fold_sql('alt', 'pairs')} AS alt, {fold_sql('placeholder', 'pairs')} AS placeholder), CASE WHEN tag = 'INPUT' AND text <> '' THEN {fold_sql('text', 'pairs')} END AS value FROM ({_ANNOTATED}) WHERE visible"
_FIRST_PLACE = f"list_transform(raws, lambda v, i: CASE WHEN v IS NULL OR v = '' THEN v ELSE list_transform(types, lambda type: {_PLACE})[list_position(raws, v)] END)"


@query(f"SELECT page_id, elem_idx, text, nullif(aria_label, '') AS aria_label, value, nullif(alt, '') AS alt, CASE WHEN n > 0 THEN coalesce(array_to_string({_FIRST_PLACE}, ','), '') END AS originals FROM ({_CLEAN})")
def san_deep(spark, sf_dir):
    """Every string of an element's record sanitized: text, labels, attribute values, the detections' own values."""
    clean = O.sanitized_deep(base(spark, sf_dir)[2])
    originals = F.when(F.size("detections") > 0, F.array_join(F.transform("detections", lambda d: d["original_value"]), ","))
    return clean.select("page_id", "elem_idx", "text", "aria_label", O.attribute("value").alias("value"), O.attribute("alt").alias("alt"), originals.alias("originals"))


_VISUAL = f"tag IN {_IN(E.VISUAL_TAGS)}"
_DESCRIBED = "lower(tag) || ' element' || CASE WHEN alt <> '' THEN ' with alt=\"' || alt || '\"' ELSE '' END || CASE WHEN src <> '' THEN ' src=\"' || src[:50] || '\"' ELSE '' END"


@query(f"SELECT page_id, elem_idx, x, y, w, h, {_DESCRIBED} AS description, n3 > 0 AS requires_vision_model FROM ({_CLEAN}) WHERE {_VISUAL}")
def san_visual_meta(spark, sf_dir):
    clean = O.sanitized_deep(base(spark, sf_dir)[2]).where(O.is_visual())
    vision = F.exists("detections", lambda d: d["source"] == P.SOURCES[3])
    return clean.select("page_id", "elem_idx", "x", "y", "w", "h", O.visual_description().alias("description"), vision.alias("requires_vision_model"))


_ATTRS = "concat_ws(' ', {0}, CASE WHEN tag = 'INPUT' THEN nullif({1}, '') END, nullif({2}, ''), nullif({3}, ''), nullif({4}, ''))"
_CHECKED = """SELECT p.page_id, coalesce(email, false) AS email, coalesce(phone, false) AS phone, coalesce(residual, false) AS residual, coalesce(password_text, false) AS password_text, coalesce(password_value, false) AS password_value
FROM ({pages}) p LEFT JOIN (SELECT page_id AS cp, bool_or(regexp_matches(s, {mail})) AS email, bool_or(regexp_matches(s, {phone})) AS phone,
 list_bool_or(list_transform(flatten(list(vals)), lambda v: contains(string_agg(s, chr(1)), v))) AS residual, bool_or(no_text) AS password_text, bool_or(no_value) AS password_value FROM ({rows}) GROUP BY page_id) ON cp = p.page_id"""


def _checks(elements: str, value: str) -> str:
    rows = f"""SELECT page_id, coalesce(vals, []) AS vals, {_ATTRS.format(_TEXT, value, 'aria_label', 'alt', 'placeholder')} AS s,
 coalesce(list_contains(types, 'password'), false) AND coalesce(text, '') <> '' AND NOT contains(coalesce(text, ''), '[PASSWORD]') AS no_text,
 kind = 'password' AND coalesce({value}, '') <> '' AND NOT contains(coalesce({value}, ''), '[PASSWORD]') AS no_value FROM ({elements})"""
    return _CHECKED.format(pages=_P, rows=rows, mail=TX.q(P.SANITIZE_EMAIL), phone=TX.q(P.LEAK_PHONE)).replace("list_bool_or(", "list_contains(").replace("string_agg(s, chr(1)), v))) AS residual", "string_agg(s, chr(1)), v)), true) AS residual")


_RAW_CHECKS = _checks(f"SELECT * FROM ({_ANNOTATED}) WHERE visible", "text")
_CLEAN_CHECKS = _checks(_CLEAN, "value")
_OK = "NOT ({0}email OR {0}phone OR {0}residual OR {0}password_text OR {0}password_value)"


@query(f"SELECT r.*, {_OK.format('r.')} AS valid_raw, {_OK.format('c.')} AS valid_sanitized FROM ({_RAW_CHECKS}) r JOIN ({_CLEAN_CHECKS}) c USING (page_id)")
def san_validate(spark, sf_dir):
    """The five leak checks of raw contexts, and the verdict on raw and sanitized ones."""
    full = materialize(O.with_values(base(spark, sf_dir).full.where("visible")), "full")
    pages = EL.pages(spark, sf_dir)
    raw = O.leak_checks(full, pages).withColumnRenamed("valid", "valid_raw")
    return raw.join(O.merged(O.leak_checks(O.sanitized_deep(full), pages).select("page_id", F.col("valid").alias("valid_sanitized"))), "page_id")


@query(f"""SELECT p.page_id, 'https://' || CASE WHEN p.page_id % 11 = 0 THEN 'evil.test' ELSE 'example.test' END AS url, coalesce(k, 0) AS n_elements, coalesce(v, 0) AS n_regions, coalesce(d, 0)::BIGINT AS placeholders, coalesce(m, 0)::BIGINT AS masks, {_OK.format('c.')} AS valid
FROM ({_P}) p JOIN ({_CLEAN_CHECKS}) c USING (page_id) LEFT JOIN (SELECT page_id AS cp, count(*) AS k, count(*) FILTER ({_VISUAL}) AS v, sum(n) AS d, sum(n) FILTER ({_VISUAL}) AS m FROM ({_CLEAN}) GROUP BY page_id) ON cp = p.page_id""")
def san_context(spark, sf_dir):
    """A context a page: how many elements and regions it holds, its redactions, and whether it leaks nothing."""
    out = O.context(clean(spark, sf_dir), EL.pages(spark, sf_dir))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.select("page_id", "url", size("elements").alias("n_elements"), size("visual_regions").alias("n_regions"), "placeholders", "masks", "valid")


_LABEL = "coalesce(nullif(text, ''), nullif(aria_label, ''), nullif(name, ''), nullif(placeholder, ''), '')"
_CONTEXT_ROLE = f"coalesce({EL._CASE('tag', E.CONTEXT_ROLES)}, lower(tag))"
_SAFE_LABEL = fold_sql(f"CASE WHEN n > 0 THEN place ELSE {_LABEL} END", "pairs")
_STRUCTURED = f"SELECT page_id, elem_idx, 'element-' || (row_number() OVER (PARTITION BY page_id ORDER BY elem_idx) - 1) AS id, {_CONTEXT_ROLE} AS role, {_SAFE_LABEL} AS label, n > 0 AS sensitive, x, y, w, h FROM ({_ANNOTATED}) WHERE visible"


@query(f"SELECT page_id, id, role, label, sensitive, x, y, w, h FROM ({_STRUCTURED})")
def san_structured(spark, sf_dir):
    return O.structured(base(spark, sf_dir)[2])


@query(f"SELECT page_id, id, label FROM ({_STRUCTURED})")
def san_label(spark, sf_dir):
    return O.structured(base(spark, sf_dir)[2]).select("page_id", "id", "label")


# ---- actions ------------------------------------------------------------------------------------
_JSON = lambda k: f"CASE WHEN json_valid(raw) THEN json_type(raw, '$.{k}') END"
_GET = lambda k: f"CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.{k}') END"
_FORMED = f"""coalesce(json_type(CASE WHEN json_valid(raw) THEN raw END) = 'OBJECT' AND len(list_filter(json_keys(CASE WHEN json_valid(raw) THEN raw END), lambda k: k NOT IN {_IN(A.ACTION_KEYS)})) = 0
 AND {_JSON('action')} = 'VARCHAR' AND {_JSON('target')} = 'VARCHAR' AND {_JSON('reasoning_id')} = 'VARCHAR'
 AND coalesce({_JSON('parameters')}, 'OBJECT') IN ('OBJECT', 'ARRAY') AND coalesce({_JSON('value_ref')}, 'VARCHAR') = 'VARCHAR', false)"""


def parts_sql(actions: str) -> str:
    return f"SELECT action_id, page_id, raw, {_FORMED} AS formed, {', '.join(f'{_GET(k)} AS {k}' for k in ('action', 'target', 'reasoning_id', 'value_ref'))} FROM ({actions})"


_PARTS = parts_sql(_A)
_ID, _ATTR = "target LIKE '#%' AND e.id <> '' AND target = '#' || e.id", "target = '[{0}]' AND coalesce({1}, '') <> '' OR target = '[{0}=\"' || {1} || '\"]' AND coalesce({1}, '') <> ''"
_MEETS = f"({_ID}) OR target = lower(e.tag) OR " + " OR ".join(f"({_ATTR.format(k, 'e.' + c)})" for k, c in (EL.ATTRIBUTES | EL.FLAGS).items())


def met_sql(parts: str) -> str:
    """The number of elements that each asked selector meets on its page."""
    return f"""SELECT page_id AS mp, t AS mt, count(elem_idx) AS n, first(elem_idx) AS elem_idx FROM (SELECT DISTINCT p.page_id, p.target AS t, e.elem_idx
 FROM (SELECT DISTINCT page_id, target FROM ({parts})) p JOIN ({_E}) e ON e.page_id = p.page_id AND ({_MEETS})) GROUP BY ALL"""


_MET = met_sql(_PARTS)
_SENSITIVE = f"""SELECT page_id AS sp, elem_idx AS se, visible, coalesce(disabled IN ('true', ''), false) OR coalesce(readonly IN ('true', ''), false) OR coalesce(aria_disabled = 'true', false) AS off,
 coalesce(list_has_any(types, {list(E.SENSITIVE_TYPES)}), false) OR (form_id <> '' AND bool_or(coalesce(list_has_any(severities, ['high', 'critical']), false)) OVER (PARTITION BY page_id, form_id)) AS sensitive FROM ({_ANNOTATED})"""


def valid_sql(actions: str) -> str:
    """Raw actions with the first check that each fails."""
    parts = parts_sql(actions)
    return f"""SELECT action_id, a.page_id, action, target, CASE WHEN a.page_id % 11 = 0 THEN 'ORIGIN_MISMATCH' WHEN NOT formed THEN 'INVALID_SCHEMA' WHEN action NOT IN {_IN(A.ACTION_TYPES)} THEN 'UNSUPPORTED_ACTION'
 WHEN reasoning_id NOT IN {_IN(REASONING)} THEN 'MISSING_REASONING_ID' WHEN n IS NULL THEN 'TARGET_NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS_TARGET' WHEN NOT visible THEN 'INVISIBLE_TARGET' WHEN off THEN 'DISABLED_TARGET'
 WHEN sensitive THEN 'SENSITIVE_ACTION' WHEN coalesce(value_ref, '') NOT IN ('', 'v1') THEN 'INVALID_VALUE_REF' END AS reason
FROM ({parts}) a LEFT JOIN ({met_sql(parts)}) ON mp = a.page_id AND mt = target LEFT JOIN ({_SENSITIVE}) ON sp = a.page_id AND se = elem_idx"""


VALID_SQL = valid_sql(_A)


def validated(spark, sf_dir, actions=None, reasoning=tuple(REASONING), values=None, full=None):
    """Raw actions with the first check that each fails; of the pages, only those that actions name are annotated.

    The log's own actions name a hundred pages at most.
    """
    few = actions is None
    actions = EL.actions(spark, sf_dir) if few else actions
    full = base(spark, sf_dir, actions).full if full is None else full
    return O.validate(actions, full, EL.pages(spark, sf_dir), origins=ORIGINS, reasoning_ids=list(reasoning), values=VALUES if values is None else values, few_pages=few)


@query(f"SELECT action_id, page_id, action, target, reason IS NULL AS valid, reason FROM ({VALID_SQL})")
def val_action(spark, sf_dir):
    """Raw actions of the log with the first check that each fails."""
    return validated(spark, sf_dir)


@query(f"SELECT action, reason, count(*) AS n FROM ({VALID_SQL}) GROUP BY ALL")
def val_summary(spark, sf_dir):
    return validated(spark, sf_dir).groupBy("action", "reason").agg(F.count("*").alias("n"))


def _parts(spark, sf_dir):
    return A.parsed(EL.actions(spark, sf_dir))


def _check(spark, sf_dir, valid):
    return _parts(spark, sf_dir).select("action_id", valid.alias("valid"))


_field = F.col


@query(f"SELECT action_id, page_id % 11 <> 0 AS valid FROM ({_A})")
def val_origin(spark, sf_dir):
    joined = EL.actions(spark, sf_dir).join(EL.pages(spark, sf_dir).select("page_id", P.url_origin(F.col("url")).alias("origin")), "page_id", "left")
    return joined.select("action_id", F.col("origin").isin(*ORIGINS).alias("valid"))


@query(f"SELECT action_id, formed AS valid FROM ({_PARTS})")
def val_schema(spark, sf_dir):
    return _check(spark, sf_dir, F.coalesce("formed", F.lit(False)))


@query(f"SELECT action_id, coalesce(action IN {_IN(A.ACTION_TYPES)}, false) AS valid FROM ({_PARTS})")
def val_type(spark, sf_dir):
    return _check(spark, sf_dir, F.coalesce(_field("action").isin(*A.ACTION_TYPES), F.lit(False)))


@query(f"SELECT action_id, coalesce(reasoning_id IN {_IN(REASONING)}, false) AS valid FROM ({_PARTS})")
def val_reasoning(spark, sf_dir):
    return _check(spark, sf_dir, F.coalesce(_field("reasoning_id").isin(*REASONING), F.lit(False)))


@query(f"SELECT action_id, coalesce(value_ref, '') IN ('', 'v1') AS valid FROM ({_PARTS})")
def val_value_ref(spark, sf_dir):
    ref = F.coalesce(_field("value_ref"), F.lit(""))
    return _check(spark, sf_dir, ref.isin("", *[k for k, v in VALUES.items() if v]))


@query(f"SELECT action_id, false AS found FROM ({_A}) WHERE false")
def val_unexpected(spark, sf_dir):
    """Actions that pass the schema check with a key that it does not know: none, as the check rejects them first."""
    return _parts(spark, sf_dir).where(F.col("formed") & (F.size("unknown") > 0)).select("action_id", F.lit(True).alias("found"))


@query(f"SELECT p.page_id, p.target, CASE WHEN n IS NULL THEN 'TARGET_NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS_TARGET' END AS reason FROM (SELECT DISTINCT page_id, target FROM ({_PARTS}) WHERE target IS NOT NULL) p LEFT JOIN ({_MET}) ON mp = page_id AND mt = target")
def val_resolve(spark, sf_dir):
    """Targets by selector: an equality join of the selector's key with the keys of the page's elements."""
    e = EL.elements(spark, sf_dir)
    keys = e.select("page_id", F.explode(F.array_distinct(A.element_keys(F.col("tag"), F.col("attributes")))).alias("key")).groupBy("page_id", "key").agg(F.count("*").alias("n"))
    asked = _parts(spark, sf_dir).select("page_id", "target").where("target IS NOT NULL").distinct()
    met = asked.withColumn("key", A.selector_key(F.col("target"))).join(keys, ["page_id", "key"], "left")
    return met.select("page_id", "target", F.when(F.col("n").isNull(), "TARGET_NOT_FOUND").when(F.col("n") > 1, "AMBIGUOUS_TARGET").alias("reason"))


@query(f"SELECT page_id, elem_idx, visible AS valid FROM ({_E})")
def val_visible(spark, sf_dir):
    return EL.elements(spark, sf_dir).select("page_id", "elem_idx", F.col("visible").alias("valid"))


@query(f"SELECT sp AS page_id, se AS elem_idx, NOT off AS enabled FROM ({_SENSITIVE})")
def val_enabled(spark, sf_dir):
    off = A.disabled(O.attribute("disabled"), O.attribute("readonly"), O.attribute("aria-disabled"))
    return EL.elements(spark, sf_dir).select("page_id", "elem_idx", (~off).alias("enabled"))


@query(f"SELECT sp AS page_id, se AS elem_idx, sensitive FROM ({_SENSITIVE})")
def val_sensitive(spark, sf_dir):
    """Elements with sensitive detections of their own, or in a form that holds high or critical ones."""
    full = base(spark, sf_dir)[2]
    own = F.exists("detections", lambda d: d["type"].isin(*E.SENSITIVE_TYPES))
    hot = F.bool_or(F.exists("detections", lambda d: d["severity"].isin("high", "critical"))).over(O.Window.partitionBy("page_id", "form_id"))
    return full.select("page_id", "elem_idx", (own | ((F.col("form_id") != "") & hot)).alias("sensitive"))


@query(f"""SELECT p.page_id, 'https://' || CASE WHEN p.page_id % 11 = 0 THEN 'evil.test' ELSE 'example.test' END AS origin, count(elem_idx) AS elements,
 coalesce(bool_or(tag = 'FORM' AND coalesce(list_has_any(severities, ['high', 'critical']), false)), false) AS sensitive_form_detected FROM ({_P}) p LEFT JOIN ({_ANNOTATED}) a ON a.page_id = p.page_id GROUP BY p.page_id""")
def val_context(spark, sf_dir):
    return O.validation_context(base(spark, sf_dir)[2], EL.pages(spark, sf_dir))


_MINE = lambda test: f"coalesce(first(nullif(id, '') ORDER BY elem_idx) FILTER ({test}), CASE WHEN count(*) FILTER ({test}) = 0 THEN first(nullif(id, '') ORDER BY elem_idx) END"
_SECRET = "coalesce(list_has_any(types, ['password', 'credit_card', 'ssn']), false)"
_KINDS = {
    "click": ("visible AND (tag IN ('BUTTON', 'A') OR coalesce(role, '') = 'button')", "submit-btn"),
    "fill": (f"visible AND tag IN ('INPUT', 'TEXTAREA') AND kind <> 'password' AND NOT {_SECRET}", "email-field"),
    "scroll": ("tag = 'DIV'", "scrollable-area"), "secret": (_SECRET, "password-field"), "hidden": ("NOT visible", "hidden-element"), "off": ("coalesce(disabled IN ('true', ''), false)", "disabled-btn"),
}
_TARGETS = ", ".join(f"'#' || {_MINE(test)}, '{name}') AS t_{k}" for k, (test, name) in _KINDS.items())
# The canned actions as JSON, for the SQL.
_MOCKS = (
    ("valid_click", "click", "t_click", ""), ("valid_fill", "fill", "t_fill", ',"value_ref":"[EMAIL_FIELD_1]"'), ("valid_scroll", "scroll", "t_scroll", ',"parameters":{"direction":"down","amount_px":400}'),
    ("malformed", "click", None, ""), ("nonexistent_target", "click", "'#nonexistent-element'", ""), ("stale", "click", "t_secret", ""), ("sensitive_field", "fill", "t_secret", ',"value_ref":"[PASSWORD_FIELD_1]"'),
    ("invalid_value_ref", "fill", "t_fill", ',"value_ref":"[UNKNOWN_REF]"'), ("wrong_origin", "click", "'#submit-btn'", ""), ("invisible_target", "click", "t_hidden", ""), ("disabled_target", "click", "t_off", ""),
    ("unknown_type", "navigate", "'#some-element'", ""), ("unexpected_fields", "click", "'#submit-btn'", ',"extra_field":"malicious-data"'),
)


def _mock(action: str, target: str | None, more: str) -> str:
    aim = f""" || ',"target":"' || {target} || '"'""" if target else ""
    return f"""'{{"action":"{action}"'{aim} || ',"reasoning_id":"reasoning-123"{more}}}'"""


_MOCK_ROWS = " UNION ALL ".join(f"SELECT page_id, {i} AS n, '{name}' AS name, {_mock(a, t, more)} AS raw FROM t" for i, (name, a, t, more) in enumerate(_MOCKS))


@query(f"WITH t AS (SELECT page_id, {_TARGETS} FROM ({_ANNOTATED}) GROUP BY page_id) {_MOCK_ROWS}")
def src_mock_actions(spark, sf_dir):
    """Thirteen canned actions a page, as raw JSON."""
    return O.mock_actions(base(spark, sf_dir)[2])


@query()
def val_mock_actions(spark, sf_dir):
    """The canned actions through the validator."""
    full = materialize(base(spark, sf_dir).full, "full")
    mocks = O.mock_actions(full)
    asked = mocks.select(F.concat_ws("/", F.col("page_id").cast("string"), "name").alias("action_id"), "page_id", "raw")
    return validated(spark, sf_dir, asked, ("reasoning-123", "reasoning-456"), {"[EMAIL_FIELD_1]": "alice@example.test"}, full)


# ---- reasoning ----------------------------------------------------------------------------------
_RSN = f"""SELECT *, 'element-' || (row_number() OVER (PARTITION BY page_id ORDER BY elem_idx) - 1) AS eid, {_LABEL} AS plain,
 interactive AND tag IN ('INPUT', 'TEXTAREA') AND coalesce(nullif(lower(kind), ''), 'text') NOT IN ('password', 'email', 'tel') AND lower(autocomplete) NOT IN {_IN(O.NEVER_FILLED)} AS fillable,
 interactive AND (tag = 'BUTTON' OR (tag = 'INPUT' AND lower(kind) IN ('submit', 'button'))) AS pressable FROM ({_CLEAN})"""


def seen(spark, sf_dir):
    return O.reasoning_input(O.sanitized_deep(base(spark, sf_dir)[2]))


@query(f"SELECT page_id, eid AS id, {_CONTEXT_ROLE} AS role, plain AS label, n > 0 AS sensitive, interactive FROM ({_RSN})")
def rsn_input(spark, sf_dir):
    return seen(spark, sf_dir).select("page_id", "id", "role", "label", "sensitive", "interactive")


@query(f"SELECT page_id, elem_idx FROM ({_RSN}) WHERE fillable")
def rsn_nonsensitive(spark, sf_dir):
    return seen(spark, sf_dir).where(O.is_fillable()).select("page_id", "elem_idx")


@query(f"SELECT page_id, min(elem_idx) FILTER (pressable) AS submit, min(elem_idx) FILTER (fillable) AS fillable FROM ({_RSN}) GROUP BY page_id")
def rsn_submit(spark, sf_dir):
    """The first button and the first field that may be filled."""
    first = lambda c: F.min(F.when(c, F.col("elem_idx")))
    return seen(spark, sf_dir).groupBy("page_id").agg(first(O.is_submit()).alias("submit"), first(O.is_fillable()).alias("fillable"))


_HINTED = {h: f"fillable AND contains(lower(name || chr(10) || id || chr(10) || placeholder || chr(10) || aria_label), '{h}')" for h in O.HINTS}
_AIM = ", ".join(f"first(id ORDER BY elem_idx) FILTER ({test}) AS {name}, count(*) FILTER ({test}) > 0 AS has_{name}" for name, test in [("f", "fillable"), ("s", "pressable"), *[(f"f_{h}", t) for h, t in _HINTED.items()]])
_SAYS = lambda *w: "(" + " OR ".join(f"contains(t, '{x}')" for x in w) + ")"
_BEST = "coalesce(CASE " + " ".join(f"WHEN contains(t, '{h}') THEN f_{h}" for h in O.HINTS) + " END, f)"
_DECIDED = f"""SELECT page_id, task, CASE WHEN ({_SAYS('fill', 'enter', 'type', 'input')} OR NOT ({_SAYS('click', 'submit', 'press')} OR {_SAYS('scroll')} OR {_SAYS('focus')})) AND coalesce(has_f, false) THEN 'fill:' || {_BEST}
 WHEN {_SAYS('click', 'submit', 'press')} AND coalesce(has_s, false) THEN 'click:' || s WHEN coalesce(has_f, false) THEN 'fill:' || f WHEN coalesce(has_s, false) THEN 'click:' || s ELSE 'wait' END AS c
FROM (SELECT p.page_id, task, lower(task) AS t, a.* EXCLUDE (page_id) FROM ({_P}) p CROSS JOIN (SELECT unnest({list(TASKS)}) AS task) LEFT JOIN (SELECT page_id, {_AIM} FROM ({_RSN}) GROUP BY page_id) a ON a.page_id = p.page_id)"""


@query(f"SELECT page_id, task, split_part(c, ':', 1) AS action, CASE WHEN c <> 'wait' THEN '#' || split_part(c, ':', 2) END AS target FROM ({_DECIDED})")
def rsn_decide(spark, sf_dir):
    """The action that each task asks for on each page: fill by hint, click, or what the page allows, else wait."""
    tasks = EL.pages(spark, sf_dir).select("page_id", F.explode(F.array(*map(F.lit, TASKS))).alias("task"))
    return O.decide(seen(spark, sf_dir), tasks)
