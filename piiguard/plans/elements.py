"""Queries over page elements, layers one and three, the vision gate and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from piiguard.functions import elements as E
from piiguard.operators import pages as O
from piiguard.plans import inputs as I

QUERIES, ORACLES = {}, {}
_STR = lambda x: "'" + x + "'"
_IN = lambda xs: "(" + ", ".join(map(_STR, xs)) + ")"
_HAS = lambda col, xs: "(" + " OR ".join(f"contains({col}, '{x}')" for x in xs) + ")"
_CASE = lambda col, table: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"

#: Attributes of made elements: name and column.
ATTRIBUTES = {
    "id": "id", "name": "name", "class": "cls", "type": "kind", "autocomplete": "autocomplete", "role": "role", "src": "src", "alt": "alt", "accept": "accept", "aria-label": "aria_label",
    "placeholder": "placeholder", "tabindex": "tabindex", "contenteditable": "editable", "xmlns": "xmlns", "r": "radius", "d": "path",
}
#: Attributes that count where they are there, even if they are empty.
FLAGS = {"disabled": "disabled", "readonly": "readonly", "aria-disabled": "aria_disabled"}


def _dealt(spark, table, key: str):
    """A narrow table dealt by its key before its rows are multiplied, into as many parts as shuffles make.

    What is made of a row stays with it, so windows and groups by the key need no shuffle of the many wide rows.
    """
    return table.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)


def _sql(spark, sf_dir, text: str, *tables: str, dealt_by: str | None = None):
    text = text.replace("\\", "\\\\")  # Spark's string literals take a backslash for an escape
    text = text.replace("{", "{{").replace("}", "}}")
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(text, **{t: _dealt(spark, df, dealt_by) if dealt_by else df for t, df in read.items()})


def customers(spark, sf_dir):
    """The customers dealt by key: their file may be one split, and what is made of each takes long."""
    return _dealt(spark, spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey")


def raw_elements(spark, sf_dir):
    """The made elements as a browser would give them: style and box by columns."""
    return _sql(spark, sf_dir, I.ELEMENTS, "customer", dealt_by="c_custkey")


def hidden_rule():
    """Columns offscreen and visible of the made elements."""
    x, y, w, h = (F.col(c) for c in "xywh")
    off = E.offscreen(F.col("position"), F.col("css_left"), F.col("css_top"), F.col("transform"), x, y, w, h)
    visibility = F.when(F.col("style") == "hidden", "hidden").otherwise("visible")
    return off, E.visible(F.col("display"), visibility, F.col("opacity"), w, h, off)


def elements(spark, sf_dir):
    """The made elements in the form that the page operators read."""
    raw = raw_elements(spark, sf_dir)
    given = [F.struct(F.lit(k).alias("key"), F.nullif(F.col(c), F.lit("")).alias("value")) for k, c in ATTRIBUTES.items()]
    given += [F.struct(F.lit(k).alias("key"), F.col(c).alias("value")) for k, c in FLAGS.items()]
    given.append(F.struct(F.lit("value").alias("key"), F.when(F.col("tag") == "INPUT", F.nullif("text", F.lit(""))).alias("value")))
    attributes = F.map_from_entries(F.filter(F.array(*given), lambda e: e["value"].isNotNull()))
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    interactive = E.interactive(F.col("tag"), F.col("role"), F.col("tabindex"), F.col("editable"))
    return raw.select(
        "page_id", "elem_idx", F.when(F.col("id") != "", F.concat(F.lit("#"), "id")).alias("selector"), "tag", attributes.alias("attributes"), blank("text"), blank("aria_label"), blank("label_text"),
        "form_id", hidden_rule()[1].alias("visible"), interactive.alias("interactive"), "x", "y", "w", "h", "svg_idx",
    )


def pages(spark, sf_dir):
    return _sql(spark, sf_dir, I.PAGES, "customer")


def actions(spark, sf_dir):
    return _sql(spark, sf_dir, I.ACTIONS, "events", dealt_by="event_id")


def boxes(spark, sf_dir, dealt_by: str | None = None):
    return _sql(spark, sf_dir, I.BOXES, "lineitem", dealt_by=dealt_by)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- the same in SQL ----------------------------------------------------------------------------
_TRANSLATE = r"translate\(?\s*(-?\d+(?:\.\d+)?)px?\s*,\s*(-?\d+(?:\.\d+)?)px?\s*\)?"
_MOVED = " OR ".join(f"coalesce(abs(try_cast(nullif(regexp_extract(transform, '{_TRANSLATE}', {n}), '') AS DOUBLE)) > {far}, false)" for n, far in ((1, 2048), (2, 1536)))
_OFF = f"(position IN ('absolute', 'fixed') AND (css_left < -1024 OR css_top < -768 OR css_left > 2048 OR css_top > 1536) OR {_MOVED} OR x + w <= 0 OR y + h <= 0 OR x >= 1024 OR y >= 768)"
_VISIBLE = f"NOT (display = 'none' OR style = 'hidden' OR opacity = '0' OR (w = 0 AND h = 0) OR {_OFF})"
_ROLE = f"coalesce(nullif(role, ''), {_CASE('tag', E.IMPLICIT_ROLES)})"
_ACTIVE = f"(tag IN {_IN(E.INTERACTIVE_TAGS)} OR coalesce(role IN {_IN(E.INTERACTIVE_ROLES)}, false) OR coalesce(tabindex <> '-1', false) OR coalesce(editable <> 'false', false))"
_REGION = f"CASE WHEN {_VISIBLE} AND w <> 0 AND h <> 0 THEN coalesce({_CASE('tag', E.REGIONS)}, CASE WHEN contains(xmlns, 'svg') THEN 'svg' END) END"
_RAW = I.ELEMENTS.replace("AS STRING)", "AS VARCHAR)")
ELEMENTS_SQL = f"SELECT *, {_VISIBLE} AS visible, {_OFF} AS offscreen, {_ACTIVE} AS interactive, {_ROLE} AS full_role, {_REGION} AS region FROM ({_RAW})"
PAGES_SQL, ACTIONS_SQL, BOXES_SQL = I.PAGES, I.ACTIONS, I.BOXES
_TYPED = " ".join(
    f"WHEN tag IN ('INPUT', 'TEXTAREA') AND ({(f'(tag = {_STR('INPUT')} AND kind = {_STR(t)}) OR ' if t else '') + _HAS('lower(autocomplete)', tokens)}) THEN '{n}|{s}|l1_{n}'"
    for n, s, t, tokens in E.TYPED_RULES
)
_LABELLED = " ".join(f"WHEN contains(lower(aria_label || ' ' || label_text), '{w}') THEN '{n}|high|l1_label'" for w, n in E.LABEL_RULES)
_L1 = f"""SELECT page_id, elem_idx, id, form_id, text, x, y, w, h, split_part(r, '|', 1) AS type, split_part(r, '|', 2) AS severity, split_part(r, '|', 3) AS rule
FROM (SELECT *, CASE {_TYPED} WHEN coalesce(full_role IN ('password', 'searchbox'), false) THEN 'password|critical|l1_role' {_LABELLED} END AS r FROM ({ELEMENTS_SQL}) WHERE visible) WHERE r IS NOT NULL"""


@query(f"SELECT page_id, elem_idx, {_ROLE} AS role FROM ({_RAW})")
def el_role(spark, sf_dir):
    return raw_elements(spark, sf_dir).select("page_id", "elem_idx", E.role_of(F.col("tag"), F.col("role")).alias("role"))


@query(f"SELECT page_id, elem_idx, {_ACTIVE} AS interactive FROM ({_RAW})")
def el_interactive(spark, sf_dir):
    return raw_elements(spark, sf_dir).select("page_id", "elem_idx", E.interactive(F.col("tag"), F.col("role"), F.col("tabindex"), F.col("editable")).alias("interactive"))


@query(f"SELECT page_id, elem_idx, CASE WHEN tag = 'INPUT' THEN coalesce(nullif(kind, ''), 'text') END AS input_type, nullif(autocomplete, '') AS autocomplete FROM ({_RAW})")
def el_input_type(spark, sf_dir):
    kind = F.when(F.col("tag") == "INPUT", F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("text")))
    return raw_elements(spark, sf_dir).select("page_id", "elem_idx", kind.alias("input_type"), F.nullif(F.col("autocomplete"), F.lit("")).alias("autocomplete"))


_FIELD = "tag IN ('INPUT', 'TEXTAREA', 'SELECT', 'BUTTON')"


@query(f"SELECT page_id, elem_idx, CASE WHEN {_FIELD} THEN 200.0 ELSE 100.0 END::DOUBLE AS width, CASE WHEN {_FIELD} THEN 30.0 ELSE 20.0 END::DOUBLE AS height FROM ({_RAW})")
def el_bbox(spark, sf_dir):
    """Boxes of pages without layout: fields are 200 by 30, all else 100 by 20."""
    width, height = E.default_box(F.col("tag"))
    return raw_elements(spark, sf_dir).select("page_id", "elem_idx", width.alias("width"), height.alias("height"))


@query(f"SELECT page_id, elem_idx, offscreen, (x >= 0 AND y >= 0 AND x + w <= 1024 AND y + h <= 768) AS in_viewport, visible FROM ({ELEMENTS_SQL})")
def el_visible(spark, sf_dir):
    off, shown = hidden_rule()
    inside = E.in_viewport(*(F.col(c) for c in "xywh"))
    return raw_elements(spark, sf_dir).select("page_id", "elem_idx", off.alias("offscreen"), inside.alias("in_viewport"), shown.alias("visible"))


def l1(spark, sf_dir):
    e = raw_elements(spark, sf_dir).where(hidden_rule()[1])
    label = F.concat(F.col("aria_label"), F.lit(" "), F.col("label_text"))
    d = E.typed_field(F.col("tag"), F.when(F.col("tag") == "INPUT", F.col("kind")), F.col("autocomplete"), E.role_of(F.col("tag"), F.col("role")), label)
    return e.select("page_id", "elem_idx", d.alias("d")).where("d IS NOT NULL").select("page_id", "elem_idx", "d.*")


@query(f"SELECT page_id, elem_idx, type, severity, rule FROM ({_L1})")
def l1_detect(spark, sf_dir):
    return l1(spark, sf_dir)


for _rule in [f"l1_{r[0]}" for r in E.TYPED_RULES] + ["l1_role", "l1_label"]:
    QUERIES[_rule] = lambda spark, sf_dir, r=_rule: l1(spark, sf_dir).where(F.col("rule") == r).select("page_id", "elem_idx", "type", "severity")
    ORACLES[_rule] = f"SELECT page_id, elem_idx, type, severity FROM ({_L1}) WHERE rule = '{_rule}'"

_WORDS = "lower(src || ' ' || alt || ' ' || cls || ' ' || id)"
_SIGNALS = " UNION ALL ".join(
    [f"SELECT page_id, elem_idx, region || '_element' AS signal FROM ({ELEMENTS_SQL}) WHERE region IS NOT NULL"]
    + [f"SELECT page_id, elem_idx, '{k}_keyword' AS signal FROM ({ELEMENTS_SQL}) WHERE region IS NOT NULL AND contains({_WORDS}, '{w}')" for k, ws in E.GATE_KEYWORDS.items() for w in ws]
    + [f"SELECT page_id, elem_idx, 'upload_control' AS signal FROM ({ELEMENTS_SQL}) WHERE visible AND tag = 'INPUT' AND kind = 'file' AND (contains(accept, 'image/') OR contains(accept, 'video/'))"]
)


@query(_SIGNALS)
def gate_signals(spark, sf_dir):
    return elements(spark, sf_dir).select("page_id", "elem_idx", F.explode(O.signals()).alias("signal"))


_SOME = lambda test: f"coalesce(bool_or({test}), false)"
_GATE = f"""SELECT c_custkey AS page_id, CASE WHEN {_SOME("signal LIKE '%_keyword'")} THEN 'visual_content_with_pii_indicators' WHEN {_SOME("signal = 'upload_control'")} THEN 'document_upload_control_present'
 WHEN {_SOME("signal LIKE '%_element'")} THEN 'visual_content_present' ELSE 'no_visual_content_requiring_inspection' END AS reason, count(signal) > 0 AS should_run
FROM customer LEFT JOIN ({_SIGNALS}) s ON s.page_id = c_custkey GROUP BY c_custkey"""


def gate(spark, sf_dir):
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    s = F.col("signal")
    reason = F.when(some(s.endswith("_keyword")), "visual_content_with_pii_indicators").when(some(s == "upload_control"), "document_upload_control_present").when(some(s.endswith("_element")), "visual_content_present")
    joined = pages(spark, sf_dir).select("page_id").join(gate_signals(spark, sf_dir), "page_id", "left")
    return joined.groupBy("page_id").agg(reason.otherwise("no_visual_content_requiring_inspection").alias("reason"), (F.count("signal") > 0).alias("should_run"))


@query(_GATE)
def gate_decide(spark, sf_dir):
    return gate(spark, sf_dir)


@query(f"SELECT reason, count(*) AS n FROM ({_GATE}) GROUP BY reason")
def ex_gate_reasons(spark, sf_dir):
    return gate(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


_COUNT = lambda text, words: " + ".join(f"contains({text}, '{w}')::INT" for w in words)
_SHAPES = f"""SELECT page_id AS p, svg_idx AS s, count(*) FILTER (tag = 'CIRCLE' AND try_cast(radius AS DOUBLE) > 2 AND try_cast(radius AS DOUBLE) < 20) AS eyes,
 count(*) FILTER (tag = 'CIRCLE' AND try_cast(radius AS DOUBLE) > 20 AND try_cast(radius AS DOUBLE) < 60) AS faces,
 count(*) FILTER (tag = 'PATH' AND contains(path, 'Q') AND (contains(path, 'mouth') OR contains(path, 'Mouth') OR (regexp_matches(path, 'M\\d+,\\d+\\s*Q\\d+,\\d+\\s*\\d+,\\d+') AND contains(path, '70')))) AS mouths
FROM ({_RAW}) WHERE svg_idx IS NOT NULL GROUP BY page_id, svg_idx"""
_INDICATORS = f"""SELECT e.*, CASE tag WHEN 'IMG' THEN {_COUNT(_WORDS, E.FACE_WORDS)} WHEN 'CANVAS' THEN {_HAS("lower(cls || ' ' || id)", E.CANVAS_WORDS)}::INT
 WHEN 'SVG' THEN CASE WHEN eyes >= 2 AND faces >= 1 THEN 2 ELSE 0 END + CASE WHEN mouths >= 1 THEN 1 ELSE 0 END ELSE 0 END AS n
FROM ({ELEMENTS_SQL}) e LEFT JOIN ({_SHAPES}) ON p = page_id AND s = elem_idx"""
_FACES = f"SELECT page_id, elem_idx, id, x, y, w, h, least(0.9::DOUBLE, 0.6::DOUBLE + 0.1::DOUBLE * n) AS confidence FROM ({_INDICATORS}) WHERE region IS NOT NULL AND w BETWEEN 20 AND 1000 AND h BETWEEN 20 AND 1000 AND n > 0"


@query(f"SELECT page_id, elem_idx, n::INTEGER AS indicators FROM ({_INDICATORS}) WHERE tag IN ('IMG', 'CANVAS', 'SVG')")
def l3_indicators(spark, sf_dir):
    rows = O.with_face_indicators(elements(spark, sf_dir)).where("tag IN ('IMG', 'CANVAS', 'SVG')")
    return rows.select("page_id", "elem_idx", F.coalesce("indicators", F.lit(0)).cast("int").alias("indicators"))


@query(f"SELECT page_id, elem_idx, confidence FROM ({_FACES})")
def l3_face_heuristic(spark, sf_dir):
    rows = O.with_face_indicators(elements(spark, sf_dir)).select("page_id", "elem_idx", F.explode(O.seen()).alias("d"))
    return rows.select("page_id", "elem_idx", "d.confidence")


@query(f"SELECT page_id, elem_idx, region FROM ({ELEMENTS_SQL}) WHERE region IS NOT NULL")
def l3_regions(spark, sf_dir):
    return elements(spark, sf_dir).select("page_id", "elem_idx", O.region().alias("region")).where("region IS NOT NULL")


@query(f"""SELECT e.page_id, e.elem_idx, round(e.x + f.bx * e.w, 6) AS x, round(e.y + f.by * e.h, 6) AS y, round(f.bw * e.w, 6) AS w, round(f.bh * e.h, 6) AS h, f.score
FROM ({ELEMENTS_SQL}) e JOIN (SELECT page_id, box_id, x / 512 AS bx, y / 512 AS by, w / 512 AS bw, h / 512 AS bh, score FROM ({BOXES_SQL})) f ON f.page_id = e.page_id
WHERE e.region IS NOT NULL AND f.bw * e.w BETWEEN 20 AND 1000 AND f.bh * e.h BETWEEN 20 AND 1000""")
def l3_convert(spark, sf_dir):
    """A model's normalised boxes of each visual region, scaled to it; those without the size of a face go."""
    regions = elements(spark, sf_dir).where(O.region().isNotNull()).select("page_id", "elem_idx", *[F.col(c).alias(f"r{c}") for c in "xywh"])
    found = boxes(spark, sf_dir).select("page_id", "score", *[(F.col(c) / 512).alias(f"b{c}") for c in "xywh"])
    w, h = F.col("bw") * F.col("rw"), F.col("bh") * F.col("rh")
    sized = regions.join(found, "page_id").where(w.between(O.MIN_FACE, O.MAX_FACE) & h.between(O.MIN_FACE, O.MAX_FACE))
    at = {"x": F.col("rx") + F.col("bx") * F.col("rw"), "y": F.col("ry") + F.col("by") * F.col("rh"), "w": w, "h": h}
    return sized.select("page_id", "elem_idx", *[F.round(v, 6).alias(k) for k, v in at.items()], "score")


_PAIR = f"SELECT a.page_id, a.box_id AS a_id, b.box_id AS b_id, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS byy, b.w AS bw, b.h AS bh FROM ({BOXES_SQL}) a JOIN ({BOXES_SQL}) b ON a.page_id = b.page_id AND a.box_id < b.box_id"


def pairs(spark, sf_dir):
    b = boxes(spark, sf_dir)
    left = b.select("page_id", F.col("box_id").alias("a_id"), *[F.col(c).alias(f"a{c}") for c in "xywh"])
    right = b.select("page_id", F.col("box_id").alias("b_id"), *[F.col(c).alias(f"b{c}") for c in "xywh"])
    return left.join(right, "page_id").where("a_id < b_id")


_IW, _IH = "greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx))", "greatest(0, least(ay + ah, byy + bh) - greatest(ay, byy))"


@query(f"SELECT page_id, a_id, b_id, round(CASE WHEN {_IW} * {_IH} > 0 THEN {_IW} * {_IH} / (aw * ah + bw * bh - {_IW} * {_IH}) ELSE 0 END, 6) AS iou FROM ({_PAIR})")
def geo_iou(spark, sf_dir):
    return pairs(spark, sf_dir).select("page_id", "a_id", "b_id", F.round(E.iou("a", "b"), 6).alias("iou"))


@query(f"SELECT page_id, box_id, least(x + w, 640) - greatest(x, 0) AS w, least(y + h, 480) - greatest(y, 0) AS h FROM ({BOXES_SQL}) WHERE least(x + w, 640) - greatest(x, 0) > 0 AND least(y + h, 480) - greatest(y, 0) > 0")
def geo_clamp(spark, sf_dir):
    w = F.least(F.col("x") + F.col("w"), F.lit(640.0)) - F.greatest(F.col("x"), F.lit(0.0))
    h = F.least(F.col("y") + F.col("h"), F.lit(480.0)) - F.greatest(F.col("y"), F.lit(0.0))
    return boxes(spark, sf_dir).select("page_id", "box_id", w.alias("w"), h.alias("h")).where("w > 0 AND h > 0")


@query(f"SELECT page_id, box_id, x, y, x + w AS x2, y + h AS y2 FROM ({BOXES_SQL}) WHERE score >= 0.5")
def geo_threshold(spark, sf_dir):
    return boxes(spark, sf_dir).where("score >= 0.5").select("page_id", "box_id", "x", "y", (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))


_IOU = "greatest(0, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x)) * greatest(0, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y))"


@query(f"""WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, box_id, x, y, w, h) AS n FROM ({BOXES_SQL})),
r(page_id, n, kept) AS (SELECT page_id, n, [{{'x': x, 'y': y, 'w': w, 'h': h, 'id': box_id, 'score': score}}] FROM b WHERE n = 1 UNION ALL SELECT b.page_id, b.n,
 CASE WHEN len(kept) >= 10 OR len(list_filter(kept, lambda k: {_IOU} > 0.3 * (k.w * k.h + b.w * b.h - {_IOU}))) > 0 THEN kept ELSE list_append(kept, {{'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h, 'id': b.box_id, 'score': b.score}}) END
 FROM r JOIN b ON b.page_id = r.page_id AND b.n = r.n + 1)
SELECT page_id, k.id AS box_id, k.score AS score FROM (SELECT page_id, unnest(last(kept ORDER BY n)) AS k FROM r GROUP BY page_id)""")
def geo_nms(spark, sf_dir):
    packed = boxes(spark, sf_dir).groupBy("page_id").agg(F.collect_list(F.struct((-F.col("score")).alias("rank"), F.col("box_id").alias("id"), "score", "x", "y", "w", "h")).alias("b"))
    return packed.select("page_id", F.explode(E.nms(F.col("b"))).alias("k")).select("page_id", F.col("k.id").alias("box_id"), F.col("k.score").alias("score"))
