"""Which elements of pages are visible: the cascade of style sheets and inline styles over element trees.

Rules are taken from the text of style elements and, where given, a sheet of the user's that stands before them. Only
those that declare one of ``PROPERTIES`` are matched. Of an element's declarations of a property the one that counts is
the important one, else the inline one, else that of the highest specificity, else the last. ``display: none`` hides all
that is inside, and ``visibility`` is inherited unless an element has its own: both are carried down by pointer jumping, which takes as
many rounds as the logarithm of a page's depth, over the pages that declare any of them.

Conditional rules (``@media`` and the like) and the values ``inherit``, ``initial`` and ``unset`` are left out. Nothing is
laid out: boxes are default ones at the origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from piiguard.functions import elements as E
from piiguard.operators import selectors as S
from piiguard.shared import materialize

PROPERTIES = ("display", "visibility", "opacity", "position", "left", "top", "transform")
_DECLARED = rf"(?i)(?:^|;)\s*(?:{'|'.join(PROPERTIES)})\s*:"


def declarations(body: Column) -> Column:
    """The declarations of ``PROPERTIES`` in order: structs of property, value and whether it is important."""
    part = r"^\s*([A-Za-z-]+)\s*:\s*(.*?)\s*(!\s*important)?\s*$"
    group = lambda d, n: F.lower(F.regexp_extract(d, "(?is)" + part, n))
    all_ = F.transform(F.split(body, ";"), lambda d: F.struct(group(d, 1).alias("property"), group(d, 2).alias("value"), (group(d, 3) != "").alias("important")))
    return F.filter(all_, lambda d: d["property"].isin(*PROPERTIES) & ~d["value"].isin("", "inherit", "initial", "unset", "revert"))


def rules(tree: DataFrame, sheet: str | None = None) -> DataFrame:
    """page_id, sid, selector, body, sheet, rule: the rules of each page that declare a property."""
    sheets = tree.where("css IS NOT NULL").select("page_id", F.col("node").alias("sheet"), "css")
    if sheet:
        sheets = sheets.unionByName(tree.where("node = 0").select("page_id", F.lit(-1).alias("sheet"), F.lit(sheet).alias("css")))
    css = F.regexp_replace("css", r"(?s)/\*.*?\*/|<!--|-->", " ")
    css = F.regexp_replace(F.regexp_replace(css, r"@[^{};]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", " "), "@[^{};]*;", " ")
    group = lambda n: F.regexp_extract_all(F.col("css"), F.lit(r"([^{}]+)\{([^{}]*)\}"), F.lit(n))
    cut = sheets.withColumn("css", css).select("page_id", "sheet", F.posexplode(F.arrays_zip(group(1).alias("selector"), group(2).alias("body"))).alias("rule", "r"))
    found = cut.select("page_id", "sheet", "rule", F.regexp_replace("r.selector", r"^\s+|\s+$", "").alias("selector"), F.col("r.body").alias("body")).where(F.col("body").rlike(_DECLARED))
    return found.withColumn("sid", F.concat_ws("/", F.col("sheet").cast("string"), F.col("rule").cast("string")))


def declared(tree: DataFrame, sheet: str | None = None) -> DataFrame:
    """A row an element that has any: page_id, node and the value of each of ``PROPERTIES`` that counts, or null."""
    found = materialize(rules(tree, sheet), "rules")
    steps = materialize(S.compile_steps(found), "steps")
    weight = steps.where("step = 1").select("page_id", "sid", "alt", "specificity")
    met = S.match(steps, tree).join(weight, ["page_id", "sid", "alt"]).join(found, ["page_id", "sid"])
    by_rule = met.select("page_id", "node", F.lit(0).alias("inline"), "specificity", "sheet", "rule", F.posexplode(declarations(F.col("body"))).alias("nth", "d"))
    style = F.try_element_at("attributes", F.lit("style"))
    zero = [F.lit(0).alias(c) for c in ("sheet", "rule")]
    own = tree.where(style.rlike(_DECLARED)).select("page_id", "node", F.lit(1).alias("inline"), F.lit(0).cast("long").alias("specificity"), *zero, F.posexplode(declarations(style)).alias("nth", "d"))
    rank = F.struct("d.important", "inline", "specificity", "sheet", "rule", "nth", F.col("d.value").alias("value"))
    best = lambda p: F.max(F.when(F.col("d.property") == p, rank))["value"].alias(p)
    return by_rule.unionByName(own).groupBy("page_id", "node").agg(*[best(p) for p in PROPERTIES])


def inherited(tree: DataFrame, own: DataFrame) -> DataFrame:
    """page_id, node, ``gone`` (it or an element around it has no display) and ``visibility``, of the pages in ``own``."""
    here = tree.join(own.select("page_id").distinct(), "page_id", "left_semi").select("page_id", "node", "up")
    state = here.join(own, ["page_id", "node"], "left").select("page_id", "node", F.col("up").alias("ptr"), F.coalesce(F.col("display") == "none", F.lit(False)).alias("gone"), "visibility")
    state = materialize(state, "styles")
    while not state.where("ptr IS NOT NULL").isEmpty():
        above = state.select("page_id", F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("gone").alias("_gone"), F.col("visibility").alias("_visibility"))
        met = state.join(above, ["page_id", "ptr"], "left")
        state = materialize(met.select("page_id", "node", F.col("_ptr").alias("ptr"), (F.col("gone") | F.coalesce("_gone", F.lit(False))).alias("gone"), F.coalesce("visibility", "_visibility").alias("visibility")), "styles")
    return state.select("page_id", "node", "gone", "visibility")


def _length(value: Column, view: float) -> Column:
    """A length as a number of pixels; what is none is zero."""
    number = F.regexp_extract(F.coalesce(value, F.lit("")), r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
    return F.coalesce(F.when(F.coalesce(value.endswith("%"), F.lit(False)), number * view / 100).otherwise(number), F.lit(0.0))


def visibility(tree: DataFrame, sheet: str | None = None) -> DataFrame:
    """page_id, node, offscreen and visible of each element of the pages that declare a property; all others are visible."""
    own = materialize(declared(tree, sheet), "declared")
    down = inherited(tree, own)
    width, height = E.default_box(F.col("tag"))
    zero = F.lit(0.0)
    off = E.offscreen(
        F.coalesce("position", F.lit("static")), _length(F.col("left"), E.VIEW_WIDTH), _length(F.col("top"), E.VIEW_HEIGHT), F.coalesce("transform", F.lit("none")), zero, zero, width, height
    )
    clear = F.regexp_replace(F.coalesce("opacity", F.lit("1")), "%$", "").try_cast("double") == 0
    hidden = F.col("gone") | F.coalesce(F.col("visibility") == "hidden", F.lit(False)) | F.coalesce(clear, F.lit(False))
    joined = down.join(own.drop("visibility", "display"), ["page_id", "node"], "left").join(tree.select("page_id", "node", "tag"), ["page_id", "node"])
    return joined.select("page_id", "node", off.alias("offscreen"), (~(hidden | off)).alias("visible"))
