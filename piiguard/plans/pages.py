"""Queries over parsed pages."""

from pyspark.sql import functions as F

from piiguard.functions import elements as E
from piiguard.operators import pages as O, selectors as S, styles as Y
from piiguard.shared import materialize
from piiguard.sources import html

QUERIES, ORACLES = {}, {}
#: The user's style sheet of the queries: notices and adverts are not shown.
SHEET = ".ad, .advert, [hidden] { display: none }"


def _pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _elements(spark, sf_dir):
    return html.walk(_pages(spark, sf_dir))


def tree(spark, sf_dir):
    """All elements of the pages, parsed once."""
    return materialize(html.tree(_pages(spark, sf_dir)), "tree")


def src_dom_walk(spark, sf_dir):
    return _elements(spark, sf_dir).select("page_id", "elem_idx", "parent_idx", "tag", F.map_from_entries(F.sort_array(F.map_entries("attributes"))).cast("string").alias("attributes"), "text")


def el_selector(spark, sf_dir):
    return _elements(spark, sf_dir).select("page_id", "elem_idx", "selector", "form_id", "label_text")


def el_to_metadata(spark, sf_dir):
    e = _elements(spark, sf_dir)
    return e.select(
        "page_id", "elem_idx", "tag", E.role_of(F.col("tag"), O.attribute("role")).alias("role"), O.attribute("aria-label").alias("aria_label"), interactive().alias("is_interactive"), "text"
    )


def interactive():
    return E.interactive(F.col("tag"), O.attribute("role"), O.attribute("tabindex"), O.attribute("contenteditable"))


def as_elements(parsed, sheet=None):
    """The walked elements of a tree as the page operators read them: visible by the cascade; no layout, so default boxes at the origin."""
    width, height = E.default_box(F.col("tag"))
    shown = Y.visibility(parsed, sheet).select("page_id", "node", F.col("visible").alias("_shown"))
    walked = parsed.where("elem_idx IS NOT NULL").join(shown, ["page_id", "node"], "left")
    return walked.select(
        "page_id", "elem_idx", "selector", "tag", "attributes", "text", O.attribute("aria-label").alias("aria_label"), "label_text", "form_id", F.coalesce("_shown", F.lit(True)).alias("visible"),
        interactive().alias("interactive"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), width.alias("w"), height.alias("h"), "svg_idx",
    )


def grouped(parsed, found):
    """The detections of the element that each one's selector meets first, as a page's own search would find it."""
    met = S.resolve(found, parsed).join(parsed.where("elem_idx IS NOT NULL").select("page_id", "node", "elem_idx"), ["page_id", "node"]).select("page_id", "selector", "elem_idx")
    return O.gather(found, met)


def annotated(spark, sf_dir, sheet=SHEET):
    """The tree's elements, their detections in order, and the elements with the detections of their selectors."""
    parsed = tree(spark, sf_dir)
    e = materialize(as_elements(parsed, sheet), "elements")
    found = materialize(O.detections(O.with_layers(e)), "found")
    groups = grouped(parsed, found)
    return e, found, groups, O.annotated(e, groups)


def el_visible_pages(spark, sf_dir):
    """Visible elements of each page by its styles, the user's sheet included."""
    counts = as_elements(tree(spark, sf_dir), SHEET).groupBy("page_id").agg(F.count("*").alias("elements"), F.count_if("visible").alias("visible"))
    return counts


def pipe_detect_pages(spark, sf_dir):
    """The detection pipeline over the parsed pages."""
    found = O.detections(O.with_layers(as_elements(tree(spark, sf_dir), SHEET)))
    return found.select("page_id", "seq", "elem_idx", "type", "source", "confidence", "severity", "original_value")


def pipe_group_pages(spark, sf_dir):
    """Detections by the first element that their selectors meet."""
    shown = F.array_join(F.transform("detections", lambda d: F.concat(d["type"], F.lit("/"), d["source"])), ",")
    return annotated(spark, sf_dir)[2].select("page_id", "elem_idx", F.size("detections").cast("long").alias("n"), shown.alias("detections"))


def el_tag_counts(spark, sf_dir):
    return _elements(spark, sf_dir).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def el_walk_lateral(spark, sf_dir):
    """Tags of the walk as a table function in SQL."""
    html.register_walk(spark)
    return spark.sql("SELECT p.page_id, w.tag, count(*) AS n FROM {pages} p, LATERAL walk(p.html) w GROUP BY ALL", pages=_pages(spark, sf_dir))


def san_context_pages(spark, sf_dir):
    """A sanitized context a page: origin, elements, redactions, and whether it leaks nothing."""
    out = O.context(O.sanitized_deep(O.with_values(annotated(spark, sf_dir)[3])), _pages(spark, sf_dir))
    return out.select("page_id", "url", F.to_json("elements").alias("elements"), F.coalesce(F.size("visual_regions"), F.lit(0)).cast("long").alias("n_regions"), "placeholders", "masks", "valid")


def san_structured_pages(spark, sf_dir):
    """The compact context of each page's visible elements."""
    return O.structured(annotated(spark, sf_dir)[3])


for _f in (src_dom_walk, el_selector, el_to_metadata, el_tag_counts, el_walk_lateral, el_visible_pages, san_context_pages, san_structured_pages, pipe_detect_pages, pipe_group_pages):
    QUERIES[_f.__name__] = _f
# the start tags behind the body's, without scripts, styles and comments
_BODY = "regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)$', 1), '(?s)<!--.*?-->|(<script[^>]*>).*?</script>|(<style[^>]*>).*?</style>', '', 'g')"
ORACLES["el_tag_counts"] = f"""SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, upper(unnest(regexp_extract_all({_BODY}, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS tag FROM pages)
WHERE tag NOT IN ('SCRIPT', 'STYLE', 'NOSCRIPT', 'META', 'LINK', 'HEAD', 'TITLE') GROUP BY ALL"""

# adverts of these pages hold no adverts; what is inside goes with them
_TAGS = "len(list_filter(regexp_extract_all({0}, '<([a-zA-Z][a-zA-Z0-9]*)', 1), lambda t: upper(t) NOT IN ('SCRIPT', 'STYLE', 'NOSCRIPT', 'META', 'LINK', 'HEAD', 'TITLE')))"
ORACLES["el_visible_pages"] = f"""SELECT page_id, elements, elements - hidden AS visible FROM (SELECT page_id, {_TAGS.format('b')}::BIGINT AS elements,
 coalesce(list_sum(list_transform(regexp_extract_all(b, '(?s)<div class="ad">.*?</div>'), lambda a: {_TAGS.format('a')})), 0)::BIGINT AS hidden FROM (SELECT page_id, {_BODY} AS b FROM pages)) WHERE elements > 0"""
ORACLES["el_walk_lateral"] = ORACLES["el_tag_counts"]
