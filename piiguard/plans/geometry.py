"""Queries over boxes of pages of any number: overlaps and suppression, also of one page that holds all boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from piiguard.operators import geometry as G
from piiguard.plans import elements as EL

QUERIES, ORACLES = {}, {}
#: All boxes on one page that grows with their number, in an order that has nothing to do with their places.
ONE_PAGE = "SELECT 1 AS page_id, (l_orderkey * 8 + l_linenumber) * 7919 % 1000003 AS box_id, l_orderkey * 16.0E0 AS x, l_suppkey % 500 + 0.0E0 AS y, l_quantity * 4 AS w, l_quantity * 3 AS h, l_discount * 10 AS score FROM lineitem"


def one_page(spark, sf_dir, dealt_by: str | None = "l_orderkey"):
    """The boxes, dealt before the overlap join copies each to its cells: their file may be few row groups, so few tasks."""
    return EL._sql(spark, sf_dir, ONE_PAGE, "lineitem", dealt_by=dealt_by)


def _pairs(boxes):
    a = boxes.select("page_id", F.col("box_id").alias("a_id"), *[F.col(c).alias(f"a{c}") for c in "xywh"])
    b = boxes.select("page_id", F.col("box_id").alias("b_id"), *[F.col(c).alias(f"b{c}") for c in "xywh"])
    return G.overlapping(a, b).where("a_id < b_id").select("page_id", "a_id", "b_id")


def geo_overlap(spark, sf_dir):
    return _pairs(EL.boxes(spark, sf_dir, dealt_by="l_orderkey"))


ORACLES["geo_overlap"] = f"SELECT page_id, a_id, b_id FROM ({EL._PAIR}) WHERE ax < bx + bw AND bx < ax + aw AND ay < byy + bh AND byy < ay + ah"


def geo_overlap_page(spark, sf_dir):
    """Overlapping pairs of one page with all boxes."""
    return _pairs(one_page(spark, sf_dir))


ORACLES["geo_overlap_page"] = f"""WITH p AS MATERIALIZED ({ONE_PAGE}) SELECT a.page_id, a.box_id AS a_id, b.box_id AS b_id FROM p a JOIN p b
 ON a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h AND a.box_id < b.box_id"""


def geo_nms_page(spark, sf_dir):
    """Suppression over one page with all boxes, without a limit of how many are kept."""
    return G.suppress(one_page(spark, sf_dir, dealt_by=None), most=None)  # which sorts them first.select("box_id", "score")


for _f in (geo_overlap, geo_overlap_page, geo_nms_page):
    QUERIES[_f.__name__] = _f
