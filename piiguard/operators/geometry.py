"""Overlapping boxes by a grid join, and non-maximum suppression in rounds.

Boxes of all sizes meet on a grid of several levels. A box has the level whose cells are just as large as it, so that it lies in
four of them at most; it is also dealt to the cells of the coarser levels that any box has. Two boxes meet at the coarser
of their levels, and of the cells that both lie in the one that holds the corner where they begin to overlap reports
them, so each pair comes once. Work follows the boxes and the pairs found, on a page of any number of boxes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from piiguard.functions import elements as E
from piiguard.shared import discard, materialize


def _level(p: str) -> Column:
    size = F.greatest(F.abs(F.col(f"{p}w")), F.abs(F.col(f"{p}h")))
    return F.ceil(F.log2(F.greatest(size, F.lit(1.0)))).cast("int")


def _dealt(boxes: DataFrame, p: str, levels: Sequence[int], apart: int) -> DataFrame:
    """``boxes`` in each cell of their own and the coarser levels, up to ``apart`` above their own."""
    own = boxes.where(" AND ".join(f"{p}{c} IS NOT NULL AND NOT isnan({p}{c})" for c in "xywh")).withColumn(f"_{p}l", _level(p))
    at = own.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda v: v.between(F.col(f"_{p}l"), F.col(f"_{p}l") + apart))))
    cell = F.pow(F.lit(2.0), F.col("_level"))

    def cells(c: str, size: str) -> Column:
        a, b = F.col(f"{p}{c}"), F.col(f"{p}{c}") + F.col(f"{p}{size}")
        return F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))

    return at.withColumn("_cx", cells("x", "w")).withColumn("_cy", cells("y", "h"))


def overlapping(left: DataFrame, right: DataFrame, on: Sequence[str] = ("page_id",), apart: int = 4096) -> DataFrame:
    """Pairs of rows of ``left`` (ax, ay, aw, ah, ...) and ``right`` (bx, by, bw, bh, ...) with equal ``on`` that overlap.

    Boxes that only touch don't; boxes with a null or not a number as a side meet nothing. Other columns are kept.
    Pairs whose levels are more than ``apart`` from each other may be left out; there are fewer levels than its default.
    """
    sizes = left.select(_level("a").alias("v")).unionByName(right.select(_level("b").alias("v"))).where("v IS NOT NULL").distinct()
    levels = sorted(r["v"] for r in sizes.collect()) or [0]  # at most as many as there are powers of two in a double
    # the cell first: rows are sorted by it, and pages and levels may be few
    # and sorted and merged: copies are many more than their table's file tells, too many for the driver
    met = _dealt(left, "a", levels, apart).join(_dealt(right, "b", levels, apart).hint("merge"), ["_cx", "_cy", "_level", *on])
    cell = F.pow(F.lit(2.0), F.col("_level"))
    corner = lambda c: F.floor(F.greatest(f"a{c}", f"b{c}") / cell)
    here = (F.col("_level") == F.greatest("_al", "_bl")) & (corner("x") == F.col("_cx")) & (corner("y") == F.col("_cy"))
    return met.where(here & E.overlaps("a", "b")).drop("_level", "_cx", "_cy", "_al", "_bl")


def _numbered(boxes: DataFrame) -> DataFrame:
    """The different boxes with ``_id``, which puts those of a page in order: a best-first sort by ranges, kept, as threats name boxes by it."""
    order = ["page_id", -F.col("score"), "box_id", "x", "y", "w", "h"]
    ranged = boxes.dropDuplicates(["page_id", "box_id", "x", "y", "w", "h", "score"]).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("_id", F.monotonically_increasing_id()), "boxes")


def suppress(boxes: DataFrame, most: int | None = 10, limit: float = 0.3) -> DataFrame:
    """The rows of ``boxes`` (page_id, box_id, x, y, w, h, score) that non-maximum suppression keeps, at most ``most`` a page.

    The best box is kept and those that overlap it by more than ``limit`` go, then the best of the rest, and so on; of
    equal scores the smaller box_id, the order of input, is better, of equal ids the smaller place; of equal rows one is
    kept. In rounds: a box that no better box threatens is kept, and the boxes it threatens go, for all boxes of all pages
    at once. What is left after the last threat is kept. There are as many rounds as the longest chain of threats
    that hang on each other: few where the order of boxes has nothing to do with their places.

    Threats are pairs of numbers, and those of a round are deleted when the next ones are written. Joins sort and merge: as files,
    threats are small, and Spark would send them to the driver.
    """
    boxes = _numbered(boxes)
    side = lambda p, name: boxes.select("page_id", F.col("_id").alias(name), *[F.col(c).alias(f"{p}{c}") for c in "xywh"])
    apart = math.ceil(-math.log2(limit)) if 0 < limit < 1 else 4096  # by more than the limit overlap only boxes whose larger sides differ by less than 1 / limit
    found = overlapping(side("a", "better"), side("b", "worse"), apart=apart).where((F.col("better") < F.col("worse")) & (E.iou("a", "b") > limit))
    threats = materialize(found.select("better", "worse"), "threats")
    gone = []
    while not threats.isEmpty():
        threatened = threats.select(F.col("worse").alias("better")).distinct()
        lost = materialize(threats.join(threatened.hint("merge"), "better", "left_anti").select("worse").distinct(), "lost")
        gone.append(lost)
        rest = threats.join(lost.hint("merge"), "worse", "left_anti").join(lost.withColumnRenamed("worse", "better").hint("merge"), "better", "left_anti")
        before, threats = threats, materialize(rest, "threats")
        discard(before)
    discard(threats)
    kept = boxes
    if gone:
        kept = boxes.join(functools.reduce(DataFrame.unionByName, gone).withColumnRenamed("worse", "_id").hint("merge"), "_id", "left_anti")
    if most is not None:
        kept = kept.withColumn("_nth", F.row_number().over(Window.partitionBy("page_id").orderBy("_id"))).where(F.col("_nth") <= most).drop("_nth")
    return kept.drop("_id")
