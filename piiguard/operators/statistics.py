"""Exact distribution statistics without a task that holds a group.

Values are first counted by group and value where they are. The counts are range-partitioned by group and value;
each range sums its counts, and running sums over the ranges of a group (as many as partitions, not as rows) tell
which ranks each row of counts covers. Only rows that cover an asked rank go on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from piiguard.shared import materialize


def ranked(df: DataFrame, by: str, value: str) -> DataFrame:
    """The sorted values of each group, a row a distinct one: ``by``, ``value``, ``_start`` and ``_end`` (the ranks that it has, from 0, end not included), ``_total``.

    Nulls and NaN are no values.
    """
    spark = df.sparkSession
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(by, value).agg(F.count("*").alias("_n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(counts.repartitionByRange(parts, by, value).withColumn("_range", F.spark_partition_id()), "counts")
    sums = dealt.groupBy(by, "_range").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(by, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"), F.sum("_sum").over(Window.partitionBy(by)).alias("_total"))
    inside = Window.partitionBy("_range", by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_upto", F.sum("_n").over(inside)).join(offsets.hint("merge"), [by, "_range"])
    end = F.col("_offset") + F.col("_upto")
    return placed.select(by, value, (end - F.col("_n")).alias("_start"), end.alias("_end"), "_total")


def at_ranks(df: DataFrame, by: str, value: str, ranks: dict[str, tuple[str, str]]) -> DataFrame:
    """A row a group with the values at ranks: for each name an SQL expression of the count ``_total`` for its lower and upper rank.

    Columns are ``<name>_lo`` and ``<name>_hi``; nulls and NaN are no values.
    """
    covers = lambda rank: (F.col("_start") <= F.expr(rank)) & (F.expr(rank) < F.col("_end"))
    asked = [r for pair in ranks.values() for r in pair]
    some = covers(asked[0])
    for r in asked[1:]:
        some = some | covers(r)
    picks = [F.max(F.when(covers(r), F.col(value))).alias(f"{n}_{side}") for n, pair in ranks.items() for side, r in zip(("lo", "hi"), pair, strict=True)]
    return ranked(df, by, value).where(some).groupBy(by).agg(F.first("_total").alias("_total"), *picks)


def percentiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and a column a name: exact percentiles with linear interpolation at share * (n - 1)."""
    ranks = {n: (f"floor({s!r} * (_total - 1))", f"ceil({s!r} * (_total - 1))") for n, s in shares.items()}
    found = at_ranks(df, by, value, ranks)

    def between(n: str, s: float):
        place = F.lit(s) * (F.col("_total") - 1)
        return F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * (place - F.floor(place))

    return found.select(by, *[between(n, s).alias(n) for n, s in shares.items()])


def nearest(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and a column a name: the sorted values' element floor(n * share)."""
    ranks = {n: (f"floor({s!r} * _total)",) * 2 for n, s in shares.items()}
    return at_ranks(df, by, value, ranks).select(by, *[F.col(f"{n}_lo").alias(n) for n in shares])


def summary(df: DataFrame, by: str, value: str, shares: dict[str, float], digits: int = 6) -> DataFrame:
    """Exact statistics of each group, rounded; zeros where a group has no values."""
    v, zero = F.col(value), lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), digits).alias(n)
    plain = df.groupBy(by).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_dev"), F.count(v).alias("count"))
    joined = plain.join(percentiles(df, by, value, shares), by, "left")
    return joined.select(by, *[zero(F.col(c), c) for c in ("min", "max", "mean", *shares, "std_dev")], "count")


def totals(columns: Sequence[str]) -> list:
    return [F.sum(c).cast("long").alias(c) for c in columns]
