"""Budgets of actions: how many a user takes in a span of time and in a session.

A user's rows are cut into stretches of time, so that one who takes most actions is no single task. A stretch also sees the
rows of the time before it that a count or a gap can reach to; sessions and row numbers that began in earlier stretches
come from a table of stretches, which has a row for each user and stretch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

_SECOND = 1_000_000


def spend(actions: DataFrame, *, span_s: int, gap_s: int, per_span: int, per_session: int) -> DataFrame:
    """``in_span``, ``session``, ``in_session`` and ``within`` of each of ``actions`` (action_id, user_id, ts).

    ``in_span`` counts the user's actions of the last ``span_s`` seconds, those of the same instant included. A session ends
    where no action follows for more than ``gap_s`` seconds; ``session`` numbers a user's from 1, ``in_session`` a session's actions from
    1, by time and then action_id. ``within`` holds where neither exceeds its limit. Rows without user or time take no part.
    """
    reach = max(span_s, gap_s) * _SECOND
    rows = actions.where("user_id IS NOT NULL AND ts IS NOT NULL").select("action_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"))
    own = rows.withColumn("_stretch", F.floor(F.col("_at") / reach))
    # the row before a stretch matters only within the reach, which is one stretch
    seen = own.withColumn("_own", F.lit(True)).unionByName(own.withColumn("_stretch", F.col("_stretch") + 1).withColumn("_own", F.lit(False)))
    here = Window.partitionBy("user_id", "_stretch").orderBy("_at")
    ordered = Window.partitionBy("user_id", "_stretch").orderBy("_at", "action_id")
    before = F.lag("_at").over(ordered)
    marked = seen.withColumn("in_span", F.count("*").over(here.rangeBetween(-span_s * _SECOND, 0))).withColumn("_start", before.isNull() | (F.col("_at") - before > gap_s * _SECOND)).where("_own")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_row", F.row_number().over(ordered)).withColumn("_sessions", F.count_if("_start").over(upto))
    local = local.withColumn("_first", F.max(F.when(F.col("_start"), F.col("_row"))).over(upto))
    stretches = local.groupBy("user_id", "_stretch").agg(F.max("_row").alias("_n"), F.max("_sessions").alias("_s"), F.max("_first").alias("_f"))
    earlier = Window.partitionBy("user_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    placed = stretches.withColumn("_rows_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).withColumn("_sessions_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
    placed = placed.withColumn("_last_start", F.max(F.col("_rows_before") + F.col("_f")).over(earlier)).select("user_id", "_stretch", "_rows_before", "_sessions_before", "_last_start")
    joined = local.join(placed, ["user_id", "_stretch"])
    row = F.col("_rows_before") + F.col("_row")
    start = F.coalesce(F.col("_rows_before") + F.col("_first"), F.col("_last_start"))
    out = joined.select("action_id", "user_id", "in_span", (F.col("_sessions_before") + F.col("_sessions")).alias("session"), (row - start + 1).alias("in_session"))
    return out.withColumn("within", (F.col("in_span") <= per_span) & (F.col("in_session") <= per_session))
