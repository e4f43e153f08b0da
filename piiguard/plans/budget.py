"""Budgets of actions over the log of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from piiguard.operators import budget as B

QUERIES, ORACLES = {}, {}
#: Limits are estimates, to be set by whoever runs the validator.
SPAN_S, GAP_S, PER_SPAN, PER_SESSION = 6 * 3600, 9 * 3600, 3, 5


def val_budget(spark, sf_dir):
    """Each action of the log with its counts and whether it is within its user's budgets."""
    actions = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("action_id"), "user_id", "ts")
    return B.spend(actions, span_s=SPAN_S, gap_s=GAP_S, per_span=PER_SPAN, per_session=PER_SESSION)


QUERIES["val_budget"] = val_budget
ORACLES["val_budget"] = f"""WITH a AS (SELECT event_id AS action_id, user_id, epoch_us(ts) AS us FROM events),
s AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN {SPAN_S * 1_000_000} PRECEDING AND CURRENT ROW) AS in_span,
 coalesce(us - lag(us) OVER (PARTITION BY user_id ORDER BY us, action_id) > {GAP_S * 1_000_000}, true) AS start FROM a),
n AS (SELECT *, count(*) FILTER (start) OVER (PARTITION BY user_id ORDER BY us, action_id ROWS UNBOUNDED PRECEDING) AS session FROM s),
i AS (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY us, action_id) AS in_session FROM n)
SELECT action_id, user_id, in_span, session, in_session, in_span <= {PER_SPAN} AND in_session <= {PER_SESSION} AS within FROM i"""
