"""Shared pieces of the check SQL: the same views the queries build, in DuckDB's dialect."""

TX = """tx AS (
  SELECT event_id, 'ev-' || event_id AS transaction_id, 'card-' || user_id AS card_id,
         value AS amount, event_type AS country, epoch_us(ts) AS us, ts,
         (epoch_us(ts) - 1704067200000000) / 1e6 AS t,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
         least(value / 100, 1.0) AS risk
  FROM events)"""

VELOCITY = (
    TX
    + """, raw_velocity AS (
  SELECT *,
    count(*) OVER (PARTITION BY card_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS c1m,
    count(*) OVER (PARTITION BY card_id ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW) AS c5m,
    count(*) OVER day AS c1h,
    sum(CAST(round(amount * 100) AS BIGINT)) OVER day AS cents,
    count(DISTINCT country) OVER (PARTITION BY card_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS places,
    lag(us) OVER (PARTITION BY card_id ORDER BY us) AS before
  FROM tx
  WINDOW day AS (PARTITION BY card_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)),
velocity AS (
  SELECT * EXCLUDE (cents, before),
    CAST(cents AS DOUBLE) / 100.0 AS amount_1h,
    CASE WHEN us - before < 86400000000 THEN round((us - before) / 1e6, 3) END AS gap
  FROM raw_velocity)"""
)

SCORED = (
    VELOCITY
    + """, flagged AS (
  SELECT *,
    CASE WHEN risk >= 0.95 THEN 'block' WHEN risk >= 0.24 THEN 'review' ELSE 'approve' END AS model_decision,
    c1m > 1 AS r1, c1h > 5 AS r2, places > 3 AS r3, coalesce(gap < 1800.0, false) AS r4
  FROM velocity),
scored AS (
  SELECT *,
    CASE WHEN model_decision = 'approve' AND (r1 OR r2 OR r3 OR r4) THEN 'review' ELSE model_decision END AS decision,
    concat_ws(',', CASE WHEN r1 THEN 'many_in_a_minute' END, CASE WHEN r2 THEN 'many_in_an_hour' END,
              CASE WHEN r3 THEN 'several_countries' END, CASE WHEN r4 THEN 'back_to_back' END) AS reasons
  FROM flagged)"""
)


def with_(prefix: str, body: str) -> str:
    return f"WITH {prefix}\n{body}"
