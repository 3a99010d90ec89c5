"""Evaluation and policy queries. Label: `event_type = 'error'`; scores are stub risks."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.rules import Thresholds, decide
from riskloom.functions.scalars import break_even_precision, min_max_risk, negated_risk
from riskloom.operators import evaluation as E
from riskloom.operators import policy as P
from riskloom.operators.ranking import exact_quantiles, row_index
from riskloom.plans import sql
from riskloom.plans.registry import query
from riskloom.plans.tables import stub_risk, table, transactions


def rated(spark, sf_dir):
    """Two scores per event: the stub, and a second one that mixes in the hour."""
    tx = transactions(spark, sf_dir)
    mixed = (stub_risk() + F.pmod(F.floor(F.col("Time") / 3600), F.lit(24)) / 24) / 2
    other = F.floor(mixed * 100) / F.lit(100.0)
    return tx.select("event_id", "Amount", "label", stub_risk().alias("risk"), other.alias("other"))


RATED = (
    sql.TX
    + """, rated AS (SELECT event_id, amount, label, risk, floor((risk + (floor(t / 3600) % 24) / 24) / 2 * 100) / 100.0 AS other FROM tx)"""
)

CURVE = (
    RATED
    + """, g AS (SELECT other AS score, count(*) AS n, sum(label) AS pos FROM rated GROUP BY 1),
 c AS (SELECT score, n, pos, sum(n) OVER (ORDER BY score DESC) AS flagged, sum(pos) OVER (ORDER BY score DESC) AS tp,
   sum(n) OVER () AS total, sum(pos) OVER () AS frauds FROM g)"""
)


def rounded(df, *names, places=6):
    return df.select(*(F.round(c, places).alias(c) if c in names else F.col(c) for c in df.columns))


# ------------------------------------------------------------------ ranking
@query(
    sql.with_(
        CURVE,
        """SELECT round(sum(pos * tp / flagged) / sum(pos), 6) AS pr_auc, round(sum(pos) / sum(n), 6) AS pr_auc_baseline,
  CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_fraud FROM c""",
    )
)
def average_precision(spark, sf_dir):
    df = E.check_inputs(rated(spark, sf_dir), "label", "other")
    return rounded(E.metrics(df, "other", "label"), "pr_auc", "pr_auc_baseline").drop("roc_auc")


@query(
    sql.with_(
        RATED,
        """, r AS (SELECT label, rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2 AS mid FROM rated)
SELECT round((sum(mid) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2)
  / (CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) * count(*) FILTER (WHERE label = 0)), 6) AS roc_auc FROM r""",
    )
)
def roc_auc(spark, sf_dir):
    return rounded(E.metrics(rated(spark, sf_dir), "other", "label").select("roc_auc"), "roc_auc")


@query(
    sql.with_(
        CURVE,
        """SELECT score, CAST(flagged AS BIGINT) AS flagged, CAST(tp AS BIGINT) AS tp, round(tp / flagged, 9) AS precision, round(tp / frauds, 9) AS recall,
  round((flagged - tp) / (total - frauds), 9) AS false_positive_rate FROM c""",
    )
)
def pr_curve(spark, sf_dir):
    points = E.curve(rated(spark, sf_dir), "other", "label")
    return rounded(points, "precision", "recall", "false_positive_rate", places=9)


@query(sql.with_(CURVE, "SELECT round(coalesce(max(tp / frauds) FILTER (WHERE tp / flagged >= 0.205), 0), 9) AS recall FROM c"))
def recall_at_precision(spark, sf_dir):
    return rounded(E.recall_at_precision(E.curve(rated(spark, sf_dir), "other", "label"), 0.205), "recall", places=9)


@query(
    sql.with_(
        RATED,
        """, o AS (SELECT label, row_number() OVER (ORDER BY other DESC, event_id) AS place FROM rated),
 b(budget) AS (VALUES (0.0), (0.0005), (0.001), (0.002), (0.005), (0.01), (0.02), (0.3)),
 k AS (SELECT CAST(budget AS DOUBLE) AS budget, CAST(round_even(CAST(budget AS DOUBLE) * (SELECT count(*) FROM rated), 0) AS BIGINT) AS alerts FROM b)
SELECT round(100 * budget, 6) AS budget_pct, alerts, count(*) FILTER (WHERE label = 1 AND place <= alerts) AS tp,
  round(CASE WHEN alerts > 0 THEN count(*) FILTER (WHERE label = 1 AND place <= alerts) / alerts END, 9) AS precision,
  round(count(*) FILTER (WHERE label = 1 AND place <= alerts) / count(*) FILTER (WHERE label = 1), 9) AS recall,
  round(CASE WHEN count(*) FILTER (WHERE label = 1 AND place <= alerts) > 0 THEN alerts / count(*) FILTER (WHERE label = 1 AND place <= alerts) END, 9) AS alerts_per_fraud
FROM k, o GROUP BY budget, alerts""",
    )
)
def budget_table(spark, sf_dir):
    out = E.budget_table(rated(spark, sf_dir), "other", "label", "event_id", (0.0, *E.DEFAULT_BUDGETS, 0.3))
    return rounded(rounded(out, "precision", "recall", "alerts_per_fraud", places=9), "budget_pct")


_REPLICATES = (
    RATED
    + """, placed AS (SELECT label, other, row_number() OVER (PARTITION BY label ORDER BY event_id) - 1 AS spot, count(*) OVER (PARTITION BY label) AS size FROM rated),
 draws AS (SELECT b, label, CAST(floor(CAST(('0x' || substr(sha256('7|' || b || '|' || label || '|' || spot), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496.0 * size) AS BIGINT) AS spot
   FROM placed, range(1, 11) r(b)),
 g AS (SELECT b, p.other AS score, count(*) AS n, sum(p.label) AS pos FROM draws d JOIN placed p ON p.label = d.label AND p.spot = d.spot GROUP BY ALL),
 c AS (SELECT b, pos, sum(n) OVER w AS flagged, sum(pos) OVER w AS tp FROM g WINDOW w AS (PARTITION BY b ORDER BY score DESC)),
 ap AS (SELECT b, sum(pos * tp / flagged) / sum(pos) AS pr_auc FROM c GROUP BY b)"""
)


@query(sql.with_(_REPLICATES, "SELECT CAST(b AS INT) AS replicate, round(pr_auc, 6) AS pr_auc FROM ap"))
def bootstrap_ap(spark, sf_dir):
    return rounded(E.bootstrap_replicates(rated(spark, sf_dir), "other", "label", "event_id", 10, 7), "pr_auc")


@query(sql.with_(_REPLICATES, "SELECT round(quantile_cont(pr_auc, 0.025), 6) AS low, round(quantile_cont(pr_auc, 0.975), 6) AS high, count(*) AS resamples FROM ap"))
def bootstrap_interval(spark, sf_dir):
    reps = E.bootstrap_replicates(rated(spark, sf_dir), "other", "label", "event_id", 10, 7)
    return rounded(E.interval(reps), "low", "high")


@query(
    sql.with_(
        RATED,
        """, steps AS (SELECT list(upto) AS l FROM (SELECT sum(exp(-1) / factorial(CAST(k AS INT))) OVER (ORDER BY k) AS upto FROM range(16) t(k))),
 draws AS (SELECT b, label, other, CAST(('0x' || substr(sha256('7|' || b || '|' || event_id), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496.0 AS u FROM rated, range(1, 11) r(b)),
 drawn AS (SELECT b, label, other, len(list_filter(l, lambda x: x <= u)) AS times FROM draws, steps),
 g AS (SELECT b, other AS score, sum(times) AS n, sum(times * label) AS pos FROM drawn WHERE times > 0 GROUP BY ALL),
 c AS (SELECT b, pos, sum(n) OVER w AS flagged, sum(pos) OVER w AS tp FROM g WINDOW w AS (PARTITION BY b ORDER BY score DESC)),
 ap AS (SELECT b, sum(pos * tp / flagged) / sum(pos) AS pr_auc FROM c GROUP BY b)
SELECT round(quantile_cont(pr_auc, 0.025), 6) AS low, round(quantile_cont(pr_auc, 0.975), 6) AS high, count(pr_auc) AS resamples FROM ap""",
    )
)
def bootstrap_poisson(spark, sf_dir):
    reps = E.poisson_replicates(rated(spark, sf_dir), "other", "label", "event_id", 10, 7)
    return rounded(E.interval(reps), "low", "high")


@query(
    sql.with_(
        RATED,
        """, r AS (SELECT rank() OVER (ORDER BY risk) + (count(*) OVER (PARTITION BY risk) - 1) / 2 AS a,
   rank() OVER (ORDER BY other) + (count(*) OVER (PARTITION BY other) - 1) / 2 AS b FROM rated) SELECT round(corr(a, b), 6) AS spearman FROM r""",
    )
)
def spearman(spark, sf_dir):
    return rounded(E.spearman(rated(spark, sf_dir), "risk", "other"), "spearman")


@query(
    sql.with_(
        RATED,
        """, o AS (SELECT label, row_number() OVER (ORDER BY risk DESC, event_id) <= round_even(0.05 * (SELECT count(*) FROM rated), 0) AS a,
   row_number() OVER (ORDER BY other DESC, event_id) <= round_even(0.05 * (SELECT count(*) FROM rated), 0) AS b FROM rated)
SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_first, count(*) FILTER (WHERE b AND NOT a) AS only_second,
  count(*) FILTER (WHERE NOT a AND NOT b) AS missed FROM o WHERE label = 1""",
    )
)
def model_overlap(spark, sf_dir):
    return E.overlap(rated(spark, sf_dir), "risk", "other", "label", "event_id", 0.05)


@query(
    sql.with_(
        RATED,
        """, ref AS (SELECT -other AS s FROM rated WHERE label = 0)
SELECT event_id, round((SELECT count(*) FROM ref WHERE s > -r.other) / (SELECT count(*) FROM ref), 9) AS calibrated FROM rated r""",
    )
)
def calibrated_risk(spark, sf_dir):
    df = rated(spark, sf_dir).select("event_id", "label", (-F.col("other")).alias("raw"))
    out = E.calibrated(df.where("label = 0"), df, "raw", "calibrated")
    return rounded(out.select("event_id", "calibrated"), "calibrated", places=9)


@query(
    sql.with_(
        RATED,
        """, o AS (SELECT *, row_number() OVER (ORDER BY other DESC, event_id) <= round_even(0.05 * (SELECT count(*) FROM rated), 0) AS hit FROM rated),
 p AS (SELECT 'all normal' AS population, amount FROM o WHERE label = 0 UNION ALL SELECT 'false alarms', amount FROM o WHERE label = 0 AND hit)
SELECT population, count(*) AS n, max(amount) AS maximum, round(quantile_cont(amount, 0.25), 6) AS q25, round(quantile_cont(amount, 0.5), 6) AS q50,
  round(quantile_cont(amount, 0.75), 6) AS q75 FROM p GROUP BY 1""",
    )
)
def false_alarm_profile(spark, sf_dir):
    out = E.false_alarms(rated(spark, sf_dir), "other", "label", "Amount", "event_id", 0.05)
    return rounded(out, "q25", "q50", "q75")


@query(
    sql.with_(
        RATED,
        """, cut AS (SELECT quantile_cont(other, 0.01) AS q, avg(label) AS rate FROM rated)
SELECT count(*) AS picked, CAST(sum(label) AS BIGINT) AS fraud_picked, round(any_value(rate) * count(*), 6) AS expected_fraud,
  round(sum(label) / (any_value(rate) * count(*)), 6) AS lift FROM rated, cut WHERE other <= q""",
    )
)
def lowest_lift(spark, sf_dir):
    return rounded(E.lowest_lift(rated(spark, sf_dir), "other", "label"), "expected_fraud", "lift")


@query(
    sql.with_(
        RATED,
        """, b AS (SELECT min(-amount) AS lo, max(-amount) AS hi FROM rated WHERE label = 0),
 s AS (SELECT 'min-max' AS scheme, label, least(greatest((hi + amount) / (hi - lo), 0), 1) AS v FROM rated, b UNION ALL SELECT 'negated', label, amount FROM rated
  UNION ALL SELECT 'percentile', label, (sum(1 - label) OVER () - sum(1 - label) OVER (ORDER BY -amount)) / sum(1 - label) OVER () FROM rated)
SELECT scheme, round(100 * count(*) FILTER (WHERE v >= 0.5 AND label = 0) / count(*) FILTER (WHERE label = 0), 6) AS normal_flagged_pct,
  count(*) FILTER (WHERE v >= 0.5 AND label = 1) AS fraud_caught, round(median(v) FILTER (WHERE label = 0), 6) AS normal_median,
  round(median(v) FILTER (WHERE label = 1), 6) AS fraud_median FROM s GROUP BY 1""",
    )
)
def risk_scalings(spark, sf_dir):
    df = rated(spark, sf_dir).withColumn("raw", -F.col("Amount"))
    ends = df.where("label = 0").agg(F.min("raw"), F.max("raw")).first()
    df = E.calibrated(df.where("label = 0"), df, "raw", "percentile")
    schemes = {
        "min-max": min_max_risk(F.col("raw"), F.lit(ends[0]), F.lit(ends[1])),
        "negated": negated_risk(F.col("raw")),
        "percentile": F.col("percentile"),
    }
    return rounded(E.scaling_comparison(df, schemes, "label"), "normal_flagged_pct", "normal_median", "fraud_median")


# ---------------------------------------------------------------- thresholds
@query(sql.with_(RATED, """SELECT count(*) FILTER (WHERE risk >= 0.9 AND label = 1) AS tp, count(*) FILTER (WHERE risk >= 0.9 AND label = 0) AS fp,
  count(*) FILTER (WHERE risk < 0.9 AND label = 1) AS fn, count(*) FILTER (WHERE risk < 0.9 AND label = 0) AS tn FROM rated"""))
def confusion(spark, sf_dir):
    return E.confusion_at(rated(spark, sf_dir), "risk", "label", 0.9)


_TABLE = (
    RATED
    + """, th(threshold) AS (SELECT unnest([0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999, 1.0, 1.5]::DOUBLE[])),
 k AS (SELECT threshold, count(*) FILTER (WHERE risk >= threshold) AS flagged, count(*) FILTER (WHERE risk >= threshold AND label = 1) AS tp,
   count(*) FILTER (WHERE label = 1) AS p, count(*) AS n, coalesce(sum(amount) FILTER (WHERE risk >= threshold AND label = 1), 0) AS caught,
   sum(amount) FILTER (WHERE label = 1) AS money FROM rated, th GROUP BY 1)"""
)


@query(
    sql.with_(
        _TABLE,
        """SELECT threshold, flagged, round(100 * flagged / n, 6) AS flagged_pct, tp, flagged - tp AS fp, p - tp AS fn, n - p - (flagged - tp) AS tn,
  round(CASE WHEN flagged > 0 THEN tp / flagged END, 6) AS precision, round(tp / p, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * (tp / flagged) * (tp / p) / (tp / flagged + tp / p) ELSE 0 END, 6) AS f1,
  round(100 * (flagged - tp) / (n - p), 6) AS normal_flagged_pct, round(CASE WHEN tp > 0 THEN flagged / tp END, 6) AS alerts_per_fraud,
  round(100 * caught / money, 6) AS fraud_amount_caught_pct FROM k""",
    )
)
def threshold_table(spark, sf_dir):
    out = E.threshold_table(rated(spark, sf_dir), "risk", "label", (*E.DEFAULT_THRESHOLDS, 1.0, 1.5), "Amount")
    return rounded(out, *(c for c in out.columns if c not in ("threshold", "flagged", "tp", "fp", "fn", "tn")))


@query(sql.with_(_TABLE, """SELECT max_by(threshold, (tp / flagged, -threshold)) AS threshold, round(max(tp / flagged), 6) AS precision FROM k WHERE flagged > 0"""))
def best_precision(spark, sf_dir):
    out = E.best_precision(E.threshold_table(rated(spark, sf_dir), "risk", "label", (*E.DEFAULT_THRESHOLDS, 1.0, 1.5)))
    return rounded(out, "precision")


@query(sql.with_(_TABLE, """SELECT threshold, round((1 - threshold) * 100, 6) AS expected_pct, round(100 * (flagged - tp) / (n - p), 6) AS actual_pct, tp AS fraud_caught, p AS frauds
  FROM k WHERE threshold IN (0.9, 0.99, 0.995, 0.999)"""))
def alert_budget_check(spark, sf_dir):
    out = E.budget_calibration(rated(spark, sf_dir), "risk", "label", (0.9, 0.99, 0.995, 0.999))
    return rounded(out, "expected_pct", "actual_pct")


@query(
    sql.with_(
        RATED,
        """, th(threshold) AS (SELECT unnest([0.5, 0.7, 0.9]::DOUBLE[]))
SELECT threshold, count(*) FILTER (WHERE risk >= threshold) AS stub_flagged, count(*) FILTER (WHERE risk >= threshold AND label = 1) AS stub_tp,
  count(*) FILTER (WHERE other >= threshold) AS other_flagged, count(*) FILTER (WHERE other >= threshold AND label = 1) AS other_tp FROM rated, th GROUP BY 1""",
    )
)
def models_side_by_side(spark, sf_dir):
    df, at = rated(spark, sf_dir), (0.5, 0.7, 0.9)
    tables = [E.threshold_table(df, s, "label", at).select("threshold", "flagged", "tp") for s in ("risk", "other")]
    return E.side_by_side(*tables, "threshold", ("stub", "other"))


# -------------------------------------------------------------------- policy
def _grid(values):
    return "[" + ", ".join(repr(v) for v in values) + "]::DOUBLE[]"


def priced_sql(score="risk", grid=P.PROBABILITY_GRID, review=5.0, block=50.0, fee=15.0):
    return (
        RATED
        + f""", edges AS (SELECT unnest({_grid(grid)}) AS e),
 totals AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS frauds, sum(amount + {fee}) FILTER (WHERE label = 1) AS loss FROM rated),
 upto AS (SELECT e, count(*) FILTER (WHERE label = 0 AND {score} >= e) AS normals, count(*) FILTER (WHERE label = 1 AND {score} >= e) AS frauds,
   coalesce(sum(amount + {fee}) FILTER (WHERE label = 1 AND {score} >= e), 0) AS loss FROM rated, edges GROUP BY e),
 blocks AS (SELECT e, normals, frauds FROM upto UNION ALL SELECT NULL, 0, 0),
 priced AS (SELECT r.e AS review_threshold, b.e AS block_threshold, (r.normals + r.frauds - b.normals - b.frauds) / t.n AS review_rate,
   (b.normals + b.frauds) / t.n AS block_rate, r.frauds / t.frauds AS fraud_stopped, r.loss / t.loss AS fraud_loss_stopped,
   {review} * (r.normals + r.frauds - b.normals - b.frauds) * 100000 / t.n AS review_cost, {block} * b.normals * 100000 / t.n AS block_cost,
   (t.loss - r.loss) * 100000 / t.n AS missed_fraud_cost,
   {review} * (r.normals + r.frauds - b.normals - b.frauds) * 100000 / t.n + {block} * b.normals * 100000 / t.n + (t.loss - r.loss) * 100000 / t.n AS cost_per_100k,
   (t.loss) * 100000 / t.n AS no_model_cost_per_100k
   FROM upto r JOIN blocks b ON b.e IS NULL OR b.e >= r.e, totals t)"""
    )


RATES = ("review_rate", "block_rate", "fraud_stopped", "fraud_loss_stopped")
COSTS = ("review_cost", "block_cost", "missed_fraud_cost", "cost_per_100k")


def priced(spark, sf_dir, score="risk"):
    return P.policy_costs(
        rated(spark, sf_dir), "label", score, "Amount", P.Costs(), P.PROBABILITY_GRID, (*P.PROBABILITY_GRID, None)
    )


@query(
    sql.with_(
        priced_sql(),
        "SELECT review_threshold, block_threshold, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in RATES)
        + ", "
        + ", ".join(f"round({c}, 3) AS {c}" for c in COSTS)
        + " FROM priced",
    )
)
def policy_costs(spark, sf_dir):
    return rounded(rounded(priced(spark, sf_dir), *RATES), *COSTS, places=3)


_ORDER = "ORDER BY block_rate, review_rate, cost_per_100k, review_threshold, block_threshold NULLS LAST"


@query(
    sql.with_(
        priced_sql(),
        f""", f AS (SELECT * FROM priced WHERE review_rate <= 0.3), m AS (SELECT * FROM f WHERE cost_per_100k <= (SELECT min(cost_per_100k) FROM f) * 1.02 {_ORDER} LIMIT 1)
SELECT review_threshold, block_threshold, round(cost_per_100k, 3) AS cost_per_100k, round(review_rate, 6) AS review_rate, round(block_rate, 6) AS block_rate FROM m""",
    )
)
def choose_thresholds(spark, sf_dir):
    out = P.choose_thresholds(priced(spark, sf_dir), 0.3)
    return rounded(rounded(out, "cost_per_100k", places=3), "review_rate", "block_rate")


_SUMMARY = """round(review_rate, 6) AS reviewed_rate, round(block_rate, 6) AS blocked_rate, round(fraud_stopped, 6) AS fraud_stopped,
  round(fraud_loss_stopped, 6) AS fraud_loss_stopped, round(cost_per_100k, 3) AS cost_per_100k, round(no_model_cost_per_100k, 3) AS no_model_cost_per_100k,
  round(1 - cost_per_100k / no_model_cost_per_100k, 6) AS saving_vs_no_model FROM priced WHERE review_threshold = 0.24 AND block_threshold = 0.95"""


def _summary(out):
    out = rounded(out, "cost_per_100k", "no_model_cost_per_100k", places=3)
    return rounded(out, "reviewed_rate", "blocked_rate", "fraud_stopped", "fraud_loss_stopped", "saving_vs_no_model")


@query(sql.with_(priced_sql(), f"SELECT {_SUMMARY}"))
def policy_summary(spark, sf_dir):
    return _summary(P.policy_summary(rated(spark, sf_dir), "label", "risk", "Amount", 0.24, 0.95))


@query("SELECT * FROM (" + sql.with_(priced_sql(), f"SELECT 'stub' AS scorer, {_SUMMARY}") + ") UNION ALL SELECT * FROM (" + sql.with_(priced_sql("other"), f"SELECT 'other' AS scorer, {_SUMMARY}") + ")")
def policy_comparison(spark, sf_dir):
    df = rated(spark, sf_dir)
    parts = [
        _summary(P.policy_summary(df, "label", s, "Amount", 0.24, 0.95)).withColumn("scorer", F.lit(name))
        for s, name in (("risk", "stub"), ("other", "other"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    sql.with_(
        priced_sql(review=1.0, block=1.0),
        f""", sc AS (SELECT r, b FROM (VALUES (2.0::DOUBLE), (5.0), (10.0)) x(r), (VALUES (20.0::DOUBLE), (50.0), (200.0)) y(b)),
 p AS (SELECT priced.* EXCLUDE (cost_per_100k), r, b, r * review_cost + b * block_cost + missed_fraud_cost AS cost_per_100k FROM priced, sc WHERE review_rate <= 0.3),
 t AS (SELECT *, min(cost_per_100k) OVER (PARTITION BY r, b) AS least_cost FROM p),
 c AS (SELECT *, row_number() OVER (PARTITION BY r, b {_ORDER}) AS place FROM t WHERE cost_per_100k <= least_cost * 1.02)
SELECT r AS scenario_review_cost, b AS scenario_block_cost, review_threshold, block_threshold, round(review_rate, 6) AS review_rate, round(block_rate, 6) AS block_rate,
  round(1 - cost_per_100k / no_model_cost_per_100k, 6) AS saving_vs_no_model FROM c WHERE place = 1""",
    )
)
def cost_sensitivity(spark, sf_dir):
    scenarios = [P.Costs(r, b) for r in (2.0, 5.0, 10.0) for b in (20.0, 50.0, 200.0)]
    out = P.sensitivity(rated(spark, sf_dir), "label", "risk", "Amount", scenarios, 0.3)
    return rounded(out, "review_rate", "block_rate", "saving_vs_no_model")


@query(
    sql.with_(
        priced_sql(),
        """, c AS (SELECT * FROM priced WHERE review_rate <= 0.3 ORDER BY cost_per_100k, review_threshold, block_threshold NULLS LAST LIMIT 5)
SELECT review_threshold, block_threshold, round(review_rate, 6) AS review_rate, round(cost_per_100k, 3) AS cost_per_100k FROM c""",
    )
)
def cheapest_policies(spark, sf_dir):
    out = P.cheapest(priced(spark, sf_dir), 5, 0.3).select("review_threshold", "block_threshold", "review_rate", "cost_per_100k")
    return rounded(rounded(out, "review_rate"), "cost_per_100k", places=3)


@query(
    sql.with_(
        priced_sql(),
        """SELECT review_threshold, round(review_cost, 3) AS review_cost, round(missed_fraud_cost, 3) AS missed_fraud_cost, round(cost_per_100k, 3) AS cost_per_100k,
  review_rate > 0.3 AS over_capacity FROM priced WHERE block_threshold IS NULL""",
    )
)
def cost_curve(spark, sf_dir):
    return rounded(P.cost_curve(priced(spark, sf_dir), 0.3), "review_cost", "missed_fraud_cost", "cost_per_100k", places=3)


@query(
    sql.with_(
        RATED,
        """, d AS (SELECT CASE WHEN risk >= 0.95 THEN 'block' WHEN risk >= 0.24 THEN 'review' ELSE 'approve' END AS decision, label FROM rated)
SELECT decision, count(*) FILTER (WHERE label = 1) AS fraud, count(*) FILTER (WHERE label = 0) AS normal FROM d GROUP BY 1""",
    )
)
def decision_crosstab(spark, sf_dir):
    df = rated(spark, sf_dir).withColumn("decision", decide(F.col("risk"), Thresholds()))
    return P.crosstab(df, "decision", "label")


@query(
    sql.with_(
        RATED,
        """SELECT round(sum(CASE WHEN label = 1 THEN amount + 15 ELSE 0 END) * 100000 / count(*), 3) AS no_model_cost_per_100k, 0.9::DOUBLE AS break_even_precision FROM rated""",
    )
)
def approve_all(spark, sf_dir):
    out = P.approve_all_cost(rated(spark, sf_dir), "label", "Amount", P.Costs())
    return rounded(out, "no_model_cost_per_100k", places=3).withColumn(
        "break_even_precision", F.lit(break_even_precision(5.0, 50.0))
    )


# ----------------------------------------------------- the ranking primitive
@query("SELECT l_orderkey, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber) - 1 AS position FROM lineitem")
def total_positions(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    order = ["l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return row_index(line, order).select("l_orderkey", "l_extendedprice", "position")


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
  round(quantile_cont(l_extendedprice, 0.99), 6) AS q99 FROM lineitem GROUP BY 1""")
def exact_price_quantiles(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    out = exact_quantiles(line, "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q99": 0.99}, ["l_returnflag"])
    return rounded(out, "q25", "q50", "q99")


@query(
    """WITH g AS (SELECT l_extendedprice AS s, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS pos FROM lineitem GROUP BY 1),
 c AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS flagged, sum(pos) OVER (ORDER BY s DESC) AS tp FROM g)
SELECT round(sum(pos * tp / flagged) / sum(pos), 6) AS pr_auc, CAST(sum(n) AS BIGINT) AS n FROM c"""
)
def average_precision_lineitem(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        "l_extendedprice", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label")
    )
    return rounded(E.metrics(line, "l_extendedprice", "label").select("pr_auc", "n"), "pr_auc")
