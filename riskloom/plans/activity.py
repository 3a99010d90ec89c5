"""Velocity, scoring and decision queries over `events`."""

from __future__ import annotations

from functools import reduce

from datetime import datetime, timezone

from pyspark.sql import functions as F

from riskloom.functions import rules as R
from riskloom.operators import batch
from riskloom.operators import decisions as D
from riskloom.operators import scoring as S
from riskloom.operators import velocity as V
from riskloom.plans import sql
from riskloom.plans.registry import query
from riskloom.session import run_folder
from riskloom.plans.tables import LIMITS, THRESHOLDS, VERSION, WINDOWS, stub_risk, transactions


def measured(spark, sf_dir, windows=WINDOWS):
    return V.measure(transactions(spark, sf_dir), windows)


def scored(spark, sf_dir, keep=()):
    return S.score(measured(spark, sf_dir), stub_risk(), THRESHOLDS, VERSION, R.velocity_rules(LIMITS), keep)


def decisions(spark, sf_dir):
    """Each event scored the moment it arrived."""
    results = scored(spark, sf_dir, keep=["arrival_us"])
    return D.to_rows(results, F.timestamp_micros("arrival_us"))


def joined(column):
    return F.concat_ws(",", column)


# ------------------------------------------------------------------ velocity
@query(sql.with_(sql.VELOCITY, "SELECT transaction_id, CAST(c1m AS INT) AS count_1m, CAST(c5m AS INT) AS count_5m, CAST(c1h AS INT) AS count_1h FROM velocity"))
def velocity_counts(spark, sf_dir):
    return measured(spark, sf_dir).select("transaction_id", "velocity.count_1m", "velocity.count_5m", "velocity.count_1h")


@query(sql.with_(sql.VELOCITY, "SELECT transaction_id, amount_1h FROM velocity"))
def velocity_amount(spark, sf_dir):
    return measured(spark, sf_dir).select("transaction_id", "velocity.amount_1h")


@query(sql.with_(sql.VELOCITY, "SELECT transaction_id, CAST(places AS INT) AS countries_1h FROM velocity"))
def velocity_countries(spark, sf_dir):
    return measured(spark, sf_dir).select("transaction_id", "velocity.countries_1h")


@query(sql.with_(sql.VELOCITY, "SELECT transaction_id, gap AS seconds_since_previous FROM velocity"))
def velocity_gap(spark, sf_dir):
    return measured(spark, sf_dir).select("transaction_id", "velocity.seconds_since_previous")


@query(
    sql.with_(
        sql.TX,
        """, kept AS (
  SELECT transaction_id, us,
    list({'us': us, 'cents': CAST(round(amount * 100) AS BIGINT), 'country': country})
      OVER (PARTITION BY card_id ORDER BY us ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS h
  FROM tx), live AS (
  SELECT transaction_id, us, list_filter(h, lambda e: e.us > us - 864000000000) AS h FROM kept)
SELECT transaction_id,
  CAST(len(list_filter(h, lambda e: e.us >= us - 86400000000)) AS INT) AS count_1m,
  CAST(len(list_filter(h, lambda e: e.us >= us - 432000000000)) AS INT) AS count_5m,
  CAST(len(h) AS INT) AS count_1h,
  CAST(list_sum(list_transform(h, lambda e: e.cents)) AS DOUBLE) / 100.0 AS amount_1h,
  CAST(list_unique(list_transform(h, lambda e: e.country)) AS INT) AS countries_1h
FROM live""",
    )
)
def velocity_capped(spark, sf_dir):
    """Windows of 1, 5 and 10 days with only the five newest events kept, so that the cap binds."""
    windows = V.VelocityWindows(short=86_400, middle=432_000, long=864_000, keep=5)
    return measured(spark, sf_dir, windows).select(
        "transaction_id", *(f"velocity.{n}" for n in V.FEATURES if n != "seconds_since_previous")
    )


@query(
    sql.with_(
        sql.TX.replace("'card-' || user_id AS card_id", "CASE WHEN event_type <> 'view' THEN 'card-' || user_id END AS card_id"),
        """SELECT transaction_id, CASE WHEN card_id IS NOT NULL THEN CAST(count(*) OVER (PARTITION BY card_id ORDER BY us
  RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS INT) END AS count_1h, risk AS risk_score FROM tx""",
    )
)
def velocity_no_card(spark, sf_dir):
    """Views carry no card: they are scored, without features."""
    tx = transactions(spark, sf_dir)
    some = tx.withColumn("card_id", F.when(F.col("country") != "view", F.col("card_id")))
    out = S.score(V.measure(some, WINDOWS), stub_risk(), THRESHOLDS, VERSION, R.velocity_rules(LIMITS))
    return out.select("transaction_id", "velocity.count_1h", "risk_score")


@query(sql.with_(sql.TX, """SELECT transaction_id, transaction_id || '|' || printf('%.2f', amount) || '|' || country AS member,
  amount AS parsed_amount, country AS parsed_country FROM tx"""))
def velocity_members(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    member = V.member_text(F.col("transaction_id"), F.col("Amount"), F.col("country"))
    parsed = V.parse_member(F.col("member"))
    return tx.select("transaction_id", member.alias("member")).select(
        "transaction_id", "member", parsed["amount"].alias("parsed_amount"), parsed["country"].alias("parsed_country")
    )


@query(
    sql.with_(
        sql.TX,
        """, doubled AS (
  SELECT * FROM tx UNION ALL
  SELECT * REPLACE (us + 1800000000 AS us) FROM tx WHERE country = 'purchase'),
 newest AS (SELECT transaction_id, card_id, max(us) AS us FROM doubled GROUP BY ALL)
SELECT transaction_id, CAST(count(*) OVER (PARTITION BY card_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS INT) AS count_1h
FROM newest""",
    )
)
def velocity_redelivered(spark, sf_dir):
    """Purchases delivered again half an hour later move in time and are counted once."""
    tx = transactions(spark, sf_dir)
    again = tx.where("country = 'purchase'").withColumn("arrival_us", F.col("arrival_us") + 1_800_000_000)
    once = V.collapse_redeliveries(tx.unionByName(again))
    return V.measure(once, WINDOWS).select("transaction_id", "velocity.count_1h")


# ------------------------------------------------------------------ scoring
@query(sql.with_(sql.TX, """SELECT transaction_id, CASE WHEN risk >= 0.95 THEN 'block' WHEN risk >= 0.24 THEN 'review' ELSE 'approve' END AS decision,
  CASE WHEN risk >= 0.24 THEN 'review' ELSE 'approve' END AS never_blocking FROM tx"""))
def decide_levels(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    return tx.select(
        "transaction_id",
        R.decide(stub_risk(), THRESHOLDS).alias("decision"),
        R.decide(stub_risk(), R.Thresholds(0.24, None)).alias("never_blocking"),
    )


@query(sql.with_(sql.SCORED, "SELECT transaction_id, reasons, CAST(r1 AS INT) + CAST(r2 AS INT) + CAST(r3 AS INT) + CAST(r4 AS INT) AS fired FROM scored"))
def rule_reasons(spark, sf_dir):
    fired = R.reasons(R.velocity_rules(LIMITS))
    return measured(spark, sf_dir).select("transaction_id", joined(fired).alias("reasons"), F.size(fired).alias("fired"))


@query(
    sql.with_(
        sql.SCORED,
        """SELECT transaction_id, risk AS risk_score, decision, 0.24::DOUBLE AS review_threshold, 0.95::DOUBLE AS block_threshold,
  'v-test' AS model_version, card_id, model_decision, reasons FROM scored""",
    )
)
def score_events(spark, sf_dir):
    out = scored(spark, sf_dir).drop("velocity")
    return out.withColumn("reasons", joined("reasons"))


@query(
    sql.with_(
        sql.SCORED,
        """SELECT decision, model_decision, count(*) AS transactions, round(avg(risk), 6) AS mean_risk FROM scored GROUP BY ALL""",
    )
)
def score_mix(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("decision", "model_decision").agg(
        F.count(F.lit(1)).alias("transactions"), F.round(F.avg("risk_score"), 6).alias("mean_risk")
    )


@query(
    sql.with_(
        sql.TX,
        """, models AS (SELECT country AS model_version, round(min(risk), 2) AS trained_review,
    CASE WHEN country <> 'view' THEN round(max(risk), 2) END AS trained_block FROM tx GROUP BY country)
SELECT model_version, trained_review, trained_block, 0.0::DOUBLE AS served_review, 1.0::DOUBLE AS served_block
FROM models WHERE trained_review IS DISTINCT FROM 0.0 OR trained_block IS DISTINCT FROM 1.0""",
    )
)
def threshold_drift(spark, sf_dir):
    """One 'model' per event type, its thresholds taken from the data."""
    tx = transactions(spark, sf_dir)
    models = tx.groupBy(F.col("country").alias("model_version")).agg(
        F.round(F.min(stub_risk()), 2).alias("trained_review"),
        F.round(F.max(stub_risk()), 2).alias("_block"),
    )
    models = models.withColumn("trained_block", F.when(F.col("model_version") != "view", F.col("_block")))
    return S.threshold_drift(models, R.Thresholds(0.0, 1.0))


@query(
    sql.with_(
        sql.SCORED,
        """, picked AS (SELECT * FROM scored WHERE decision = 'block' ORDER BY event_id LIMIT 25)
SELECT transaction_id, card_id, amount, country FROM picked""",
    )
)
def sample_blocked(spark, sf_dir):
    out = scored(spark, sf_dir, keep=["event_id", "Amount", "country"])
    chosen = S.first_with_decision(out, "block", 25, ["event_id"])
    return chosen.select("transaction_id", "card_id", F.col("Amount").alias("amount"), "country")


def _settings(compress):
    return [
        (f"{c} countries / {h} an hour{compress}", R.velocity_rules(R.RuleLimits(1, h, c - 1, 1800.0)))
        for c, h in ((3, 4), (4, 5), (5, 8))
    ]


@query(
    sql.with_(
        sql.VELOCITY,
        """, settings(setting, c, h) AS (VALUES ('3 countries / 4 an hour', 2, 4), ('4 countries / 5 an hour', 3, 5), ('5 countries / 8 an hour', 4, 8))
SELECT setting, count(*) FILTER (WHERE risk < 0.24 AND (c1m > 1 OR c1h > h OR places > c OR coalesce(gap < 1800, false))) AS escalated,
  count(*) AS transactions,
  round(count(*) FILTER (WHERE risk < 0.24 AND (c1m > 1 OR c1h > h OR places > c OR coalesce(gap < 1800, false))) / count(*), 6) AS share
FROM velocity, settings GROUP BY setting""",
    )
)
def rule_what_if(spark, sf_dir):
    out = S.rule_what_if(measured(spark, sf_dir), R.decide(stub_risk(), THRESHOLDS), _settings(""))
    return out.withColumn("share", F.round("share", 6))


@query(
    sql.with_(
        sql.VELOCITY.replace("epoch_us(ts) AS us", "epoch_us(ts) // 10 AS us"),
        """SELECT '4 countries / 5 an hour' AS setting,
  count(*) FILTER (WHERE risk < 0.24 AND (c1m > 1 OR c1h > 5 OR places > 3 OR coalesce(gap < 1800, false))) AS escalated,
  count(*) AS transactions FROM velocity""",
    )
)
def rule_what_if_replayed(spark, sf_dir):
    """The same traffic replayed ten times faster: every card looks busier."""
    tx = transactions(spark, sf_dir).withColumn("arrival_us", F.floor(F.col("arrival_us") / 10).cast("long"))
    fast = V.measure(tx, WINDOWS)
    return S.rule_what_if(fast, R.decide(stub_risk(), THRESHOLDS), _settings("")[1:2]).drop("share")


# ------------------------------------------------------------------ decisions
_LOG = """, log AS (
  SELECT transaction_id, amount / 200 AS risk_score, 1 AS batch_id, us, card_id FROM tx WHERE amount < 200
  UNION ALL SELECT transaction_id, risk, 2, us + 3600000000, CASE WHEN country <> 'click' THEN card_id END FROM tx WHERE country IN ('purchase', 'click')
  UNION ALL SELECT transaction_id, risk * 0.5, 3, us + 3600000000, card_id FROM tx WHERE country = 'purchase')"""


@query(
    sql.with_(
        sql.TX + _LOG,
        """SELECT transaction_id, risk_score, batch_id, card_id, us AS scored_us FROM log
QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY us DESC, batch_id DESC) = 1""",
    )
)
def latest_decisions(spark, sf_dir):
    """Three batches that re-score some transactions; the newest row replaces every column."""
    tx = transactions(spark, sf_dir)
    hour = F.lit(3_600_000_000)
    base = lambda df, risk, batch, shift, card: df.select(
        "transaction_id", risk.alias("risk_score"), F.lit(batch).alias("batch_id"),
        F.timestamp_micros(F.col("arrival_us") + shift).alias("scored_at"), card.alias("card_id"))
    first = base(tx.where("Amount < 200"), F.col("Amount") / 200, 1, F.lit(0), F.col("card_id"))
    again = tx.where("country in ('purchase', 'click')")
    second = base(again, stub_risk(), 2, hour, F.when(F.col("country") != "click", F.col("card_id")))
    third = base(tx.where("country = 'purchase'"), stub_risk() * 0.5, 3, hour, F.col("card_id"))
    latest = D.latest_decisions(first.unionByName(second).unionByName(third))
    return latest.select("transaction_id", "risk_score", "batch_id", "card_id", F.unix_micros("scored_at").alias("scored_us"))


@query(
    sql.with_(
        sql.VELOCITY,
        """SELECT transaction_id, CAST(c1m AS INT) AS velocity_count_1m, CAST(c5m AS INT) AS velocity_count_5m, CAST(c1h AS INT) AS velocity_count_1h,
  amount_1h AS velocity_amount_1h, CAST(places AS INT) AS velocity_countries_1h, gap AS velocity_seconds_since_previous,
  true AS same_after_nesting FROM velocity""",
    )
)
def flatten_velocity(spark, sf_dir):
    flat = V.flatten(measured(spark, sf_dir).select("transaction_id", "velocity"))
    back = V.nest(flat.select("*", *(F.col(c).alias("copy_" + c) for c in flat.columns if c != "transaction_id")), "copy_velocity_")
    pairs = [F.col(f"velocity.{name}").eqNullSafe(F.col(f"velocity_{name}")) for name in V.FEATURES]
    same = reduce(lambda a, b: a & b, pairs)
    return back.withColumn("same_after_nesting", same).drop("velocity")


@query(sql.with_(sql.SCORED, """SELECT transaction_id, decision, us AS scored_us FROM scored WHERE decision = 'review' ORDER BY us DESC, transaction_id LIMIT 50"""))
def recent_decisions(spark, sf_dir):
    rows = D.recent(decisions(spark, sf_dir), 50, "review")
    return rows.select("transaction_id", "decision", F.unix_micros("scored_at").alias("scored_us"))


@query(sql.with_(sql.SCORED, "SELECT transaction_id, decision, risk AS risk_score, reasons FROM scored WHERE transaction_id = 'ev-4'"))
def decision_by_id(spark, sf_dir):
    row = D.by_id(decisions(spark, sf_dir), "ev-4")
    return row.select("transaction_id", "decision", "risk_score", joined("reasons").alias("reasons"))


@query(sql.with_(sql.SCORED, """, kinds(decision) AS (VALUES ('approve'), ('review'), ('block'))
SELECT k.decision, count(s.transaction_id) AS decisions FROM kinds k LEFT JOIN scored s ON s.decision = k.decision GROUP BY 1"""))
def decision_counts(spark, sf_dir):
    return D.counts_by_kind(decisions(spark, sf_dir))


@query(
    sql.with_(
        sql.SCORED,
        """SELECT count(*) AS total, count(*) FILTER (WHERE decision = 'approve') AS approve, count(*) FILTER (WHERE decision = 'review') AS review,
  count(*) FILTER (WHERE decision = 'block') AS block, count(*) FILTER (WHERE decision <> model_decision) AS escalated,
  count(DISTINCT card_id) AS cards, round(count(*) / ((max(us) - min(us)) / 1e6), 9) AS per_second,
  round(count(*) FILTER (WHERE decision = 'review') / count(*), 9) AS review_rate, round(count(*) FILTER (WHERE decision = 'block') / count(*), 9) AS block_rate,
  round(count(*) FILTER (WHERE decision <> model_decision) / count(*), 9) AS escalated_rate, min(us) AS first_us, max(us) AS last_us FROM scored""",
    )
)
def decision_summary(spark, sf_dir):
    out = D.summary(decisions(spark, sf_dir))
    rounded = [F.round(c, 9).alias(c) for c in ("per_second", "review_rate", "block_rate", "escalated_rate")]
    return out.select(
        "total", "approve", "review", "block", "escalated", "cards", *rounded,
        F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"),
    )


@query(
    sql.with_(
        sql.TX,
        """, w(s) AS (VALUES (1),(5),(15),(30),(60),(300),(900),(3600),(21600),(86400)), span AS (SELECT (max(us) - min(us)) / 1e6 AS x FROM tx),
 targets(target_buckets) AS (VALUES (60), (200), (5))
SELECT target_buckets, coalesce((SELECT min(s) FROM w, span WHERE x / s <= target_buckets), 86400) AS bucket_seconds FROM targets""",
    )
)
def bucket_width(spark, sf_dir):
    rows = transactions(spark, sf_dir).select(F.timestamp_micros("arrival_us").alias("scored_at"))
    parts = [D.bucket_width(rows, t).withColumn("target_buckets", F.lit(t)) for t in (60, 200, 5)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    sql.with_(
        sql.SCORED,
        """, c AS (SELECT us // 1000000 - (us // 1000000) % 3600 AS b, * FROM scored),
 cal AS (SELECT unnest(range((SELECT min(b) FROM c), (SELECT max(b) FROM c) + 1, 3600)) AS b)
SELECT cal.b AS bucket_second, count(*) FILTER (WHERE decision = 'approve') AS approve, count(*) FILTER (WHERE decision = 'review') AS review,
  count(*) FILTER (WHERE decision = 'block') AS block FROM cal LEFT JOIN c USING (b) GROUP BY 1""",
    )
)
def decisions_over_time(spark, sf_dir):
    out = D.over_time(decisions(spark, sf_dir), 3600)
    return out.select(F.unix_seconds("bucket_start").alias("bucket_second"), "approve", "review", "block")


@query(
    sql.with_(
        sql.TX,
        """, x AS (SELECT greatest(least(risk * risk * risk, 1.0), 1e-6) AS r FROM tx), e AS (SELECT i, pow(10, 6.0 * i / 50 - 6) AS hi FROM range(1, 51) t(i)),
 b AS (SELECT (SELECT count(*) FROM e WHERE e.hi < x.r) AS bin FROM x)
SELECT CAST(i - 1 AS INT) AS bin, round(hi, 9) AS risk_upto, (SELECT count(*) FROM b WHERE b.bin = i - 1) AS decisions FROM e""",
    )
)
def risk_histogram(spark, sf_dir):
    """Of the cubed stub risk, which spreads over several powers of ten."""
    rows = transactions(spark, sf_dir).select((stub_risk() * stub_risk() * stub_risk()).alias("risk_score"))
    return D.risk_histogram(rows, 50).withColumn("risk_upto", F.round("risk_upto", 9))


@query(sql.with_(sql.SCORED, """SELECT transaction_id, decision, us AS scored_us, reasons AS rules FROM scored WHERE decision <> model_decision AND decision <> 'approve'"""))
def review_queue(spark, sf_dir):
    queue = D.review_queue(decisions(spark, sf_dir), only_escalated=True)
    return queue.select("transaction_id", "decision", F.unix_micros("scored_at").alias("scored_us"), joined("rules").alias("rules"))


@query(sql.with_(sql.SCORED, """SELECT transaction_id, decision, us AS scored_us, reasons AS rules FROM scored WHERE decision <> 'approve'"""))
def review_queue_all(spark, sf_dir):
    queue = D.review_queue(decisions(spark, sf_dir), only_escalated=False)
    return queue.select("transaction_id", "decision", F.unix_micros("scored_at").alias("scored_us"), joined("rules").alias("rules"))


@query(sql.with_(sql.SCORED, """SELECT unnest(string_split(reasons, ',')) AS rule, count(*) AS fired FROM scored WHERE reasons <> '' GROUP BY 1"""))
def reason_counts(spark, sf_dir):
    return D.rule_counts(decisions(spark, sf_dir))


@query(
    sql.with_(
        sql.SCORED,
        """SELECT card_id, count(*) AS transactions, count(*) FILTER (WHERE decision = 'review') AS reviewed, count(*) FILTER (WHERE decision = 'block') AS blocked,
  count(*) FILTER (WHERE decision <> model_decision) AS escalated, CAST(max(c1m) AS INT) AS peak_1m, max(amount_1h) AS amount
FROM scored GROUP BY card_id ORDER BY transactions DESC, reviewed DESC, card_id LIMIT 10""",
    )
)
def busiest_cards(spark, sf_dir):
    return D.busiest_cards(decisions(spark, sf_dir), 10)


@query(sql.with_(sql.SCORED, "SELECT transaction_id, decision, us AS scored_us, reasons AS rules FROM scored WHERE card_id = 'card-7'"))
def card_history(spark, sf_dir):
    own = D.card_history(decisions(spark, sf_dir), "card-7")
    return own.select("transaction_id", "decision", F.unix_micros("scored_at").alias("scored_us"), joined("rules").alias("rules"))


@query(
    sql.with_(
        sql.TX,
        """, r AS (SELECT transaction_id, amount / 100 AS risk_score, CASE WHEN country = 'view' THEN 'unknown' ELSE 'approve' END AS decision,
   CASE WHEN country = 'click' THEN 'maybe' END AS model_decision, 0.3 AS review_threshold, CASE WHEN amount < 30 THEN amount / 100 END AS block_threshold FROM tx)
SELECT * FROM (SELECT transaction_id, concat_ws('; ', CASE WHEN NOT risk_score BETWEEN 0 AND 1 THEN 'risk_score outside [0, 1]' END,
  CASE WHEN decision = 'unknown' THEN 'unknown decision' END, CASE WHEN model_decision = 'maybe' THEN 'unknown model_decision' END,
  CASE WHEN NOT block_threshold BETWEEN 0.3 AND 1 THEN 'block_threshold outside [review_threshold, 1]' END) AS problems FROM r) WHERE problems <> ''""",
    )
)
def contract_violations(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    rows = tx.select(
        "transaction_id",
        (F.col("Amount") / 100).alias("risk_score"),
        F.when(F.col("country") == "view", "unknown").otherwise("approve").alias("decision"),
        F.when(F.col("country") == "click", "maybe").alias("model_decision"),
        F.lit(0.3).alias("review_threshold"),
        F.when(F.col("Amount") < 30, F.col("Amount") / 100).alias("block_threshold"),
    )
    return D.violations(rows).select("transaction_id", "problems")


@query(sql.with_(sql.SCORED, """, v AS (SELECT * FROM scored WHERE us >= 1705276800000000 ORDER BY us DESC, transaction_id LIMIT 1001)
SELECT transaction_id, us AS scored_us, decision, model_decision, risk AS risk_score, card_id, reasons, CAST(c1m AS INT) AS velocity_count_1m,
  CAST(c1h AS INT) AS velocity_count_1h, CAST(places AS INT) AS velocity_countries_1h, amount_1h AS velocity_amount_1h FROM v"""))
def load_decisions(spark, sf_dir):
    """Second half of the month, at most a thousand rows and one more."""
    rows = D.view(decisions(spark, sf_dir), datetime(2024, 1, 15, tzinfo=timezone.utc), 1000)
    return rows.withColumn("scored_us", F.unix_micros("scored_at")).withColumn("reasons", joined("reasons")).drop("scored_at")


@query(sql.with_(sql.SCORED, "SELECT least(count(*), 1001) AS rows, count(*) > 1000 AS truncated FROM scored WHERE us >= 1705276800000000"))
def decisions_truncated(spark, sf_dir):
    """Whether the view of the second half of the month, at most a thousand rows, leaves any out."""
    return D.truncation(D.view(decisions(spark, sf_dir), datetime(2024, 1, 15, tzinfo=timezone.utc), 1000), 1000)


# ---------------------------------------------------------------- batch job
_REDELIVERED = "FROM (SELECT * REPLACE (CASE WHEN event_type = 'purchase' THEN ts + INTERVAL 30 MINUTE ELSE ts END AS ts) FROM events))"
_SCORED_AGAIN = sql.SCORED.replace("FROM events)", _REDELIVERED, 1)


def _run_twice(spark, sf_dir):
    """A batch in which purchases come again half an hour later, run a second time as after a failure."""
    tx = transactions(spark, sf_dir)
    again = tx.where("country = 'purchase'").withColumn("arrival_us", F.col("arrival_us") + 1_800_000_000)
    path = run_folder(spark, "batch-job")
    for _ in range(2):
        report = batch.run_batch(
            tx.unionByName(again), path, 1, stub_risk(), THRESHOLDS, VERSION, WINDOWS, R.velocity_rules(LIMITS), F.timestamp_micros("arrival_us")
        )
    return path, report


@query(
    sql.with_(
        _SCORED_AGAIN,
        """SELECT transaction_id, risk AS risk_score, decision, model_decision, CAST(c1h AS INT) AS velocity_count_1h, amount_1h AS velocity_amount_1h,
  reasons, us AS scored_us FROM scored WHERE us >= 1705363200000000""",
    )
)
def batch_job_since(spark, sf_dir):
    """What the batch job recorded for 16 January and later, read from the log's files of those days."""
    path, _ = _run_twice(spark, sf_dir)
    rows = D.current_since(spark, path, datetime(2024, 1, 16, tzinfo=timezone.utc))
    return rows.select(
        "transaction_id", "risk_score", "decision", "model_decision", "velocity_count_1h", "velocity_amount_1h",
        joined("reasons").alias("reasons"), F.unix_micros("scored_at").alias("scored_us"),
    )


@query(
    sql.with_(
        _SCORED_AGAIN,
        """SELECT CAST(1 AS INT) AS batch_id, (SELECT count(*) + count(*) FILTER (event_type = 'purchase') FROM events) AS received,
  (SELECT count(*) FILTER (event_type = 'purchase') FROM events) AS repeated, count(*) AS scored, count(*) FILTER (decision = 'approve') AS approve,
  count(*) FILTER (decision = 'review') AS review, count(*) FILTER (decision = 'block') AS block FROM scored""",
    )
)
def batch_job_report(spark, sf_dir):
    return _run_twice(spark, sf_dir)[1]
