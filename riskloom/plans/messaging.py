"""Message and rollup queries. Messages are built from `events` inside Spark, some of
them broken on purpose; requests are `events` seen as calls to a scoring service."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import rules as R
from riskloom.operators import contract as C
from riskloom.operators import rollups as O
from riskloom.operators.prep import RAW_FEATURES, V_COLUMNS
from riskloom.plans import sql
from riskloom.plans.activity import decisions, joined, scored
from riskloom.plans.quality import rounded
from riskloom.plans.registry import query
from riskloom.plans.tables import LIMITS, stub_risk, transactions
from riskloom.sources import messages as M
from riskloom.sources.tables import spread


def full_transactions(spark, sf_dir):
    """Every contract field: 28 numbers follow from the event id."""
    tx = transactions(spark, sf_dir)
    made = {f"V{i}": (F.pmod(F.col("event_id") * i, F.lit(97)) / 10 - 4).cast("double") for i in range(1, 29)}
    return tx.withColumns({**made, "country": F.upper(F.substring("country", 1, 2)), "merchant": F.lit("fuel-stop")})


def messages(spark, sf_dir, broken=True):
    """One record per event over three partitions; ten kinds of damage by event id."""
    tx = spread(full_transactions(spark, sf_dir))
    kind = F.pmod(F.col("event_id"), F.lit(40)).cast("int")
    fields = ("transaction_id", *RAW_FEATURES, "card_id", "merchant", "country")
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    sent_id = F.col("transaction_id")
    if broken:
        text = (
            F.when(kind == 0, F.lit(None).cast("string"))
            .when(kind == 1, F.lit("hello"))
            .when(kind == 2, F.lit("[1, 2, 3]"))
            .when(kind == 3, F.regexp_replace(text, '"V14":[^,]*,', ""))
            .when(kind == 4, F.regexp_replace(text, r"\}$", ',"Class":1}'))
            .when(kind == 5, F.regexp_replace(text, '"V3":[^,]*,', '"V3":NaN,'))
            .when(kind == 6, F.regexp_replace(F.regexp_replace(text, '"V14":[^,]*,', ""), '"Amount":[^,]*,', '"Amount":-5,'))
            .when(kind == 7, F.regexp_replace(text, '"transaction_id":"[^"]*",', ""))
            .when(kind == 9, F.concat(text, F.repeat(F.lit(" "), 16_385 - F.length(text))))
            .otherwise(text)
        )
        # Kind 8 is sent under another key.
        sent_id = F.when(kind == 8, F.lit("somebody-else")).otherwise(sent_id)
    return tx.select(
        "event_id",
        sent_id.cast("binary").alias("key"),
        text.cast("binary").alias("value"),
        F.lit("transactions").alias("topic"),
        F.pmod(F.col("event_id"), F.lit(3)).cast("int").alias("partition"),
        F.floor(F.col("event_id") / 3).alias("offset"),
        F.timestamp_micros("arrival_us").alias("timestamp"),
    )


_BROKEN = (
    sql.TX
    + """, sent AS (SELECT *, event_id % 40 AS kind, CAST(event_id % 3 AS INT) AS partition, event_id // 3 AS "offset" FROM tx),
 judged AS (SELECT *, CASE kind WHEN 0 THEN 'empty message' WHEN 1 THEN 'Invalid JSON' WHEN 2 THEN 'Input should be an object' WHEN 3 THEN 'V14: Field required'
   WHEN 4 THEN 'Class: Extra inputs are not permitted' WHEN 5 THEN 'V3: Input should be a finite number'
   WHEN 6 THEN 'V14: Field required; Amount: Input should be greater than or equal to 0' WHEN 7 THEN 'transaction_id: required on the stream'
   WHEN 8 THEN 'key does not match transaction_id' WHEN 9 THEN 'message is 16385 bytes; a transaction is at most 16384' END AS problem FROM sent)"""
)


# ------------------------------------------------------------------ messages
@query(sql.with_(_BROKEN, """SELECT transaction_id, card_id, amount, t AS "time", (event_id * 17 % 97) / 10 - 4 AS v17 FROM judged WHERE problem IS NULL"""))
def decode_valid(spark, sf_dir):
    ok = C.decode(messages(spark, sf_dir)).where("problem is null")
    return ok.select("transaction_id", "card_id", F.col("Amount").alias("amount"), F.col("Time").alias("time"), F.col("V17").alias("v17"))


@query(sql.with_(_BROKEN, 'SELECT event_id, problem FROM judged WHERE problem IS NOT NULL'))
def decode_errors(spark, sf_dir):
    return C.decode(messages(spark, sf_dir)).where("problem is not null").select("event_id", "problem")


@query(
    sql.with_(
        _BROKEN,
        """SELECT CASE WHEN kind = 8 THEN 'somebody-else' ELSE transaction_id END AS key, CASE kind WHEN 0 THEN '' WHEN 1 THEN 'hello' WHEN 2 THEN '[1, 2, 3]' ELSE 'json' END AS body,
  problem AS reason, 'transactions' AS source_topic, CAST(partition AS VARCHAR) AS source_partition, CAST("offset" AS VARCHAR) AS source_offset,
  '2026-09-16T12:00:00+00:00' AS failed_at FROM judged WHERE problem IS NOT NULL""",
    )
)
def dead_letters(spark, sf_dir):
    refused = C.decode(messages(spark, sf_dir)).where("problem is not null")
    letters = M.dead_letters(refused, F.to_timestamp(F.lit("2026-09-16 12:00:00")))
    body = F.col("value").cast("string")
    names = {"reason": M.REASON, "source_topic": M.TOPIC, "source_partition": M.PARTITION, "source_offset": M.OFFSET, "failed_at": M.FAILED_AT}
    return letters.select(
        F.col("key").cast("string").alias("key"),
        F.when(body.startswith("{"), "json").otherwise(body).alias("body"),
        *(M.header(F.col("headers"), h).alias(n) for n, h in names.items()),
    )


def redelivered(spark, sf_dir):
    """Intact messages where every purchase is sent again later under the same id."""
    base = messages(spark, sf_dir, broken=False)
    bought = transactions(spark, sf_dir).where("country = 'purchase'").select("event_id")
    again = base.join(bought, "event_id").withColumns(
        {
            "offset": F.col("offset") + 10_000_000,
            "value": F.regexp_replace(F.col("value").cast("string"), '"Amount":[^,]*,', '"Amount":99.5,').cast("binary"),
        }
    )
    return base.unionByName(again)


@query(sql.with_(sql.TX, """SELECT transaction_id, CASE WHEN country = 'purchase' THEN 99.5 ELSE amount END AS amount,
  CASE WHEN country = 'purchase' THEN event_id // 3 + 10000000 ELSE event_id // 3 END AS "offset" FROM tx"""))
def dedupe_last_wins(spark, sf_dir):
    kept = M.last_wins(C.decode(redelivered(spark, sf_dir)).where("problem is null"))
    return kept.select("transaction_id", F.col("Amount").alias("amount"), "offset")


@query(sql.with_(_BROKEN, "SELECT 'transactions' AS topic, partition, max(\"offset\") + 1 AS resume_at FROM judged GROUP BY 2"))
def commit_offsets(spark, sf_dir):
    return M.commit_offsets(messages(spark, sf_dir))


@query(
    sql.with_(
        sql.TX,
        """SELECT count(*) + count(*) FILTER (WHERE country = 'purchase') AS consumed, count(*) AS scored, CAST(0 AS BIGINT) AS dead_lettered,
  count(*) FILTER (WHERE country = 'purchase') AS duplicates FROM tx""",
    )
)
def batch_outcomes(spark, sf_dir):
    return M.outcome_counts(C.decode(redelivered(spark, sf_dir)))


@query(sql.with_(_BROKEN, "SELECT CASE WHEN problem IS NULL THEN 'scored' ELSE 'dead_lettered' END AS outcome, count(*) AS messages FROM judged GROUP BY 1 UNION ALL SELECT 'duplicate', 0"))
def message_outcomes(spark, sf_dir):
    return M.outcomes(M.outcome_counts(C.decode(messages(spark, sf_dir))))


@query(
    sql.with_(
        sql.TX,
        """, sent AS (SELECT transaction_id FROM tx UNION ALL SELECT transaction_id FROM tx WHERE country = 'purchase'),
 g AS (SELECT transaction_id, count(*) AS n FROM sent GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (WHERE n > 1) AS repeated,
  (SELECT string_agg(transaction_id, ', ' ORDER BY transaction_id) FROM (SELECT transaction_id FROM g WHERE n > 1 ORDER BY 1 LIMIT 10)) AS first_repeated, false AS accepted FROM g""",
    )
)
def batch_contract(spark, sf_dir):
    tx = transactions(spark, sf_dir).select("transaction_id", "country")
    return C.batch_problems(tx.unionByName(tx.where("country = 'purchase'")))


@query(
    sql.with_(
        _BROKEN,
        """, ends AS (SELECT partition, max("offset") + 1 AS high_water, max("offset") FILTER (WHERE country = 'purchase') + 1 AS position FROM judged GROUP BY 1)
SELECT partition, high_water - position AS lag, (SELECT CAST(sum(high_water - position) AS BIGINT) FROM ends) AS total_lag FROM ends""",
    )
)
def lag_by_partition(spark, sf_dir):
    """A reader that has got as far as the last purchase of each partition."""
    bought = messages(spark, sf_dir, broken=False).join(transactions(spark, sf_dir).select("event_id", "country"), "event_id")
    ends = bought.groupBy("partition").agg(
        (F.max("offset") + 1).alias("high_water"),
        (F.max(F.when(F.col("country") == "purchase", F.col("offset"))) + 1).alias("position"),
    )
    total = M.total_lag(ends).first()[0]
    return M.lag(ends).select("partition", "lag", F.lit(total).cast("bigint").alias("total_lag"))


@query(
    sql.with_(
        sql.TX,
        """, bad AS (SELECT transaction_id, CASE WHEN country = 'view' THEN 'card 1' WHEN country = 'click' THEN '-' || card_id ELSE card_id END AS card_id,
   CASE WHEN country = 'error' THEN 'gb' ELSE 'GB' END AS country FROM tx)
SELECT transaction_id, CASE WHEN NOT regexp_full_match(card_id, '[A-Za-z0-9][A-Za-z0-9._:-]{0,63}') THEN 'card_id: String should match pattern ''^[A-Za-z0-9][A-Za-z0-9._:-]{0,63}$''' END AS card_problem,
  CASE WHEN NOT regexp_full_match(country, '[A-Z]{2}') THEN 'country: String should match pattern ''^[A-Z]{2}$''' END AS country_problem FROM bad""",
    )
)
def entity_problems(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    bad = tx.select(
        "transaction_id",
        F.when(F.col("country") == "view", F.lit("card 1")).when(F.col("country") == "click", F.concat(F.lit("-"), "card_id")).otherwise(F.col("card_id")).alias("card_id"),
        F.when(F.col("country") == "error", "gb").otherwise("GB").alias("country"),
    )
    return bad.select("transaction_id", C.entity_problem("card_id").alias("card_problem"), C.entity_problem("country").alias("country_problem"))


@query(sql.with_(sql.TX, """SELECT transaction_id AS key, t AS "Time", (event_id * 1 % 97) / 10 - 4 AS "V1", (event_id * 28 % 97) / 10 - 4 AS "V28", amount AS "Amount" FROM tx"""))
def encoded_messages(spark, sf_dir):
    """Encoded as messages and read back with a plain JSON reader."""
    encoded = M.encode(full_transactions(spark, sf_dir))
    doc = F.from_json(F.col("value").cast("string"), ", ".join(f"{n} double" for n in ("Time", *V_COLUMNS, "Amount")))
    return encoded.select(F.col("key").cast("string").alias("key"), doc.alias("d")).select("key", "d.Time", "d.V1", "d.V28", "d.Amount")


# ------------------------------------------------------------------- rollups
def _source():
    return F.when(F.col("country") == "purchase", "api").otherwise("stream")


@query(sql.with_(sql.SCORED, "SELECT decision, CASE WHEN country = 'purchase' THEN 'api' ELSE 'stream' END AS source, count(*) AS decisions FROM scored GROUP BY ALL"))
def decisions_by_source(spark, sf_dir):
    return O.decisions_by_source(scored(spark, sf_dir, keep=["country"]).withColumn("source", _source()))


@query(sql.with_(sql.SCORED, "SELECT unnest(string_split(reasons, ',')) AS rule, count(*) AS escalations FROM scored WHERE decision <> model_decision GROUP BY 1"))
def escalations_by_rule(spark, sf_dir):
    return O.escalations_by_rule(decisions(spark, sf_dir))


@query(sql.with_(sql.SCORED, """SELECT rule, CASE rule WHEN 'many_in_a_minute' THEN 'more than 1 transactions on this card in a minute'
  WHEN 'many_in_an_hour' THEN 'more than 5 transactions on this card in an hour' WHEN 'back_to_back' THEN 'another transaction on this card less than 1800s earlier' ELSE rule END AS description, count(*) AS fired
  FROM (SELECT unnest(string_split(reasons, ',')) AS rule FROM scored WHERE reasons <> '') GROUP BY ALL"""))
def rule_descriptions(spark, sf_dir):
    """With one rule left out of the registry, which then describes itself."""
    from riskloom.operators.decisions import rule_counts

    known = [r for r in R.velocity_rules(LIMITS) if r.name != "several_countries"]
    return R.described(rule_counts(decisions(spark, sf_dir)), "rule", known)


@query(
    sql.with_(
        sql.TX,
        """, e(le) AS (VALUES (0.001::DOUBLE), (0.01), (0.05), (0.24), (0.5), (0.95), (1.0), ('inf'::DOUBLE)), s AS (SELECT risk, CASE WHEN country = 'purchase' THEN 'api' ELSE 'stream' END AS source FROM tx)
SELECT source, CAST(le AS VARCHAR) AS le, count(*) FILTER (WHERE risk <= le) AS cumulative, count(*) AS count, round(sum(risk), 6) AS sum FROM s, e GROUP BY source, le""",
    )
)
def risk_le_histogram(spark, sf_dir):
    tx = transactions(spark, sf_dir).select("country", stub_risk().alias("risk")).withColumn("source", _source())
    out = rounded(O.cumulative_histogram(tx, F.col("risk"), O.RISK_BUCKETS, ["source"]), "sum")
    return out.withColumn("le", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")))


def requests(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    path = (
        F.when(F.col("country") == "view", F.concat(F.lit("/transactions/"), "transaction_id"))
        .when(F.col("country") == "purchase", "/score")
        .when(F.col("country") == "click", "/score/batch")
        .when(F.col("country") == "signup", "/metrics")
        .otherwise(F.concat(F.lit("/scan/"), "card_id", F.lit("/x")))
    )
    return tx.select(
        F.when(F.col("country").isin("purchase", "click"), "POST").otherwise("GET").alias("method"),
        path.alias("path"),
        F.when(F.col("Amount") > 150, 500).when(F.col("country") == "error", 404).otherwise(200).alias("status"),
        (F.col("Amount") / 1000).alias("latency_s"),
        F.pmod(F.substring("card_id", 6, 9).cast("bigint"), F.lit(6)).cast("int").alias("stage"),
        "arrival_us",
    )


_REQUESTS = (
    sql.TX
    + """, requests AS (SELECT CASE WHEN country IN ('purchase', 'click') THEN 'POST' ELSE 'GET' END AS method,
   CASE country WHEN 'view' THEN '/transactions/{transaction_id}' WHEN 'purchase' THEN '/score' WHEN 'click' THEN '/score/batch' WHEN 'signup' THEN '/metrics' ELSE 'unmatched' END AS route,
   CAST(CASE WHEN amount > 150 THEN 500 WHEN country = 'error' THEN 404 ELSE 200 END AS INT) AS status, amount / 1000 AS latency_s,
   CAST(CAST(substr(card_id, 6) AS BIGINT) % 6 AS INT) AS stage, us FROM tx),
 summary AS (SELECT stage, count(*) FILTER (WHERE status = 200) AS requests, count(*) FILTER (WHERE status <> 200) AS errors,
   count(*) FILTER (WHERE status = 200) / ((max(us) - min(us)) / 1e6) AS throughput,
   quantile_disc(latency_s, 0.5) FILTER (WHERE status = 200) AS p50, quantile_disc(latency_s, 0.95) FILTER (WHERE status = 200) AS p95,
   quantile_disc(latency_s, 0.99) FILTER (WHERE status = 200) AS p99 FROM requests GROUP BY 1)"""
)


@query(sql.with_(_REQUESTS, "SELECT method, route, status, count(*) AS requests, round(sum(latency_s), 6) AS seconds FROM requests WHERE route <> '/metrics' GROUP BY ALL"))
def request_rollup(spark, sf_dir):
    return rounded(O.request_rollup(requests(spark, sf_dir)), "seconds")


@query(
    sql.with_(
        _REQUESTS,
        """, e(le) AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, CAST('inf' AS DOUBLE)]))
SELECT method, route, CAST(le AS VARCHAR) AS le, count(*) FILTER (WHERE latency_s <= le) AS cumulative, count(*) AS count, round(sum(latency_s), 6) AS sum FROM requests, e GROUP BY method, route, le""",
    )
)
def request_latency(spark, sf_dir):
    routed = requests(spark, sf_dir).withColumn("route", O.route_of(F.col("path")))
    out = rounded(O.cumulative_histogram(routed, F.col("latency_s"), O.LATENCY_BUCKETS, ["method", "route"]), "sum")
    return out.withColumn("le", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")))


def stages(spark, sf_dir):
    log = requests(spark, sf_dir)
    spans = log.groupBy("stage").agg(((F.max("arrival_us") - F.min("arrival_us")) / 1e6).alias("seconds"))
    return O.stage_summary(log, "stage", spans)


@query(sql.with_(_REQUESTS, "SELECT stage, requests, errors, round(throughput, 9) AS throughput, p50, p95, p99 FROM summary"))
def stage_percentiles(spark, sf_dir):
    return rounded(stages(spark, sf_dir), "throughput", places=9)


@query(
    sql.with_(
        _REQUESTS,
        """, shaped AS (SELECT stage, throughput, p95 * (1 + stage * stage) AS p95 FROM summary),
 n AS (SELECT *, lead(throughput) OVER (ORDER BY stage) AS t2, lead(p95) OVER (ORDER BY stage) AS l2 FROM shaped)
SELECT stage, round(throughput, 9) AS throughput, round(p95, 9) AS p95 FROM n WHERE t2 < throughput * 1.1 AND l2 > p95 * 1.5 ORDER BY stage LIMIT 1""",
    )
)
def load_knee(spark, sf_dir):
    """Latencies stretched with the stage, as a saturated service would show."""
    stretched = stages(spark, sf_dir).withColumn("p95", F.col("p95") * (1 + F.col("stage") * F.col("stage")))
    return rounded(O.knee(stretched, "stage"), "throughput", "p95", places=9)


@query(
    sql.with_(
        _REQUESTS,
        """, scrapes AS (SELECT stage, us, sum(latency_s) OVER w AS total, count(*) OVER w AS n FROM requests WINDOW w AS (PARTITION BY stage ORDER BY us)),
 ends AS (SELECT stage, min_by(total, us) AS t1, max_by(total, us) AS t2, min_by(n, us) AS n1, max_by(n, us) AS n2 FROM scrapes GROUP BY 1)
SELECT stage, round((t2 - t1) / (n2 - n1), 6) AS server_seconds FROM ends""",
    )
)
def counter_deltas(spark, sf_dir):
    """Each instant with requests is followed by a scrape of the running total and count of its stage."""
    from riskloom.operators.ranking import running_totals

    log = requests(spark, sf_dir).groupBy("stage", F.col("arrival_us").alias("scraped_at")).agg(
        F.sum("latency_s").alias("latency_s"), F.count(F.lit(1)).alias("one")
    )
    scrapes = running_totals(log, ["scraped_at"], {"total": "latency_s", "count": "one"}, ["stage"])
    return rounded(O.counter_means(scrapes, "stage"), "server_seconds")


def batch_stats(spark, sf_dir):
    """A day of events as one batch of the stream; days with many errors met an outage."""
    rows = scored(spark, sf_dir, keep=["arrival_us", "country"])
    day = F.floor(F.col("arrival_us") / 86_400_000_000)
    per_day = rows.groupBy(day.alias("batch_id")).agg(
        F.count(F.lit(1)).alias("consumed"),
        F.count_if(F.col("country") != "error").alias("scored"),
        F.count_if(F.col("country") == "error").alias("dead_lettered"),
        F.lit(0).cast("long").alias("duplicates"),
        *(F.count_if((F.col("country") != "error") & (F.col("decision") == k)).alias(k) for k in R.KINDS),
        ((F.max("arrival_us") - F.min("arrival_us")) / 1e6).alias("seconds"),
    )
    busy = F.col("dead_lettered") * 5 > F.col("consumed")
    return per_day.withColumn("outages", F.when(busy, 1).otherwise(0)).withColumn(
        "seconds_waiting", F.when(busy, F.col("dead_lettered").cast("double")).otherwise(0.0)
    )


_STATS = (
    sql.SCORED
    + """, stats AS (SELECT us // 86400000000 AS batch_id, count(*) AS consumed, count(*) FILTER (WHERE country <> 'error') AS scored, count(*) FILTER (WHERE country = 'error') AS dead_lettered,
  count(*) FILTER (WHERE country <> 'error' AND decision = 'approve') AS approve, count(*) FILTER (WHERE country <> 'error' AND decision = 'review') AS review,
  count(*) FILTER (WHERE country <> 'error' AND decision = 'block') AS block, (max(us) - min(us)) / 1e6 AS seconds FROM scored GROUP BY 1)"""
)


@query(
    sql.with_(
        _STATS,
        """SELECT CAST(sum(consumed) AS BIGINT) AS consumed, CAST(sum(scored) AS BIGINT) AS scored, CAST(sum(dead_lettered) AS BIGINT) AS dead_lettered, CAST(0 AS BIGINT) AS duplicates,
  CAST(sum(approve) AS BIGINT) AS approve, CAST(sum(review) AS BIGINT) AS review, CAST(sum(block) AS BIGINT) AS block, count(*) AS batches, round(sum(seconds), 3) AS seconds,
  round(sum(consumed) / sum(seconds), 9) AS per_second FROM stats""",
    )
)
def stream_totals(spark, sf_dir):
    out = O.cumulative_stats(batch_stats(spark, sf_dir))
    return rounded(rounded(out, "seconds", places=3), "per_second", places=9)


@query(sql.with_(_STATS, """SELECT count(*) FILTER (WHERE dead_lettered * 5 > consumed) AS outages,
  CAST(sum(CASE WHEN dead_lettered * 5 > consumed THEN dead_lettered ELSE 0 END) AS DOUBLE) AS seconds_waiting FROM stats"""))
def outage_totals(spark, sf_dir):
    return O.outage_totals(batch_stats(spark, sf_dir))


@query(
    sql.with_(
        _STATS,
        """, e(le) AS (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 250.0, 500.0, 1000.0, CAST('inf' AS DOUBLE)]))
SELECT CAST(le AS VARCHAR) AS le, count(*) FILTER (WHERE consumed <= le) AS cumulative, count(*) AS count, CAST(sum(consumed) AS BIGINT) AS sum FROM stats, e GROUP BY le""",
    )
)
def batch_size_histogram(spark, sf_dir):
    out = O.cumulative_histogram(batch_stats(spark, sf_dir), F.col("consumed"), O.BATCH_SIZE_BUCKETS)
    return out.withColumn("le", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")))
