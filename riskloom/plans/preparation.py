"""Preparation and exploration queries over `events` and `lineitem`."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import identities as I
from riskloom.functions.scalars import clock_angle, cyclical_time, finite_frame, utc_timestamp
from riskloom.operators import explore as X
from riskloom.operators import prep
from riskloom.operators.ranking import with_constants
from riskloom.plans import sql
from riskloom.plans.registry import query
from riskloom.plans.quality import rounded
from riskloom.plans.tables import table, transactions
from riskloom.session import checkpointed, ship
from riskloom.sources import replay

LINE_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def events(spark, sf_dir):
    return transactions(spark, sf_dir).select("event_id", "transaction_id", "card_id", "country", "Time", "Amount", "label")


def lines(spark, sf_dir):
    """Line items with a 0/1 label; rows repeat when reduced to these columns."""
    return table(spark, sf_dir, "lineitem").select(
        *LINE_FEATURES, F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label")
    )


HASHED = (
    sql.TX
    + """, hashed AS (SELECT *, CAST(('0x' || substr(sha256('42|' || event_id), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496.0 AS h FROM tx),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, event_id) AS place, count(*) OVER (PARTITION BY label) AS size FROM hashed)"""
)


# ------------------------------------------------------------------ cleaning
@query("SELECT DISTINCT l_quantity, l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem")
def dedupe_exact(spark, sf_dir):
    return prep.deduplicate(lines(spark, sf_dir).drop("l_extendedprice"))


@query(
    """WITH g AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum((n - 1) * label) AS BIGINT) AS duplicate_fraud,
  count(*) AS rows_after, CAST(sum(label) AS BIGINT) AS fraud_after FROM g"""
)
def duplicate_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label")
    )
    return prep.duplicate_report(rows, "label")


@query(
    """WITH j AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
m AS (SELECT count(*) - count(COLUMNS(*)) FROM j)
SELECT name, missing FROM (UNPIVOT m ON COLUMNS(*) INTO NAME name VALUE missing)
UNION ALL SELECT '(all)', CAST(sum(missing) AS BIGINT) FROM (UNPIVOT m ON COLUMNS(*) INTO NAME name VALUE missing)"""
)
def missing_cells(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return prep.missing_cells(joined)


@query(sql.with_(sql.TX, "SELECT transaction_id, amount FROM tx WHERE label = 0"))
def normal_only(spark, sf_dir):
    return prep.normal_only(events(spark, sf_dir), "label").select("transaction_id", F.col("Amount").alias("amount"))


@query(
    sql.with_(
        sql.TX,
        """SELECT transaction_id, CASE WHEN country <> 'view' THEN amount END AS ratio, CASE WHEN country <> 'click' THEN amount END AS nested_value,
  CASE WHEN country = 'view' THEN 1 ELSE 0 END + CASE WHEN country = 'click' THEN 1 ELSE 0 END AS nulls_in_list FROM tx""",
    )
)
def non_finite_cleared(spark, sf_dir):
    """Views divide by zero, clicks are NaN: both must come out as null, also inside nested values."""
    value, nan, inf = F.col("Amount"), F.lit(float("nan")), F.lit(float("inf"))
    a = F.when(F.col("country") == "view", -inf).otherwise(value)
    b = F.when(F.col("country") == "click", nan).otherwise(value)
    dirty = events(spark, sf_dir).select(
        "transaction_id", a.alias("ratio"), F.struct(b.alias("value")).alias("nested"), F.array(a, b).alias("list")
    )
    clean = finite_frame(dirty)
    nulls = F.size(F.filter("list", lambda x: x.isNull()))
    return clean.select("transaction_id", "ratio", F.col("nested.value").alias("nested_value"), nulls.alias("nulls_in_list"))


@query(sql.with_(sql.TX, "SELECT transaction_id, us AS instant_us FROM tx"))
def utc_instants(spark, sf_dir):
    """Instants written with a zone offset read back as the same instant."""
    written = transactions(spark, sf_dir).select(
        "transaction_id",
        F.concat(
            F.date_format(F.timestamp_micros(F.col("arrival_us") + F.lit(19_800_000_000)), "yyyy-MM-dd HH:mm:ss.SSSSSS"),
            F.lit("+05:30"),
        ).alias("written"),
    )
    return written.select("transaction_id", F.unix_micros(utc_timestamp(written, "written")).alias("instant_us"))


# -------------------------------------------------------------------- splits
@query(sql.with_(HASHED, "SELECT event_id, label, place <= floor(size * 0.2 + 0.5) AS is_test FROM ranked"))
def stratified_split(spark, sf_dir):
    return prep.holdout(events(spark, sf_dir), "label", "event_id").select("event_id", "label", "is_test")


@query(sql.with_(HASHED, "SELECT place <= floor(size * 0.2 + 0.5) AS is_test, count(*) AS rows, CAST(sum(label) AS BIGINT) AS fraud, round(avg(label), 9) AS fraud_rate FROM ranked GROUP BY 1"))
def split_summary(spark, sf_dir):
    out = prep.split_summary(prep.holdout(events(spark, sf_dir), "label", "event_id"), "is_test", "label")
    return rounded(out, "fraud_rate", places=9)


@query(sql.with_(sql.TX, """SELECT event_id, row_number() OVER (ORDER BY floor(t / 86400), event_id) <= floor(0.8 * (SELECT count(*) FROM tx)) AS is_train FROM tx"""))
def time_split(spark, sf_dir):
    """By day, so that many rows tie at the cut."""
    days = events(spark, sf_dir).select("event_id", F.floor(F.col("Time") / 86400).alias("day"))
    return prep.time_split(days, "day", "event_id").select("event_id", "is_train")


@query(sql.with_(HASHED, "SELECT event_id, CAST((place - 1) % 5 AS INT) AS fold FROM ranked"))
def kfold_assignment(spark, sf_dir):
    return prep.folds(events(spark, sf_dir), "label", "event_id").select("event_id", "fold")


@query(sql.with_(HASHED, "SELECT CAST((place - 1) % 5 AS INT) AS fold, label, count(*) AS rows FROM ranked GROUP BY ALL"))
def kfold_counts(spark, sf_dir):
    folded = prep.folds(events(spark, sf_dir), "label", "event_id")
    return folded.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("rows"))


@query(sql.with_(HASHED, "SELECT event_id, label FROM ranked WHERE place <= 50"))
def sample_per_class(spark, sf_dir):
    return prep.sample_per_class(events(spark, sf_dir), "label", "event_id", 50).select("event_id", "label")


@query(
    """WITH l AS (SELECT l_orderkey AS id, l_quantity, l_discount, l_tax, l_shipdate < TIMESTAMP '2000-01-01' AS early FROM lineitem),
 ids AS (SELECT count(*) AS shared_ids FROM (SELECT id FROM l WHERE early INTERSECT SELECT id FROM l WHERE NOT early)),
 g AS (SELECT l_quantity, l_discount, l_tax, count(*) FILTER (WHERE early) AS a, count(*) FILTER (WHERE NOT early) AS b FROM l GROUP BY ALL)
SELECT (SELECT shared_ids FROM ids) AS shared_ids, count(*) AS shared_rows, CAST(sum(a * b) AS BIGINT) AS rows_pairs FROM g WHERE a > 0 AND b > 0"""
)
def leakage_checks(spark, sf_dir):
    """Line items shipped before and after 2000, compared on three columns."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_shipdate")
    cut = F.lit("2000-01-01").cast("timestamp_ntz")
    return prep.leakage(
        line.where(F.col("l_shipdate") < cut), line.where(F.col("l_shipdate") >= cut), "l_orderkey", ["l_quantity", "l_discount", "l_tax"]
    )


# ------------------------------------------------------------------- scalars
@query(sql.with_(sql.TX, """SELECT transaction_id, round(sin(2 * pi() * (t % 86400) / 86400), 6) AS time_sin, round(cos(2 * pi() * (t % 86400) / 86400), 6) AS time_cos,
  round(2 * pi() * (t % 86400) / 86400, 6) AS angle FROM tx"""))
def cyclical_time_of_day(spark, sf_dir):
    sine, cosine = cyclical_time(F.col("Time"))
    out = events(spark, sf_dir).select(
        "transaction_id", sine.alias("time_sin"), cosine.alias("time_cos"), clock_angle(F.col("Time")).alias("angle")
    )
    return rounded(out, "time_sin", "time_cos", "angle")


@query(
    sql.with_(
        sql.TX,
        """, q AS (SELECT quantile_cont(ln(1 + amount), 0.25) AS a, quantile_cont(ln(1 + amount), 0.5) AS m, quantile_cont(ln(1 + amount), 0.75) AS b FROM tx)
SELECT transaction_id, round((ln(1 + amount) - m) / CASE WHEN b = a THEN 1 ELSE b - a END, 6) AS scaled FROM tx, q""",
    )
)
def robust_scale(spark, sf_dir):
    tx = events(spark, sf_dir)
    frame = tx.select("transaction_id", "Time", "Amount", *(F.lit(0.0).alias(v) for v in prep.V_COLUMNS))
    out = prep.model_inputs(frame, prep.fit_scaling(tx), keep=["transaction_id"])
    return rounded(out.select("transaction_id", F.col("Amount").alias("scaled")), "scaled")


_VECTORS = """t AS (SELECT vec_id, vec_id * 977.0 AS t, abs(CAST(embedding[29] AS DOUBLE)) * 1000 AS amount, embedding AS e, CASE WHEN label = 0 THEN 0 ELSE 1 END AS y FROM embeddings),
 h AS (SELECT *, CAST(('0x' || substr(sha256('42|' || vec_id), 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496.0 AS h FROM t),
 r AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY h, vec_id) - 1) % 5 AS INT) AS fold FROM h),
 q AS (SELECT k.fold, quantile_cont(ln(1 + amount), 0.25) AS a, quantile_cont(ln(1 + amount), 0.5) AS m, quantile_cont(ln(1 + amount), 0.75) AS b
   FROM (SELECT DISTINCT fold FROM r) k JOIN r ON r.fold <> k.fold GROUP BY k.fold)"""


def _folded_vectors(spark, sf_dir):
    """Embeddings as labelled transactions with all raw features; each row's fold is settled once."""
    e = lambda k: F.col("embedding")[k].cast("double")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        (F.col("vec_id") * 977.0).alias("Time"),
        *(e(k).alias(name) for k, name in enumerate(prep.V_COLUMNS)),
        (F.abs(e(28)) * 1000).alias("Amount"),
        F.when(F.col("label") == 0, 0).otherwise(1).alias(prep.TARGET),
    )
    return checkpointed(prep.folds(rows, prep.TARGET, "vec_id"))


@query(
    sql.with_(
        _VECTORS,
        """SELECT vec_id, r.fold, round((ln(1 + amount) - m) / CASE WHEN b = a THEN 1 ELSE b - a END, 6) AS "Amount",
  round(sin(2 * pi() * (t % 86400) / 86400), 6) AS time_sin, round(cos(2 * pi() * (t % 86400) / 86400), 6) AS time_cos, """
        + ", ".join(f'round(CAST(e[{k}] AS DOUBLE), 6) AS "V{k}"' for k in range(1, 29))
        + " FROM r JOIN q ON r.fold = q.fold",
    )
)
def model_inputs_by_fold(spark, sf_dir):
    """The 31 model columns of each row, by inputs that are fitted on the rows of the other folds."""
    folded = _folded_vectors(spark, sf_dir)
    parts = []
    for k in range(5):
        fitted = prep.ModelInputs().fit(prep.features_only(folded.where(F.col("fold") != k)))
        parts.append(fitted.transform(folded.where(F.col("fold") == k)).select("vec_id", "fold", vector_to_array("features").alias("x")))
    columns = [F.round(F.col("x")[k], 6).alias(name) for k, name in enumerate(prep.MODEL_FEATURES)]
    return reduce(DataFrame.unionAll, parts).select("vec_id", "fold", *columns)


@query(sql.with_(_VECTORS, "SELECT fold, round(a, 6) AS q25, round(m, 6) AS q50, round(b, 6) AS q75 FROM q"))
def scaling_by_fold(spark, sf_dir):
    """The three constants that each fold's inputs learn."""
    folded = _folded_vectors(spark, sf_dir)
    learnt = [(k, *prep.fit_scaling(folded.where(F.col("fold") != k)).values()) for k in range(5)]
    return rounded(spark.createDataFrame(learnt, "fold int, q25 double, q50 double, q75 double"), "q25", "q50", "q75")


def _fraction_sql(value, salt):
    return f"CAST(('0x' || substr(sha256('{salt}|' || {value}), 1, 13))::UBIGINT AS BIGINT)"


def _names_sql(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_IDENTITIES = (
    sql.TX
    + f""", ranks AS (SELECT i, 1 / pow(i, 0.5) AS w FROM range(1, {I.CARD_COUNT} + 1) r(i)),
 shares AS (SELECT i, sum(w) OVER (ORDER BY i) / sum(w) OVER () AS upto FROM ranks UNION ALL SELECT 0, 0.0),
 drawn AS (SELECT transaction_id, {_fraction_sql('transaction_id', 'card')} / 4503599627370496.0 AS u FROM tx),
 carded AS (SELECT d.transaction_id, 'card-' || lpad(CAST(least(s.i, {I.CARD_COUNT - 1}) AS VARCHAR), 5, '0') AS card_id FROM drawn d ASOF JOIN shares s ON d.u >= s.upto),
 known AS (SELECT transaction_id, card_id,
   list_extract({_names_sql(I.MERCHANTS)}, {_fraction_sql('transaction_id', 'merchant')} % 12 + 1) AS merchant,
   CASE WHEN {_fraction_sql('transaction_id', 'abroad')} / 4503599627370496.0 < 0.03
     THEN list_extract({_names_sql(I.FOREIGN_COUNTRIES)}, {_fraction_sql('transaction_id', 'country')} % 6 + 1)
     ELSE list_extract({_names_sql(I.HOME_COUNTRIES)}, {_fraction_sql('card_id', 'home')} % 8 + 1) END AS country FROM carded)"""
)


@query(sql.with_(_IDENTITIES, "SELECT * FROM known"))
def hash_identities(spark, sf_dir):
    return I.with_identities(events(spark, sf_dir).select("transaction_id"))


@query()
def keyed_identities(spark, sf_dir):
    """With the keyed 64-bit hash, which SQL here does not have."""
    ship(spark)
    return I.with_identities(events(spark, sf_dir).select("transaction_id"), keyed=True)


@query(
    """WITH o AS (SELECT o_orderkey, count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS ids, CAST(0 AS BIGINT) AS unstable, CAST(0 AS BIGINT) AS strangers, CAST(0 AS BIGINT) AS moved_cards, true AS few_abroad FROM o"""
)
def keyed_identity_facts(spark, sf_dir):
    """What must hold whatever the hash is, over ids that rows repeat: an id has one identity, out of the known names,
    a card has one home, and about FOREIGN_SHARE of the ids are abroad."""
    ship(spark)
    ids = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("test-row-"), "l_orderkey").alias("transaction_id"))
    made = I.with_identities(ids, keyed=True).groupBy("transaction_id", "card_id", "merchant", "country").agg(F.count(F.lit(1)).alias("n"))
    at_home = F.col("country").isin(*I.HOME_COUNTRIES)
    known = (at_home | F.col("country").isin(*I.FOREIGN_COUNTRIES)) & F.col("merchant").isin(*I.MERCHANTS) & F.col("card_id").rlike("^card-0[0-4][0-9]{3}$")
    homes = made.groupBy("card_id").agg((F.count_distinct(F.when(at_home, F.col("country"))) > 1).cast("long").alias("moved")).agg(F.sum("moved").alias("moved_cards"))
    per_id = made.groupBy("transaction_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("identities"), F.count_if(~known).alias("strangers"), F.max((~at_home).cast("int")).alias("abroad"))
    total = per_id.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("ids"),
        F.count_if(F.col("identities") > 1).alias("unstable"),
        F.sum("strangers").alias("strangers"),
        (F.abs(F.avg("abroad") - I.FOREIGN_SHARE) < 6 * F.sqrt(F.lit(I.FOREIGN_SHARE) / F.count(F.lit(1)))).alias("few_abroad"),
    )
    return with_constants(total, homes)


# -------------------------------------------------------------------- replay
_POSITIONS = sql.TX + ", p AS (SELECT *, row_number() OVER (ORDER BY amount, event_id) - 1 AS position FROM tx)"


@query(sql.with_(_POSITIONS, "SELECT 'test-row-' || event_id AS transaction_id, position FROM p WHERE position >= 250"))
def replay_window(spark, sf_dir):
    """Ordered by amount, which has ties; resumed at position 250."""
    rows = events(spark, sf_dir).select("event_id", "Amount")
    return replay.replay_window(rows, "Amount", "event_id", 250).select("transaction_id", "position")


@query(sql.with_(_POSITIONS, "SELECT position, 1700000000000000 + CAST(round((position - 250) * 1e6 / 64) AS BIGINT) AS due_us FROM p WHERE position >= 250"))
def replay_schedule(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "Amount")
    window = replay.replay_window(rows, "Amount", "event_id", 250)
    start = F.lit(datetime.datetime.fromtimestamp(1_700_000_000, datetime.timezone.utc))
    return replay.schedule(window, start, 64.0).select("position", F.unix_micros("due_at").alias("due_us"))


@query(
    sql.with_(
        _POSITIONS,
        f""", s AS (SELECT CAST({_fraction_sql("'test-row-' || event_id", 'partition')} % 3 AS INT) AS partition FROM p WHERE position >= 250)
SELECT partition, count(*) AS sent, (SELECT count(*) FROM tx) AS next_start FROM s GROUP BY 1""",
    )
)
def produce_report(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "Amount")
    return replay.report(replay.replay_window(rows, "Amount", "event_id", 250), 250, 3)


# --------------------------------------------------------------- exploration
@query(
    sql.with_(
        sql.TX,
        """SELECT count(*) FILTER (WHERE label = 0) AS normal, count(*) FILTER (WHERE label = 1) AS fraud, round(avg(label), 9) AS fraud_rate,
  CAST(floor(count(*) / count(*) FILTER (WHERE label = 1)) AS BIGINT) AS one_in, round(count(*) FILTER (WHERE label = 0) / count(*), 9) AS always_normal_accuracy,
  0.0::DOUBLE AS always_normal_recall FROM tx""",
    )
)
def class_balance(spark, sf_dir):
    return rounded(X.class_balance(events(spark, sf_dir), "label"), "fraud_rate", "always_normal_accuracy", places=9)


@query(
    sql.with_(
        sql.TX,
        """SELECT label, count(*) AS n, round(avg(amount), 6) AS mean, round(stddev_samp(amount), 6) AS std, min(amount) AS minimum, max(amount) AS maximum,
  count(*) FILTER (WHERE amount = 0) AS zeros, round(quantile_cont(amount, 0.25), 6) AS q25, round(median(amount), 6) AS q50, round(quantile_cont(amount, 0.75), 6) AS q75
FROM tx GROUP BY 1""",
    )
)
def describe_by_class(spark, sf_dir):
    return rounded(X.describe_by(events(spark, sf_dir), "Amount", "label"), "mean", "std", "q25", "q50", "q75")


@query(sql.with_(sql.TX, "SELECT CAST(floor(t / 3600) % 24 AS INT) AS hour, count(*) AS transactions, round(avg(label), 9) AS fraud_rate FROM tx GROUP BY 1"))
def rate_by_hour(spark, sf_dir):
    return rounded(X.rate_by_hour(events(spark, sf_dir), "Time", "label"), "fraud_rate", places=9)


_LINES = "l AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"


@query(
    "WITH "
    + _LINES
    + """, u AS (UNPIVOT l ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE v)
SELECT feature, round(avg(v) FILTER (WHERE label = 0), 6) AS normal_mean, round(avg(v) FILTER (WHERE label = 1), 6) AS fraud_mean,
  round(abs(avg(v) FILTER (WHERE label = 0) - avg(v) FILTER (WHERE label = 1)), 6) AS gap FROM u GROUP BY 1"""
)
def class_mean_gap(spark, sf_dir):
    return rounded(X.class_mean_gap(lines(spark, sf_dir), LINE_FEATURES, "label"), "normal_mean", "fraud_mean", "gap")


@query("WITH " + _LINES + ", u AS (UNPIVOT l ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE v) SELECT feature, round(corr(v, label), 9) AS correlation FROM u GROUP BY 1")
def label_correlation(spark, sf_dir):
    return rounded(X.label_correlation(lines(spark, sf_dir), LINE_FEATURES, "label"), "correlation", places=9)


@query(
    sql.with_(
        sql.TX,
        """, q AS (SELECT label, quantile_cont(amount, 0.25) AS q25, median(amount) AS q50, quantile_cont(amount, 0.75) AS q75 FROM tx GROUP BY 1)
SELECT label, round(any_value(q25), 6) AS q25, round(any_value(q50), 6) AS q50, round(any_value(q75), 6) AS q75,
  min(amount) FILTER (WHERE amount BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_low,
  max(amount) FILTER (WHERE amount BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS whisker_high,
  count(*) FILTER (WHERE NOT amount BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS outliers FROM tx JOIN q USING (label) GROUP BY 1""",
    )
)
def box_stats(spark, sf_dir):
    return rounded(X.box_statistics(events(spark, sf_dir), "Amount", "label"), "q25", "q50", "q75")


@query(
    sql.with_(
        sql.TX,
        """, e AS (SELECT label, min(amount) AS lo, (max(amount) - min(amount)) / 60 AS width, count(*) AS size FROM tx GROUP BY 1),
 c AS (SELECT label, least(CAST(floor((amount - lo) / width) AS BIGINT), 59) AS bin, count(*) AS n FROM tx JOIN e USING (label) GROUP BY ALL)
SELECT e.label, CAST(b AS INT) AS bin, round(lo + b * width, 6) AS bin_low, coalesce(n, 0) AS n, round(coalesce(n, 0) / (size * width), 9) AS density
FROM e CROSS JOIN range(60) r(b) LEFT JOIN c ON c.label = e.label AND c.bin = b""",
    )
)
def density_histogram(spark, sf_dir):
    out = X.density_histogram(events(spark, sf_dir), F.col("Amount"), "label", 60)
    return rounded(rounded(out, "bin_low"), "density", places=9)
