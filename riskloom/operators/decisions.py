"""The decision table: one current row per transaction, and the questions asked of it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.rules import BLOCK, KINDS, REVIEW, was_escalated
from riskloom.functions.scalars import steps_below
from riskloom.operators.velocity import flatten

# The stored columns with their types, in order.
DECISION_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType(), False),
        T.StructField("risk_score", T.DoubleType(), False),
        T.StructField("decision", T.StringType(), False),
        T.StructField("review_threshold", T.DoubleType(), False),
        T.StructField("block_threshold", T.DoubleType(), True),
        T.StructField("model_version", T.StringType(), False),
        T.StructField("scored_at", T.TimestampType(), False),
        T.StructField("card_id", T.StringType(), True),
        T.StructField("velocity_count_1m", T.IntegerType(), True),
        T.StructField("velocity_count_5m", T.IntegerType(), True),
        T.StructField("velocity_count_1h", T.IntegerType(), True),
        T.StructField("velocity_amount_1h", T.DoubleType(), True),
        T.StructField("velocity_countries_1h", T.IntegerType(), True),
        T.StructField("velocity_seconds_since_previous", T.DoubleType(), True),
        T.StructField("model_decision", T.StringType(), True),
        T.StructField("reasons", T.ArrayType(T.StringType()), True),
    ]
)

# What a reader of decisions sees, bucket widths in seconds, and the row limits.
VIEW_COLUMNS = (
    "transaction_id",
    "scored_at",
    "decision",
    "model_decision",
    "risk_score",
    "card_id",
    "reasons",
    "velocity_count_1m",
    "velocity_count_1h",
    "velocity_countries_1h",
    "velocity_amount_1h",
)
BUCKET_SECONDS = (1, 5, 15, 30, 60, 300, 900, 3600, 21600, 86400)
MAX_VIEW_ROWS = 200_000
MAX_RECENT = 500
LOWEST_RISK_BIN = 1e-6


# ------------------------------------------------------------------ writing
def to_rows(results: DataFrame, scored_at: Column | datetime) -> DataFrame:
    """Scoring results as decision rows; one `scored_at` for the whole call."""
    if isinstance(scored_at, datetime):
        if scored_at.tzinfo is None:
            raise ValueError("scored_at needs a time zone")
        scored_at = F.lit(scored_at)
    flat = flatten(results).withColumn("scored_at", scored_at)
    return flat.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in DECISION_SCHEMA.fields))


def violations(rows: DataFrame) -> DataFrame:
    """Rows that break the result contract, with every broken check named."""
    risk, review, block = F.col("risk_score"), F.col("review_threshold"), F.col("block_threshold")
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    checks = [
        ("risk_score outside [0, 1]", bad(risk.between(0, 1))),
        ("unknown decision", bad(F.col("decision").isin(*KINDS))),
        ("unknown model_decision", F.col("model_decision").isNotNull() & ~F.col("model_decision").isin(*KINDS)),
        ("review_threshold outside [0, 1]", bad(review.between(0, 1))),
        ("block_threshold outside [review_threshold, 1]", block.isNotNull() & bad(block.between(review, F.lit(1.0)))),
    ]
    problems = F.concat_ws("; ", *(F.when(broken, F.lit(text)) for text, broken in checks))
    return rows.withColumn("problems", problems).where(F.col("problems") != "")


def append_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch of decision rows under its own id, so a retry replaces it.

    Checked while writing: a row outside the contract fails the write, and so
    leaves the earlier content of the batch in place. Ids must be distinct in
    the batch (see `latest_per_key`). Inside the batch rows lie by the day they
    were scored on, so that a reader of a time range opens no other files.
    """
    ok = (
        F.col("risk_score").between(0, 1)
        & F.col("decision").isin(*KINDS)
        & F.coalesce(F.col("model_decision").isin(*KINDS), F.lit(True))
    )
    guarded = rows.withColumn(
        "transaction_id",
        F.when(F.coalesce(ok, F.lit(False)), F.col("transaction_id")).otherwise(
            F.raise_error(F.concat(F.lit("decision outside its contract: "), F.col("transaction_id")))
        ),
    )
    # Ids sorted inside files: a point lookup then skips row groups by their statistics.
    dated = guarded.withColumn("day", F.to_date("scored_at")).sortWithinPartitions("day", "transaction_id")
    dated.write.mode("overwrite").partitionBy("day").parquet(f"{path}/batch_id={batch_id}")


def read_log(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """The rows of a log that were scored at `since` or later; files of earlier days are not opened."""
    log = spark.read.parquet(path)
    if since is None:
        return log
    if since.tzinfo is None:
        raise ValueError("since needs a time zone")
    return log.where((F.col("day") >= F.lit(since.astimezone(timezone.utc).date())) & (F.col("scored_at") >= F.lit(since)))


def current_since(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """The current decisions scored at `since` or later, from the log of those days alone.

    Exact: a transaction's newest row is in that range if any of its rows is, and then it is the newest of those.
    """
    return latest_decisions(read_log(spark, path, since))


def latest_per_key(df: DataFrame, key: str, order: Sequence[Column | str]) -> DataFrame:
    """The newest row of each key. Aggregated before the shuffle, so a key repeated
    in a large part of the table costs one row per task instead of one huge group."""
    rest = [c for c in df.columns if c != key]
    newest = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return newest.select(key, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def latest_decisions(log: DataFrame) -> DataFrame:
    """The current decision per transaction: every column comes from the newest write."""
    return latest_per_key(log, "transaction_id", ["scored_at", "batch_id"])


def added_columns(stored: T.StructType, wanted: T.StructType = DECISION_SCHEMA) -> list[T.StructField]:
    """Columns a stored table lacks. Only nullable additions are allowed."""
    present = {f.name: f.dataType for f in stored.fields}
    changed = sorted(f.name for f in wanted.fields if f.name in present and present[f.name] != f.dataType)
    if changed:
        raise ValueError(f"columns changed type: {changed}")
    dropped = sorted(set(present) - {f.name for f in wanted.fields})
    if dropped:
        raise ValueError(f"columns would be dropped: {dropped}")
    missing = [f for f in wanted.fields if f.name not in present]
    required = sorted(f.name for f in missing if not f.nullable)
    if required:
        raise ValueError(f"missing columns cannot be required: {required}")
    return missing


def evolved(stored: DataFrame, wanted: T.StructType = DECISION_SCHEMA) -> DataFrame:
    """The stored rows in the wanted shape, new columns null."""
    new = {f.name for f in added_columns(stored.schema, wanted)}
    return stored.select(
        *(
            F.lit(None).cast(f.dataType).alias(f.name) if f.name in new else F.col(f.name)
            for f in wanted.fields
        )
    )


# ------------------------------------------------------------------ reading
def by_id(decisions: DataFrame, transaction_id: str) -> DataFrame:
    return decisions.where(F.col("transaction_id") == transaction_id)


def recent(decisions: DataFrame, limit: int = 50, kind: str | None = None) -> DataFrame:
    """The newest decisions, optionally of one kind."""
    if not 1 <= limit <= MAX_RECENT:
        raise ValueError(f"limit must be within 1..{MAX_RECENT}")
    chosen = decisions if kind is None else decisions.where(F.col("decision") == kind)
    return chosen.orderBy(F.desc("scored_at"), "transaction_id").limit(limit)


def view(decisions: DataFrame, since: datetime | None = None, limit: int = MAX_VIEW_ROWS) -> DataFrame:
    """What a reader loads: newest first, one row more than `limit` to tell truncation."""
    chosen = decisions.select(*VIEW_COLUMNS)
    if since is not None:
        chosen = chosen.where(F.col("scored_at") >= F.lit(since))
    return chosen.orderBy(F.desc("scored_at"), "transaction_id").limit(limit + 1)


def truncation(viewed: DataFrame, limit: int = MAX_VIEW_ROWS) -> DataFrame:
    return viewed.agg(F.count(F.lit(1)).alias("rows")).withColumn("truncated", F.col("rows") > limit)


def kinds_frame(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(k,) for k in KINDS], "decision string")


def counts_by_kind(decisions: DataFrame) -> DataFrame:
    """A count for every kind, zeros included."""
    counted = decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    return kinds_frame(decisions).join(counted, "decision", "left").select(
        "decision", F.coalesce("n", F.lit(0)).alias("decisions")
    )


def escalated() -> Column:
    return was_escalated(F.col("model_decision"), F.col("decision"))


def summary(decisions: DataFrame) -> DataFrame:
    """Totals in one row; the rate is over the span of the rows."""
    counts = decisions.agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(F.col("decision") == kind).alias(kind) for kind in KINDS),
        F.count_if(escalated()).alias("escalated"),
        F.count_distinct("card_id").alias("cards"),
        F.min("scored_at").alias("first_at"),
        F.max("scored_at").alias("last_at"),
    )
    span = (F.unix_micros("last_at") - F.unix_micros("first_at")) / F.lit(1e6)
    share = lambda name: F.coalesce(F.try_divide(F.col(name), F.col("total")), F.lit(0.0))
    return counts.select(
        "*",
        F.when(span > 0, F.col("total") / span).otherwise(0.0).alias("per_second"),
        share(REVIEW).alias("review_rate"),
        share(BLOCK).alias("block_rate"),
        share("escalated").alias("escalated_rate"),
    )


def bucket_width(decisions: DataFrame, target: int = 60) -> DataFrame:
    """The smallest fixed width that needs at most `target` buckets, else the largest."""
    span = (F.unix_micros(F.max("scored_at")) - F.unix_micros(F.min("scored_at"))) / F.lit(1e6)
    spanned = decisions.agg(F.coalesce(span, F.lit(0.0)).alias("span"))
    widths = F.array(*(F.lit(w) for w in BUCKET_SECONDS))
    fitting = F.array_min(F.filter(widths, lambda w: F.col("span") / w <= target))
    return spanned.select(F.coalesce(fitting, F.lit(BUCKET_SECONDS[-1])).alias("bucket_seconds"))


def over_time(decisions: DataFrame, bucket_seconds: int) -> DataFrame:
    """Counts per time bucket and kind; buckets without decisions are zero rows."""
    second = F.unix_seconds("scored_at")
    bucket = second - F.pmod(second, F.lit(bucket_seconds))
    counted = decisions.groupBy(bucket.alias("bucket")).agg(
        *(F.count_if(F.col("decision") == kind).alias(kind) for kind in KINDS)
    )
    # The ends come from the same aggregate, whose shuffle is then shared by both uses.
    ends = counted.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).where(F.col("lo").isNotNull())
    calendar = ends.select(F.explode(F.sequence("lo", "hi", F.lit(bucket_seconds).cast("long"))).alias("bucket"))
    filled = calendar.join(counted, "bucket", "left")
    return filled.select(
        F.timestamp_seconds("bucket").alias("bucket_start"),
        *(F.coalesce(kind, F.lit(0)).alias(kind) for kind in KINDS),
    )


def risk_edges(bins: int) -> list[float]:
    """Right ends of log-spaced bins from a millionth to one."""
    return [10 ** (6 * i / bins - 6) for i in range(1, bins + 1)]


def risk_histogram(decisions: DataFrame, bins: int = 50) -> DataFrame:
    """Counts in log-spaced bins closed on the right; every bin is returned."""
    edges = risk_edges(bins)
    clipped = F.greatest(F.least(F.col("risk_score"), F.lit(1.0)), F.lit(LOWEST_RISK_BIN))
    counted = decisions.groupBy(steps_below(clipped, edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    table = decisions.sparkSession.createDataFrame(list(enumerate(edges)), "bin int, risk_upto double")
    return table.join(counted, "bin", "left").select("bin", "risk_upto", F.coalesce("n", F.lit(0)).alias("decisions"))


def fired_rules() -> Column:
    """Rules on a row; rows written before rules existed read as none."""
    return F.coalesce(F.col("reasons"), F.array().cast("array<string>"))


def review_queue(decisions: DataFrame, only_escalated: bool = False) -> DataFrame:
    """Everything not approved, newest first; optionally only what the rules sent."""
    queued = decisions.where(F.col("decision").isin(REVIEW, BLOCK))
    if only_escalated:
        queued = queued.where(escalated())
    return queued.withColumn("rules", fired_rules()).orderBy(F.desc("scored_at"), "transaction_id")


def rule_counts(decisions: DataFrame) -> DataFrame:
    """How often each rule fired, whether or not it changed the decision."""
    fired = decisions.select(F.explode(fired_rules()).alias("rule"))
    return fired.groupBy("rule").agg(F.count(F.lit(1)).alias("fired")).orderBy(F.desc("fired"), "rule")


def busiest_cards(decisions: DataFrame, limit: int = 10) -> DataFrame:
    """The cards with most transactions and what was done about them."""
    carded = decisions.where(F.col("card_id").isNotNull())
    return (
        carded.groupBy("card_id")
        .agg(
            F.count(F.lit(1)).alias("transactions"),
            F.count_if(F.col("decision") == REVIEW).alias("reviewed"),
            F.count_if(F.col("decision") == BLOCK).alias("blocked"),
            F.count_if(escalated()).alias("escalated"),
            F.max("velocity_count_1m").alias("peak_1m"),
            F.max("velocity_amount_1h").alias("amount"),
        )
        .orderBy(F.desc("transactions"), F.desc("reviewed"), "card_id")
        .limit(limit)
    )


def card_history(decisions: DataFrame, card_id: str) -> DataFrame:
    own = decisions.where(F.col("card_id") == card_id)
    return own.withColumn("rules", fired_rules()).orderBy(F.desc("scored_at"), "transaction_id")
