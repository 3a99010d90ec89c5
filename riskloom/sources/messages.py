"""Keyed JSON messages, dead letters, and what a batch of messages amounts to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.contract import FIELDS
from riskloom.operators.decisions import latest_per_key

# The record layout of a message source, and the headers of a dead letter.
MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)
REASON, TOPIC, PARTITION, OFFSET, FAILED_AT = (
    "dlq-reason",
    "dlq-source-topic",
    "dlq-source-partition",
    "dlq-source-offset",
    "dlq-failed-at",
)

def kafka_stream(
    spark: SparkSession, servers: str, topic: str, per_batch: int | None = None, min_partitions: int | None = None
) -> DataFrame:
    """Messages of a topic; a new checkpoint starts from the earliest one.

    A batch takes all there is unless `per_batch` says how many at most.
    `min_partitions` reads few topic partitions with more tasks, since checking
    messages is the costly step.
    """
    reader = spark.readStream.format("kafka")
    if per_batch is not None:
        reader = reader.option("maxOffsetsPerTrigger", per_batch)
    if min_partitions is not None:
        reader = reader.option("minPartitions", min_partitions)
    return (
        reader
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
        .select(*MESSAGE_SCHEMA.fieldNames())
    )


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The same columns from a folder of parquet files."""
    return (
        spark.readStream.schema(MESSAGE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def encode(transactions: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """(key, value): the id, so that a re-send meets its first copy, and the JSON body with nulls."""
    body = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    return transactions.select(F.col("transaction_id").cast("binary").alias("key"), body.cast("binary").alias("value"))


def iso_utc(instant: Column) -> Column:
    """2026-09-16T12:00:00+00:00, with microseconds only when there are some."""
    micros = F.pmod(F.unix_micros(instant), F.lit(1_000_000))
    part = F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def dead_letters(refused: DataFrame, failed_at: Column | None = None) -> DataFrame:
    """Refused messages with their original bytes and five headers saying why and where from."""
    failed_at = F.current_timestamp() if failed_at is None else failed_at
    texts = {
        REASON: F.col("problem"),
        TOPIC: F.col("topic"),
        PARTITION: F.col("partition").cast("string"),
        OFFSET: F.col("offset").cast("string"),
        FAILED_AT: iso_utc(failed_at),
    }
    headers = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value")) for k, v in texts.items()))
    return refused.select("key", F.coalesce("value", F.lit(b"")).alias("value"), headers.alias("headers"))


def header(headers: Column, name: str) -> Column:
    """The first header of that name as text, else null."""
    return F.get(F.filter(headers, lambda h: h["key"] == name), F.lit(0))["value"].cast("string")


def last_wins(valid: DataFrame, order: Sequence[str] = ("partition", "offset")) -> DataFrame:
    """One row per transaction id: its latest message, as a later batch would have replaced it."""
    return latest_per_key(valid, "transaction_id", list(order))


def outcome_counts(decoded: DataFrame) -> DataFrame:
    """consumed = scored + dead_lettered + duplicates, in one row."""
    per_id = decoded.groupBy("transaction_id", F.col("problem").isNull().alias("_ok")).agg(F.count(F.lit(1)).alias("_n"))
    ok, n = F.col("_ok"), F.col("_n")
    return per_id.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("consumed"),
        F.count_if(ok).alias("scored"),
        F.coalesce(F.sum(F.when(~ok, n)), F.lit(0)).alias("dead_lettered"),
        F.coalesce(F.sum(F.when(ok, n - 1)), F.lit(0)).alias("duplicates"),
    )


def outcomes(counts: DataFrame) -> DataFrame:
    """(outcome, messages) rows from any number of batch counts."""
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("scored", "dead_lettered", "duplicates")))
    rows = [("scored", "scored"), ("dead_lettered", "dead_lettered"), ("duplicate", "duplicates")]
    return total.select(F.inline(F.array(*(F.struct(F.lit(o).alias("outcome"), F.col(c).alias("messages")) for o, c in rows))))


def commit_offsets(messages: DataFrame) -> DataFrame:
    """Where to resume each partition: after its last message."""
    return messages.groupBy("topic", "partition").agg((F.max("offset") + 1).alias("resume_at"))


def lag(positions: DataFrame) -> DataFrame:
    """Adds `lag` to (partition, high_water, position); an unknown high-water mark gives null."""
    return positions.withColumn("lag", F.col("high_water") - F.col("position"))


def total_lag(positions: DataFrame) -> DataFrame:
    """The sum of all lags, unknown as soon as one of them is."""
    lags = lag(positions)
    known = F.count_if(F.col("lag").isNull()) == 0
    return lags.agg(F.when(known, F.coalesce(F.sum("lag"), F.lit(0))).alias("total_lag"))
