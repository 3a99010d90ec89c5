"""The generic tables seen as card transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.velocity import VelocityWindows
from riskloom.functions.rules import RuleLimits, Thresholds
from riskloom.session import prepare

FIRST_SECOND = 1_704_067_200  # 2024-01-01 UTC, where the events begin

# Windows wide enough for about two events per card and day.
WINDOWS = VelocityWindows(short=3_600, middle=21_600, long=86_400)
LIMITS = RuleLimits(per_minute=1, per_hour=5, countries=3, gap_seconds=1800.0)
THRESHOLDS = Thresholds(0.24, 0.95)
VERSION = "v-test"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as transactions; every column is a projection, so pruning reaches the scan."""
    events = table(spark, sf_dir, "events")
    arrival = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        "event_id",
        F.concat(F.lit("ev-"), F.col("event_id")).alias("transaction_id"),
        F.concat(F.lit("card-"), F.col("user_id")).alias("card_id"),
        F.col("value").alias("Amount"),
        F.col("event_type").alias("country"),
        arrival.alias("arrival_us"),
        F.col("event_id").alias("sequence"),
        ((arrival - F.lit(FIRST_SECOND * 1_000_000)) / F.lit(1e6)).alias("Time"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
    )


def stub_risk():
    """A model simple enough to check in SQL: the amount in hundreds, at most 1."""
    return F.least(F.col("Amount") / 100, F.lit(1.0))
