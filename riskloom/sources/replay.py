"""Replaying a stored table as a stream of keyed messages, in time order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.identities import with_identities
from riskloom.operators.ranking import row_index


def replay_window(
    df: DataFrame, time: str, row: str, start: int = 0, limit: int | None = None, keyed: bool = False
) -> DataFrame:
    """Positions [start, start + limit) of the table in (time, row) order.

    Ids are `test-row-<row>` and the identities follow from them, so resuming at
    a later start gives a row the same card as before.
    """
    placed = row_index(df, [time, row], "position")
    if start > 0 and placed.where(F.col("position") >= start).isEmpty():
        raise ValueError(f"start {start} is past the end of the table")
    chosen = placed.where(F.col("position") >= start)
    if limit is not None:
        chosen = chosen.where(F.col("position") < start + limit)
    named = chosen.withColumn("transaction_id", F.concat(F.lit("test-row-"), F.col(row)))
    return with_identities(named, "transaction_id", keyed)


def schedule(replay: DataFrame, start_at: Column, rate: float) -> DataFrame:
    """Adds `due_at`: message i is due at start + i / rate, so sending never drifts. Rate 0 is unpaced."""
    if rate < 0:
        raise ValueError("rate must not be negative")
    if rate == 0:
        return replay.withColumn("due_at", start_at)
    first = replay.agg(F.min("position")).first()[0] or 0
    micros = F.round((F.col("position") - first) * F.lit(1e6 / rate)).cast("long")
    return replay.withColumn("due_at", F.timestamp_micros(F.unix_micros(start_at) + micros))


def paced(replay: DataFrame, rate: int) -> DataFrame:
    """The streaming form: the built-in rate source releases `rate` positions a second."""
    ticks = replay.sparkSession.readStream.format("rate").option("rowsPerSecond", rate).load()
    first = replay.agg(F.min("position")).first()[0] or 0
    due = ticks.select((F.col("value") + first).alias("position"), F.col("timestamp").alias("sent_at"))
    return due.join(replay, "position")


def report(sent: DataFrame, start: int, partitions: int, key: str = "transaction_id") -> DataFrame:
    """Messages per partition, and the start that resumes after the last of them."""
    from riskloom.functions.identities import sql_digest

    where = F.pmod(sql_digest(F.col(key), "partition"), F.lit(partitions)).cast("int")
    counted = sent.groupBy(where.alias("partition")).agg(F.count(F.lit(1)).alias("sent"))
    total = counted.agg(F.coalesce(F.sum("sent"), F.lit(0))).first()[0]
    return counted.withColumn("next_start", F.lit(start + total).cast("bigint"))


def sample_bodies(rows: DataFrame, fields: Sequence[str], batch: bool, order: str) -> DataFrame:
    """Requests as JSON: one body per row, or a single one holding the whole (small, limited) sample."""
    body = F.struct(*fields)
    if not batch:
        return rows.orderBy(order).select(F.to_json(body).alias("body"))
    gathered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), body.alias("b")))), lambda x: x["b"])
    return rows.agg(F.to_json(F.struct(gathered.alias("transactions"))).alias("body"))
