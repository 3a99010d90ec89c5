"""One batch of transactions from arrival to recorded decisions, safe to run again."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.rules import KINDS, Rule, Thresholds
from riskloom.operators import decisions, scoring
from riskloom.operators import velocity as vel
from riskloom.session import checkpointed


def admitted(transactions: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(rows, facts): one row per event, and how many were received and came again.

    An event that was delivered again (same id, card, amount and country) moves to its last arrival. A batch is all or
    nothing: without rows, with a row without an id, with an amount that is not a number or is negative, or with an id
    that names two different events nothing of it is scored.
    """
    sound = F.coalesce(~F.isnan("Amount") & (F.col("Amount") >= 0) & (F.col("Amount") < float("inf")), F.lit(False))
    received = transactions.agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(~sound).alias("unsound"),
        F.count_if(F.col("transaction_id").isNull()).alias("nameless"),
        F.min(F.when(~sound, F.col("transaction_id"))).alias("example"),
    ).first()
    if not received["received"]:
        raise ValueError("a batch without transactions")
    _refuse({"amounts that can't be": received["unsound"], "rows without an id": received["nameless"]}, received["example"])
    rows = checkpointed(vel.collapse_redeliveries(transactions))
    by_id = rows.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"))
    events = by_id.agg(
        F.sum("n").alias("events"), F.count_if(F.col("n") > 1).alias("clashing"), F.min(F.when(F.col("n") > 1, F.col("transaction_id"))).alias("example")
    ).first()
    _refuse({"ids of two events": events["clashing"]}, events["example"])
    return rows, {"received": received["received"], "repeated": received["received"] - events["events"]}


def _refuse(problems: dict[str, int], example: str | None) -> None:
    if any(problems.values()):
        named = ", ".join(f"{n} {what}" for what, n in problems.items() if n)
        raise ValueError(f"the batch is refused: {named}" + (f", such as {example}" if example else ""))


def run_batch(
    transactions: DataFrame,
    path: str,
    batch_id: int,
    model: scoring.RiskProvider,
    thresholds: Thresholds = Thresholds(),
    version: str = "unversioned",
    windows: vel.VelocityWindows | None = vel.VelocityWindows(),
    rules: Sequence[Rule] | None = None,
    scored_at: datetime | Column | None = None,
) -> DataFrame:
    """Collapses, checks, measures, scores and records a batch; returns its counts, one row.

    What is recorded lies under the batch id, so running the batch again replaces it. The counts are taken from what was
    recorded: received, repeated, scored, and one column per kind of decision.
    """
    rows, facts = admitted(transactions)
    results = scoring.score_batch(rows, model, thresholds, version, windows, rules, keep=["arrival_us"])
    decisions.append_batch(decisions.to_rows(results, F.current_timestamp() if scored_at is None else scored_at), path, batch_id)
    recorded = transactions.sparkSession.read.parquet(f"{path}/batch_id={batch_id}")
    kinds = [F.count_if(F.col("decision") == kind).alias(kind) for kind in KINDS]
    known = [F.lit(n).cast("long").alias(name) for name, n in facts.items()]
    return recorded.agg(F.count(F.lit(1)).alias("scored"), *kinds).select(F.lit(batch_id).alias("batch_id"), *known, "scored", *KINDS)
