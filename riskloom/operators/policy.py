"""Review and block thresholds priced by expected cost.

Review costs the same for every reviewed row, a block costs only for normal
rows, an approved fraud costs its amount plus a fee. Everything is per 100,000
transactions. A null block threshold never blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.evaluation import totals_from
from riskloom.operators.ranking import with_constants

PER = 100_000

# Candidate thresholds of a percentile risk (0.900 to 0.999 by 0.001)
# and of a probability (0.001 steps below 0.01, then 0.01 steps up to 0.99).
PERCENTILE_GRID = tuple(round(i / 1000, 3) for i in range(900, 1000))
PROBABILITY_GRID = tuple(sorted({round(i / 1000, 3) for i in range(1, 10)} | {round(i / 100, 3) for i in range(1, 100)}))


@dataclass(frozen=True)
class Costs:
    review: float = 5.0
    false_block: float = 50.0
    chargeback_fee: float = 15.0


def approve_all_cost(df: DataFrame, label: str, amount: str, costs: Costs) -> DataFrame:
    """What fraud costs per 100k when everything is approved."""
    lost = F.sum(F.when(F.col(label) == 1, F.col(amount) + costs.chargeback_fee).otherwise(0.0))
    return df.agg((lost * PER / F.count(F.lit(1))).alias("no_model_cost_per_100k"))


def _steps(df: DataFrame, label: str, risk: str, amount: str, fee: float, edges: Sequence[float]) -> DataFrame:
    """Normal rows, frauds and fraud losses at or above every candidate threshold."""
    fraud = F.col(label) == 1
    return totals_from(
        df,
        F.col(risk).cast("double"),
        edges,
        {
            "normals": F.when(fraud, 0).otherwise(1),
            "frauds": F.when(fraud, 1).otherwise(0),
            "loss": F.when(fraud, F.col(amount) + fee).otherwise(0.0),
        },
    )


def _pairs(df: DataFrame, edges: Sequence[float], review: Sequence[float], block: Sequence[float | None]) -> DataFrame:
    """The (review, block) grid with block >= review: parameters only, no data."""
    at = {edge: i + 1 for i, edge in enumerate(edges)}
    rows = [
        (float(r), None if b is None else float(b), at[float(r)], -1 if b is None else at[float(b)], 0)
        for r in review
        for b in block
        if b is None or b >= r
    ]
    schema = "review_threshold double, block_threshold double, review_step int, block_step int, whole int"
    return df.sparkSession.createDataFrame(rows, schema)


def policy_costs(
    df: DataFrame,
    label: str,
    risk: str,
    amount: str,
    costs: Costs = Costs(),
    review: Sequence[float] = PERCENTILE_GRID,
    block: Sequence[float | None] = (*PERCENTILE_GRID, None),
) -> DataFrame:
    """Cost of every threshold pair. The data is scanned once into one row per
    candidate threshold; the thousands of pairs are priced from that table."""
    edges = sorted({float(t) for t in (*review, *block) if t is not None})
    steps = _steps(df, label, risk, amount, costs.chargeback_fee, edges)
    whole = steps.select(
        F.col("step").alias("whole"),
        (F.col("normals") + F.col("frauds")).alias("n"),
        F.col("frauds").alias("all_frauds"),
        F.col("loss").alias("all_loss"),
    )
    at_review = steps.select(F.col("step").alias("review_step"), "normals", "frauds", "loss")
    at_block = steps.select(
        F.col("step").alias("block_step"), F.col("normals").alias("b_normals"), F.col("frauds").alias("b_frauds")
    )
    grid = (
        _pairs(df, edges, review, block)
        .join(F.broadcast(at_review), "review_step")
        .join(F.broadcast(at_block), "block_step", "left")
        .fillna(0, ["b_normals", "b_frauds"])
        .join(F.broadcast(whole), "whole")
    )
    reviewed = F.col("normals") + F.col("frauds") - F.col("b_normals") - F.col("b_frauds")
    scale = F.lit(float(PER)) / F.col("n")
    priced = grid.select(
        "review_threshold",
        "block_threshold",
        (reviewed / F.col("n")).alias("review_rate"),
        ((F.col("b_normals") + F.col("b_frauds")) / F.col("n")).alias("block_rate"),
        F.try_divide("frauds", "all_frauds").alias("fraud_stopped"),
        F.try_divide("loss", "all_loss").alias("fraud_loss_stopped"),
        (costs.review * reviewed * scale).alias("review_cost"),
        (costs.false_block * F.col("b_normals") * scale).alias("block_cost"),
        ((F.col("all_loss") - F.col("loss")) * scale).alias("missed_fraud_cost"),
    )
    return priced.withColumn(
        "cost_per_100k", F.col("review_cost") + F.col("block_cost") + F.col("missed_fraud_cost")
    )


def choices(priced: DataFrame, capacity: float, tolerance: float = 0.02, by: Sequence[str] = ()) -> DataFrame:
    """The chosen pair per `by` group: within capacity, near the least cost, with the
    fewest blocks, then the fewest reviews. Groups without a feasible pair are absent."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    feasible = priced.where(F.col("review_rate") <= capacity).withColumn(
        "_least", F.min("cost_per_100k").over(group)
    )
    tied = feasible.where(F.col("cost_per_100k") <= F.col("_least") * (1 + tolerance))
    order = group.orderBy(
        "block_rate", "review_rate", "cost_per_100k", "review_threshold", F.col("block_threshold").asc_nulls_last()
    )
    best = tied.withColumn("_place", F.row_number().over(order)).where("_place = 1")
    return best.select(*by, "review_threshold", "block_threshold", "cost_per_100k", "review_rate", "block_rate")


def choose_thresholds(priced: DataFrame, capacity: float, tolerance: float = 0.02) -> DataFrame:
    """`choices` for one table; an error when no pair fits the capacity."""
    best = choices(priced, capacity, tolerance)
    failed = F.raise_error(F.lit(f"no policy reviews at most a share of {capacity} of the rows"))
    return best.agg(F.max_by(F.struct("*"), F.lit(1)).alias("_best"), F.count(F.lit(1)).alias("_n")).select(
        F.when(F.col("_n") > 0, F.col("_best")).otherwise(failed).alias("_best")
    ).select("_best.*")


def policy_summary(
    df: DataFrame, label: str, risk: str, amount: str, review: float, block: float | None, costs: Costs = Costs()
) -> DataFrame:
    """What one threshold pair does, and what it saves against approving everything."""
    row = policy_costs(df, label, risk, amount, costs, [review], [block])
    baseline = approve_all_cost(df, label, amount, costs)
    return with_constants(row, baseline).select(
        F.col("review_rate").alias("reviewed_rate"),
        F.col("block_rate").alias("blocked_rate"),
        "fraud_stopped",
        "fraud_loss_stopped",
        "cost_per_100k",
        "no_model_cost_per_100k",
        (1 - F.try_divide("cost_per_100k", "no_model_cost_per_100k")).alias("saving_vs_no_model"),
    )


def cheapest(priced: DataFrame, k: int = 5, capacity: float | None = None) -> DataFrame:
    """The k cheapest pairs, optionally within capacity."""
    chosen = priced if capacity is None else priced.where(F.col("review_rate") <= capacity)
    return chosen.orderBy("cost_per_100k", "review_threshold", F.col("block_threshold").asc_nulls_last()).limit(k)


def cost_curve(priced: DataFrame, capacity: float) -> DataFrame:
    """Costs by review threshold when nothing is blocked, and whether analysts could cope."""
    return priced.where(F.col("block_threshold").isNull()).select(
        "review_threshold",
        "review_cost",
        "missed_fraud_cost",
        "cost_per_100k",
        (F.col("review_rate") > capacity).alias("over_capacity"),
    )


def sensitivity(
    df: DataFrame,
    label: str,
    risk: str,
    amount: str,
    scenarios: Sequence[Costs],
    capacity: float,
    grid: Sequence[float] = PROBABILITY_GRID,
) -> DataFrame:
    """The choice under several cost assumptions. The data is scanned once: review and
    block costs only weigh counts that are the same in every scenario."""
    fees = {s.chargeback_fee for s in scenarios}
    if len(fees) != 1:
        raise ValueError("scenarios share one chargeback fee")
    fee = fees.pop()
    unit = policy_costs(df, label, risk, amount, Costs(1.0, 1.0, fee), grid, (*grid, None))
    table = df.sparkSession.createDataFrame(
        [(s.review, s.false_block) for s in scenarios], "scenario_review_cost double, scenario_block_cost double"
    )
    options = F.array(
        *(F.struct(F.lit(float(s.review)).alias("scenario_review_cost"), F.lit(float(s.false_block)).alias("scenario_block_cost")) for s in scenarios)
    )
    priced = unit.select("*", F.inline(options)).withColumn(
        "cost_per_100k",
        F.col("scenario_review_cost") * F.col("review_cost")
        + F.col("scenario_block_cost") * F.col("block_cost")
        + F.col("missed_fraud_cost"),
    )
    keys = ["scenario_review_cost", "scenario_block_cost"]
    picked = choices(priced, capacity, by=keys)
    baseline = approve_all_cost(df, label, amount, Costs(chargeback_fee=fee))
    joined = with_constants(table.join(picked, keys), baseline)
    return joined.withColumn(
        "saving_vs_no_model", 1 - F.try_divide("cost_per_100k", "no_model_cost_per_100k")
    ).drop("no_model_cost_per_100k", "cost_per_100k")


def crosstab(df: DataFrame, decision: str, label: str) -> DataFrame:
    """Decisions against what the rows really were; all three decisions are present."""
    from riskloom.operators.decisions import kinds_frame

    counted = df.groupBy(F.col(decision).alias("decision")).agg(
        F.count_if(F.col(label) == 1).alias("fraud"), F.count_if(F.col(label) == 0).alias("normal")
    )
    return kinds_frame(df).join(counted, "decision", "left").fillna(0, ["fraud", "normal"])
