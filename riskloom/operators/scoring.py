"""Risk to decision: one pass of expressions over measured transactions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.rules import Rule, Thresholds, decide, escalate, reasons, velocity_rules
from riskloom.operators import velocity as vel

# Columns of a scoring result, in order.
RESULT_COLUMNS = (
    "transaction_id",
    "risk_score",
    "decision",
    "review_threshold",
    "block_threshold",
    "model_version",
    "card_id",
    "velocity",
    "model_decision",
    "reasons",
)

# A risk provider adds `risk_score` to a frame of transactions.
RiskProvider = Column | Transformer | Callable[[DataFrame], DataFrame]


def with_risk(df: DataFrame, model: RiskProvider, probability: str = "probability") -> DataFrame:
    """Adds `risk_score` from a column expression, a fitted ML model, or a function."""
    if isinstance(model, Column):
        return df.withColumn("risk_score", model.cast("double"))
    if isinstance(model, Transformer):
        added = [c for c in model.transform(df.limit(0)).columns if c not in df.columns]
        scored = model.transform(df)
        return scored.withColumn("risk_score", vector_to_array(F.col(probability))[1]).drop(*added)
    return model(df)


def score(
    measured: DataFrame,
    model: RiskProvider,
    thresholds: Thresholds = Thresholds(),
    version: str = "unversioned",
    rules: Sequence[Rule] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The result row of each transaction. Row-wise, so batching cannot change an answer.

    The model alone gives `risk_score` and `model_decision`; rules can only turn
    an approval into a review, and every fired rule is named.
    """
    rules = velocity_rules() if rules is None else rules
    scored = with_risk(measured, model)
    decided = scored.withColumn("model_decision", decide(F.col("risk_score"), thresholds)).withColumn(
        "reasons", reasons(rules)
    )
    return decided.select(
        "transaction_id",
        "risk_score",
        escalate(F.col("model_decision"), F.col("reasons")).alias("decision"),
        F.lit(float(thresholds.review)).alias("review_threshold"),
        F.lit(thresholds.block).cast("double").alias("block_threshold"),
        F.lit(version).alias("model_version"),
        "card_id",
        "velocity",
        "model_decision",
        "reasons",
        *keep,
    )


def score_batch(
    transactions: DataFrame,
    model: RiskProvider,
    thresholds: Thresholds = Thresholds(),
    version: str = "unversioned",
    windows: vel.VelocityWindows | None = vel.VelocityWindows(),
    rules: Sequence[Rule] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Measure, then score. `windows=None` scores without velocity features."""
    measured = vel.without_velocity(transactions) if windows is None else vel.measure(transactions, windows)
    return score(measured, model, thresholds, version, rules, keep)


def attach_features(transactions: DataFrame, features: DataFrame) -> DataFrame:
    """Joins separately measured features by id; each transaction must have exactly one row.

    A missing or repeated row fails the job when it runs, inside the join itself.
    """
    counted = features.groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("_n"), F.any_value("velocity").alias("velocity")
    )
    joined = transactions.join(counted, "transaction_id", "left")
    bad = F.col("_n").isNull() | (F.col("_n") != 1)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no single feature row for "), F.col("transaction_id"))))
    return joined.withColumn("velocity", F.coalesce(checked.cast(vel.VELOCITY_TYPE), F.col("velocity"))).drop("_n")


def threshold_drift(metadata: DataFrame, served: Thresholds) -> DataFrame:
    """Models whose trained thresholds differ from the served pair, null-safe."""
    review, block = F.lit(float(served.review)), F.lit(served.block).cast("double")
    same = F.col("trained_review").eqNullSafe(review) & F.col("trained_block").eqNullSafe(block)
    return metadata.where(~same).select(
        "model_version", "trained_review", "trained_block", review.alias("served_review"), block.alias("served_block")
    )


def first_with_decision(scored: DataFrame, decision: str | None, n: int, order: Sequence[str]) -> DataFrame:
    """The first `n` rows with a wanted decision; an error when fewer match."""
    wanted = scored if decision is None else scored.where(F.col("decision") == decision)
    chosen = wanted.orderBy(*order).limit(n)
    found = chosen.count()
    if found < n:
        raise ValueError(f"only {found} transactions match; asked for {n}")
    return chosen


def rule_what_if(measured: DataFrame, model_decision: Column, settings: Sequence[tuple[str, Sequence[Rule]]]) -> DataFrame:
    """Share of traffic each rule setting would move from approve to review, in one scan."""
    base = measured.withColumn("_model", model_decision)
    shares = [
        F.struct(
            F.lit(name).alias("setting"),
            F.count_if((F.col("_model") == "approve") & reduce(lambda a, b: a | b, [F.coalesce(r.fires, F.lit(False)) for r in rules])).alias("escalated"),
            F.count(F.lit(1)).alias("transactions"),
        )
        for name, rules in settings
    ]
    row = base.agg(F.array(*shares).alias("all"))
    return row.select(F.inline("all")).withColumn("share", F.col("escalated") / F.col("transactions"))
