"""Thresholds, decisions and the velocity rules that escalate them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decision names, in order of severity.
APPROVE, REVIEW, BLOCK = "approve", "review", "block"
KINDS = (APPROVE, REVIEW, BLOCK)


@dataclass(frozen=True)
class Thresholds:
    """`review` and `block` are both inclusive; no block threshold means never block."""

    review: float = 0.24
    block: float | None = 0.95

    def __post_init__(self) -> None:
        if not 0 <= self.review <= 1:
            raise ValueError(f"review threshold {self.review} is outside [0, 1]")
        if self.block is not None and not self.review <= self.block <= 1:
            raise ValueError(f"block threshold {self.block} is outside [{self.review}, 1]")


@dataclass(frozen=True)
class RuleLimits:
    """Limits of the built-in rules. A count fires above its limit, the gap below it."""

    per_minute: int = 5
    per_hour: int = 10
    countries: int = 2
    gap_seconds: float = 2.0


@dataclass(frozen=True)
class Rule:
    """A named condition over the velocity struct column."""

    name: str
    description: str
    fires: Column


def velocity_rules(limits: RuleLimits = RuleLimits(), velocity: str = "velocity") -> list[Rule]:
    """The built-in rules in reporting order. Append to the list to extend it."""
    seen = F.col(velocity)
    # The names and descriptions of the rules, as results carry them.
    return [
        Rule(
            "many_in_a_minute",
            f"more than {limits.per_minute} transactions on this card in a minute",
            seen["count_1m"] > limits.per_minute,
        ),
        Rule(
            "many_in_an_hour",
            f"more than {limits.per_hour} transactions on this card in an hour",
            seen["count_1h"] > limits.per_hour,
        ),
        Rule(
            "several_countries",
            f"used in {limits.countries + 1} or more countries within an hour",
            seen["countries_1h"] > limits.countries,
        ),
        Rule(
            "back_to_back",
            f"another transaction on this card less than {limits.gap_seconds:g}s earlier",
            seen["seconds_since_previous"] < limits.gap_seconds,
        ),
    ]


def decide(risk: Column, thresholds: Thresholds) -> Column:
    """The decision for a risk. Both thresholds are inclusive."""
    risk = risk.cast("double")
    decided = F.when(risk >= thresholds.review, REVIEW).otherwise(APPROVE)
    if thresholds.block is None:
        return decided
    return F.when(risk >= thresholds.block, BLOCK).otherwise(decided)


def decide_by(risk: Column, review: Column, block: Column) -> Column:
    """`decide` with thresholds read from columns; a null block threshold never blocks."""
    return F.when(risk >= block, BLOCK).when(risk >= review, REVIEW).otherwise(APPROVE)


def reasons(rules: Sequence[Rule]) -> Column:
    """Names of the rules that fire, in rule order; empty for a null velocity."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(rule.fires, F.lit(rule.name)) for rule in rules)))


def escalate(decision: Column, fired: Column) -> Column:
    """An approval becomes a review when a rule fired. Nothing else changes."""
    return F.when((decision == APPROVE) & (F.size(fired) > 0), F.lit(REVIEW)).otherwise(decision)


def was_escalated(model_decision: Column, decision: Column) -> Column:
    """True where the rules changed what the model decided."""
    return F.coalesce(model_decision != decision, F.lit(False))


def rule_table(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, description) rows for the registered rules."""
    rows = [(rule.name, rule.description) for rule in rules]
    return df.sparkSession.createDataFrame(rows, "rule string, description string")


def described(df: DataFrame, rule_column: str, rules: Sequence[Rule]) -> DataFrame:
    """Adds `description`: the registered text, or the rule's own name when unknown."""
    known = F.create_map(*(F.lit(x) for rule in rules for x in (rule.name, rule.description)))
    return df.withColumn("description", F.coalesce(known[F.col(rule_column)], F.col(rule_column)))
