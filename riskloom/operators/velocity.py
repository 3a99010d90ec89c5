"""What a card has been doing lately: trailing-window features over a batch of events.

Input columns: `transaction_id`, `card_id` (nullable), `Amount`, `country`
(nullable), `arrival_us` (microseconds) and `sequence` (arrival order among equal
instants). Every row sees itself and earlier rows of its card, never later ones.

Ends of the windows: an event exactly as old as the retention has been dropped,
while one exactly as old as a shorter window still counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ranking import broadcast_if_small, hot_keys, row_index
from riskloom.session import checkpointed

MICROS = 1_000_000

# Names and order of the features.
FEATURES = ("count_1m", "count_5m", "count_1h", "amount_1h", "countries_1h", "seconds_since_previous")
VELOCITY_TYPE = (
    "struct<count_1m:int,count_5m:int,count_1h:int,amount_1h:double,"
    "countries_1h:int,seconds_since_previous:double>"
)


@dataclass(frozen=True)
class VelocityWindows:
    """Lengths in seconds (the last is also the retention) and the newest events kept per card."""

    short: float = 60
    middle: float = 300
    long: float = 3600
    keep: int = 256

    def __post_init__(self) -> None:
        if not 0 < self.short <= self.middle <= self.long:
            raise ValueError("windows must be positive and sorted")
        if self.keep < 1:
            raise ValueError("at least the current event is kept")


def member_text(transaction_id: Column, amount: Column, country: Column) -> Column:
    """The text form of an event, `id|amount|country`, with the amount at two decimals."""
    money = F.format_string("%.2f", amount.cast("double"))
    return F.concat_ws("|", transaction_id, money, F.coalesce(country, F.lit("")))


def parse_member(member: Column) -> Column:
    """struct(transaction_id, amount, country): read from the right, ids may hold the separator."""
    parts = F.split(member, r"\|")
    n = F.size(parts)
    return F.struct(
        F.array_join(F.slice(parts, F.lit(1), n - 2), "|").alias("transaction_id"),
        F.element_at(parts, n - 1).cast("double").alias("amount"),
        F.element_at(parts, n).alias("country"),
    )


def collapse_redeliveries(events: DataFrame) -> DataFrame:
    """One row per event: the same id, amount and country again replaces its earlier arrival."""
    rest = [c for c in events.columns if c not in ("transaction_id", "card_id")]
    keyed = events.withColumn("_cents", F.round(F.col("Amount") * 100).cast("long")).withColumn(
        "_place", F.coalesce("country", F.lit(""))
    )
    newest = keyed.groupBy("card_id", "transaction_id", "_cents", "_place").agg(
        F.max_by(F.struct(*rest), F.struct("arrival_us", "sequence")).alias("_row")
    )
    return newest.select("transaction_id", "card_id", *(F.col(f"_row.{c}").alias(c) for c in rest)).select(
        *events.columns
    )


def _features(kept: Column, now: Column, windows: VelocityWindows) -> Column:
    """The struct of features from the retained events of the card, the current one last."""
    us = lambda seconds: F.lit(int(seconds * MICROS))
    count_since = lambda w: F.size(F.filter(kept, lambda e: e["us"] >= now - us(w)))
    cents = F.aggregate(kept, F.lit(0).cast("long"), lambda total, e: total + e["cents"])
    places = F.array_distinct(F.filter(F.transform(kept, lambda e: e["place"]), lambda p: p != ""))
    previous = F.when(F.size(kept) > 1, F.element_at(kept, F.size(kept) - 1)["us"])
    return F.struct(
        count_since(windows.short).alias("count_1m"),
        count_since(windows.middle).alias("count_5m"),
        F.size(kept).alias("count_1h"),
        (cents / F.lit(100.0)).alias("amount_1h"),
        F.size(places).alias("countries_1h"),
        F.round((now - previous) / F.lit(float(MICROS)), 3).alias("seconds_since_previous"),
    )


def _history(partition: list[str], order: list[str], keep: int) -> Column:
    """The newest `keep` events up to the current row: a row frame, so the work per row is bounded."""
    frame = Window.partitionBy(*partition).orderBy(*order).rowsBetween(-(keep - 1), 0)
    event = F.struct(
        F.col("arrival_us").alias("us"),
        F.round(F.col("Amount") * 100).cast("long").alias("cents"),
        F.coalesce("country", F.lit("")).alias("place"),
    )
    return F.collect_list(event).over(frame)


def _measured(rows: DataFrame, partition: list[str], order: list[str], windows: VelocityWindows) -> DataFrame:
    """Separate projections, so that the retained events are filtered once and not once per feature."""
    oldest = F.col("arrival_us") - F.lit(int(windows.long * MICROS))
    kept = rows.withColumn("_seen", _history(partition, order, windows.keep)).withColumn(
        "_kept", F.filter("_seen", lambda e: e["us"] > oldest)
    )
    features = _features(F.col("_kept"), F.col("arrival_us"), windows).cast(VELOCITY_TYPE)
    return kept.withColumn("velocity", F.when(F.col("card_id").isNotNull(), features)).drop("_seen", "_kept")


def _measured_in_slices(rows: DataFrame, windows: VelocityWindows, slice_rows: int) -> DataFrame:
    """Exact features of very busy cards, cut into slices of consecutive events.

    A row needs at most `keep - 1` predecessors, so each slice also receives
    that many closing rows of the slice before it, as context only.
    """
    step = max(slice_rows, windows.keep)
    placed = row_index(rows, ["card_id", "arrival_us", "sequence", "transaction_id"], "_place_in_all")
    home = F.floor(F.col("_place_in_all") / step)
    closing = F.col("_place_in_all") % step >= step - (windows.keep - 1)
    copies = placed.withColumn(
        "_slice", F.explode(F.when(closing, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    measured = _measured(copies, ["card_id", "_slice"], ["_place_in_all"], windows)
    return measured.where(F.col("_slice") == home).drop("_slice", "_place_in_all")


def without_velocity(events: DataFrame) -> DataFrame:
    """The pass-through: features unknown, rows still scored."""
    return events.withColumn("velocity", F.lit(None).cast(VELOCITY_TYPE))


def measure(
    events: DataFrame,
    windows: VelocityWindows = VelocityWindows(),
    hot_rows: int = 2_000_000,
    slice_rows: int = 262_144,
) -> DataFrame:
    """Adds the `velocity` struct, null for rows without a card.

    One scan and one shuffle by card. Cards with more than `hot_rows` events are
    found by a map-side combined count and measured in slices, so no task ever
    owns one of them whole. Rows without a card are spread by their own hash.
    """
    hot = checkpointed(hot_keys(events, "card_id", hot_rows))
    some = not hot.isEmpty()
    own = F.xxhash64("transaction_id", "arrival_us", "sequence").cast("string")
    order = ["arrival_us", "sequence", "transaction_id"]
    usual = events
    if some:
        listed = broadcast_if_small(hot)
        usual = events.join(listed, "card_id", "left_anti")
    keyed = usual.withColumn("_key", F.coalesce("card_id", own))
    measured = _measured(keyed, ["_key"], order, windows).select(*events.columns, "velocity")
    if some:
        busy = _measured_in_slices(events.join(listed, "card_id", "left_semi"), windows, slice_rows)
        measured = measured.unionByName(busy)
    return measured


def flatten(df: DataFrame, prefix: str = "velocity_") -> DataFrame:
    """The struct as prefixed columns; a null struct gives nulls."""
    kept = [c for c in df.columns if c != "velocity"]
    return df.select(*kept, *(F.col(f"velocity.{name}").alias(prefix + name) for name in FEATURES))


def nest(df: DataFrame, prefix: str = "velocity_") -> DataFrame:
    """The inverse of `flatten`: a null hourly count means there was no measurement."""
    names = [prefix + name for name in FEATURES]
    whole = F.struct(*(F.col(prefix + name).alias(name) for name in FEATURES)).cast(VELOCITY_TYPE)
    return df.withColumn("velocity", F.when(F.col(prefix + "count_1h").isNotNull(), whole)).drop(*names)
