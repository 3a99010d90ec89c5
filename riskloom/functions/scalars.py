"""Row-level functions: time on the clock, scaling, binning by fixed edges, clean-up."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECONDS_PER_DAY = 86_400
SECONDS_PER_HOUR = 3_600


def clock_angle(seconds: Column) -> Column:
    """Position of `seconds` on a 24 hour circle, in radians."""
    return F.lit(2 * math.pi) * F.pmod(seconds, F.lit(float(SECONDS_PER_DAY))) / F.lit(float(SECONDS_PER_DAY))


def cyclical_time(seconds: Column) -> tuple[Column, Column]:
    """(sin, cos) of the time of day, so that 23:59 and 00:01 are neighbours."""
    angle = clock_angle(seconds)
    return F.sin(angle), F.cos(angle)


def hour_of_day(seconds: Column) -> Column:
    return F.pmod(F.floor(seconds / SECONDS_PER_HOUR), F.lit(24)).cast("int")


def robust_scaled(value: Column, low: Column, middle: Column, high: Column) -> Column:
    """(value - median) / IQR, an IQR of zero counting as one."""
    spread = high - low
    return (value - middle) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)


def steps_at_or_below(value: Column, edges: Sequence[float]) -> Column:
    """How many of the sorted `edges` are <= value.

    A balanced tree of comparisons: log2(edges) per row inside generated code,
    where a range join or an array filter would touch every edge.
    """
    if list(edges) != sorted(set(edges)):
        raise ValueError("edges must be distinct and sorted")

    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(float(edges[mid])), between(mid + 1, hi)).otherwise(between(lo, mid))

    return between(0, len(edges))


def steps_below(value: Column, edges: Sequence[float]) -> Column:
    """How many of the sorted `edges` are < value (bins closed on the right)."""
    return F.lit(len(edges)) - steps_at_or_below(-value, [-edge for edge in reversed(edges)])


def finite_or_null(value: Column) -> Column:
    """NaN and the infinities as null."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(math.inf)), value)


def finite_frame(df: DataFrame) -> DataFrame:
    """`finite_or_null` on every double in the frame, inside structs and arrays too."""

    def clean(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return finite_or_null(value)
        if isinstance(kind, T.ArrayType):
            return F.transform(value, lambda item: clean(item, kind.elementType))
        if isinstance(kind, T.MapType):
            return F.transform_values(value, lambda _, item: clean(item, kind.valueType))
        if isinstance(kind, T.StructType):
            inner = F.struct(*(clean(value[f.name], f.dataType).alias(f.name) for f in kind.fields))
            return F.when(value.isNotNull(), inner)
        return value

    return df.select(*(clean(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def utc_timestamp(df: DataFrame, name: str) -> Column:
    """The column as an instant; a wall-clock column without a zone is refused."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        raise ValueError(f"{name} has no time zone; cast it in the zone it was written in")
    return F.col(name).cast("timestamp")


def window_start(seconds: int | None, now: datetime) -> datetime | None:
    """The oldest instant a window of `seconds` includes; None means everything."""
    return None if seconds is None else now - timedelta(seconds=seconds)


def break_even_precision(review_cost: float, false_block_cost: float) -> float:
    """Precision above which blocking is cheaper than reviewing."""
    return 1 - review_cost / false_block_cost


def min_max_risk(score: Column, low: Column, high: Column) -> Column:
    """Alternative scaling: distance below the reference maximum, clipped to [0, 1]."""
    return F.least(F.greatest((high - score) / (high - low), F.lit(0.0)), F.lit(1.0))


def negated_risk(score: Column) -> Column:
    """Alternative scaling: the anomaly score itself."""
    return -score
