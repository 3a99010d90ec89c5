"""First looks at a labelled table: balance, distributions by class, separation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalars import hour_of_day
from riskloom.operators.ranking import broadcast_if_small, exact_quantiles

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Counts, the fraud rate, one fraud per how many, and the always-normal baseline."""
    fraud = F.count_if(F.col(label) == 1)
    counted = df.agg(F.count_if(F.col(label) == 0).alias("normal"), fraud.alias("fraud"))
    total = F.col("normal") + F.col("fraud")
    return counted.select(
        "normal",
        "fraud",
        F.try_divide("fraud", total).alias("fraud_rate"),
        F.floor(F.try_divide(total, "fraud")).alias("one_in"),
        F.try_divide("normal", total).alias("always_normal_accuracy"),
        F.lit(0.0).alias("always_normal_recall"),
    )


def describe_by(df: DataFrame, value: str, by: str) -> DataFrame:
    """Count, mean, sample deviation, exact quartiles, ends and zeros per class."""
    basics = df.groupBy(by).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        F.count_if(F.col(value) == 0).alias("zeros"),
    )
    return basics.join(broadcast_if_small(exact_quantiles(df, value, QUARTILES, [by])), by)


def rate_by_hour(df: DataFrame, time: str, label: str) -> DataFrame:
    return df.groupBy(hour_of_day(F.col(time)).alias("hour")).agg(
        F.count(F.lit(1)).alias("transactions"), F.avg(F.col(label).cast("double")).alias("fraud_rate")
    )


def _unpivoted(one_row: DataFrame, names: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One row per name from an aggregate of many columns; `fields` maps output to column suffix."""
    rows = [
        F.struct(F.lit(n).alias("feature"), *(F.col(f"{n}{suffix}").alias(out) for out, suffix in fields.items()))
        for n in names
    ]
    return one_row.select(F.inline(F.array(*rows)))


def class_mean_gap(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """How far apart the class means are, per feature, widest first. One scan for all features."""
    mean = lambda c, y: F.avg(F.when(F.col(label) == y, F.col(c).cast("double")))
    means = df.agg(*(mean(c, y).alias(f"{c}_{y}") for c in features for y in (0, 1)))
    long = _unpivoted(means, features, {"normal_mean": "_0", "fraud_mean": "_1"})
    return long.withColumn("gap", F.abs(F.col("normal_mean") - F.col("fraud_mean"))).orderBy(F.desc("gap"), "feature")


def label_correlation(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of every feature with the label, in one scan."""
    all_of_them = df.agg(*(F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in features))
    return _unpivoted(all_of_them, features, {"correlation": ""}).orderBy("correlation", "feature")


def box_statistics(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles and whiskers per class: the last values within 1.5 IQR of the box."""
    quartiles = exact_quantiles(df, value, QUARTILES, [by])
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    joined = df.select(by, value).join(broadcast_if_small(quartiles), by)
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    return joined.groupBy(by).agg(
        F.max("q25").alias("q25"),
        F.max("q50").alias("q50"),
        F.max("q75").alias("q75"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def density_histogram(df: DataFrame, value: Column, by: str, bins: int) -> DataFrame:
    """Equal-width bins over each class's own range, the last one closed; every bin is returned."""
    rows = df.select(F.col(by).alias("_y"), value.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    ends = rows.groupBy("_y").agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_size")
    )
    ends = ends.withColumn("_width", (F.col("_hi") - F.col("_lo")) / bins)
    small = broadcast_if_small(ends)
    spot = F.least(F.floor(F.try_divide(F.col("_x") - F.col("_lo"), F.col("_width"))), F.lit(bins - 1))
    counted = rows.join(small, "_y").groupBy("_y", F.coalesce(spot, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("_n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    filled = every.join(counted, ["_y", "bin"], "left")
    n = F.coalesce("_n", F.lit(0))
    return filled.select(
        F.col("_y").alias(by),
        F.col("bin").cast("int").alias("bin"),
        (F.col("_lo") + F.col("bin") * F.col("_width")).alias("bin_low"),
        n.alias("n"),
        F.try_divide(n, F.col("_size") * F.col("_width")).alias("density"),
    )
