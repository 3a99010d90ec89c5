"""Labelled tables: duplicates, exact splits and folds, leakage checks, model inputs.

Splits follow a hash of the row id, so they are reproducible and independent of
partitioning, yet exact per class.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.scalars import cyclical_time, robust_scaled
from riskloom.operators.evaluation import hashed_fraction, top_cuts
from riskloom.operators.ranking import exact_quantiles, row_index_within

# The input contract of a labelled transaction table.
V_COLUMNS = tuple(f"V{i}" for i in range(1, 29))
RAW_FEATURES = ("Time", *V_COLUMNS, "Amount")
TARGET = "Class"
MODEL_FEATURES = ("Amount", "time_sin", "time_cos", *V_COLUMNS)


def features_only(df: DataFrame) -> DataFrame:
    """The model inputs in their fixed order; identities never reach a model."""
    return df.select(*RAW_FEATURES)


def normal_only(df: DataFrame, label: str = TARGET) -> DataFrame:
    """Rows labelled normal; an error when there is none."""
    normal = df.where(F.col(label) == 0)
    if normal.isEmpty():
        raise ValueError("no normal transactions")
    return normal


# ------------------------------------------------------------------ cleaning
def deduplicate(df: DataFrame) -> DataFrame:
    """One copy of each fully equal row, label included."""
    return df.dropDuplicates()


def duplicate_report(df: DataFrame, label: str) -> DataFrame:
    """How many rows are copies of an earlier one, and how many of those are fraud."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    fraud = F.when(F.col(label) == 1, 1).otherwise(0)
    return copies.agg(
        F.sum("_n").alias("rows"),
        F.sum(F.col("_n") - 1).alias("duplicates"),
        F.sum((F.col("_n") - 1) * fraud).alias("duplicate_fraud"),
        F.count(F.lit(1)).alias("rows_after"),
        F.sum(fraud).cast("long").alias("fraud_after"),
    )


def missing_cells(df: DataFrame) -> DataFrame:
    """Empty cells per column and in total, in one scan."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    cells = F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("missing")) for c in df.columns))
    total = F.struct(F.lit("(all)").alias("name"), sum((F.col(c) for c in df.columns), F.lit(0)).alias("missing"))
    return counts.select(F.inline(F.concat(cells, F.array(total))))


# ------------------------------------------------------------- splits by hash
def hash_order(row_id: str, seed: int) -> Column:
    return hashed_fraction(F.lit(seed), F.col(row_id))


def first_by_hash(df: DataFrame, label: str, row_id: str, wanted: dict, seed: int, bins: int = 4096) -> Column:
    """A condition true for exactly the first `wanted[y]` rows of each class in hash order.

    Found by counting rows per hash bin (a small table, whatever the data), then
    ranking only the one bin per class where the boundary falls. The wide rows
    are never shuffled: the answer is a comparison with one hash per class.
    """
    narrow = df.select(F.col(label).alias("_y"), hash_order(row_id, seed).alias("_h"), F.col(row_id).alias("_id"))
    binned = narrow.withColumn("_bin", F.floor(F.col("_h") * bins).cast("int"))
    per_bin = binned.where(F.col("_y").isin(list(wanted))).groupBy("_y", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_y").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    targets = df.sparkSession.createDataFrame([(y, int(k)) for y, k in wanted.items() if k > 0], "_y int, _k bigint")
    # Both sides hold at most bins rows per class.
    found = (
        per_bin.withColumn("_upto", F.sum("_n").over(upto))
        .join(F.broadcast(targets), "_y")
        .where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
        .select("_y", "_bin", (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_place"))
        .collect()
    )
    if not found:
        return F.lit(False)
    edge = df.sparkSession.createDataFrame([tuple(r) for r in found], "_y int, _bin int, _place bigint")
    ranked = row_index_within(binned.join(F.broadcast(edge), ["_y", "_bin"]), ["_y"], ["_h", "_id"], "_at", start=1)
    condition = F.lit(False)
    for row in ranked.where("_at = _place").collect():
        order = hash_order(row_id, seed)
        within = (order < row["_h"]) | ((order == row["_h"]) & (F.col(row_id) <= row["_id"]))
        condition = condition | ((F.col(label) == row["_y"]) & within)
    return condition


def class_sizes(df: DataFrame, label: str) -> dict:
    """Rows per class in one scan. A row with another label, or none, has no class to be split by and is refused."""
    row = df.agg(
        F.count_if(F.col(label) == 0).alias("normal"), F.count_if(F.col(label) == 1).alias("fraud"), F.count(F.lit(1)).alias("all")
    ).first()
    if row["normal"] + row["fraud"] < row["all"]:
        raise ValueError(f"{row['all'] - row['normal'] - row['fraud']} rows have a label other than 0 and 1")
    return {y: n for y, n in ((0, row["normal"]), (1, row["fraud"])) if n}


def holdout(df: DataFrame, label: str, row_id: str, share: float = 0.2, seed: int = 42, name: str = "is_test") -> DataFrame:
    """Marks exactly the rounded `share` of each class."""
    wanted = {y: int(n * share + 0.5) for y, n in class_sizes(df, label).items()}
    return df.withColumn(name, first_by_hash(df, label, row_id, wanted, seed))


def sample_per_class(df: DataFrame, label: str, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each class, reproducibly."""
    wanted = {y: min(n, size) for y, size in class_sizes(df, label).items()}
    return df.where(first_by_hash(df, label, row_id, wanted, seed))


def folds(df: DataFrame, label: str, row_id: str, k: int = 5, seed: int = 42, bins: int = 65_536) -> DataFrame:
    """Adds `fold`: the hash rank inside the class, modulo k, so classes spread evenly.

    Ranks come from fixed hash bins plus the rows before each bin: no window ever
    spans a class, and the broadcast table has at most two rows per bin. Every row
    gets a fold; rows without a label of 0 or 1 are refused.
    """
    class_sizes(df, label)
    bin_of = F.floor(F.col("_h") * bins).cast("int")
    hashed = df.withColumn("_h", hash_order(row_id, seed)).withColumn("_bin", bin_of)
    per_bin = hashed.groupBy(label, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bin.select(label, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(label, "_bin").orderBy("_h", row_id)
    ranked = hashed.withColumn("_in", F.row_number().over(inside) - 1).join(F.broadcast(offsets), [label, "_bin"], "left")
    fold = F.pmod(F.col("_before") + F.col("_in"), F.lit(k)).cast("int")
    return ranked.withColumn("fold", fold).select(*df.columns, "fold")


def time_split(df: DataFrame, time: str, row_id: str, share: float = 0.8, name: str = "is_train") -> DataFrame:
    """Marks the earliest `int(share * n)` rows, ties in row order."""
    early = int(share * df.count())
    keyed = df.withColumn("_recency", -F.col(time).cast("double"))
    cut = top_cuts(keyed.select("_recency", row_id), "_recency", row_id, [early])[0]
    return keyed.withColumn(name, cut.flags("_recency", row_id)).drop("_recency")


def split_summary(df: DataFrame, part: str, label: str) -> DataFrame:
    return df.groupBy(part).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(label).cast("long")).alias("fraud"),
        F.avg(F.col(label).cast("double")).alias("fraud_rate"),
    )


def leakage(train: DataFrame, test: DataFrame, row_id: str, features: Sequence[str]) -> DataFrame:
    """Ids in both parts, and pairs of rows that agree on every feature (nulls agree too).

    Pairs are multiplied out from per-value counts; a value copied into much of
    both parts costs one row, not the product of its copies.
    """

    def shared(columns: Sequence[str], name: str) -> DataFrame:
        side = lambda df, t: df.select(*columns, F.lit(t).alias("_t"))
        counted = (
            side(train, 1)
            .unionByName(side(test, 0))
            .groupBy(*columns)
            .agg(F.sum("_t").alias("_train"), F.sum(1 - F.col("_t")).alias("_test"))
        )
        return counted.where("_train > 0 and _test > 0").agg(
            F.count(F.lit(1)).alias(f"shared_{name}"),
            F.coalesce(F.sum(F.col("_train") * F.col("_test")), F.lit(0)).alias(f"{name}_pairs"),
        ).withColumn("_one", F.lit(1))

    return shared([row_id], "ids").join(shared(list(features), "rows"), "_one").drop("_one", "ids_pairs")


# ---------------------------------------------------------------- model inputs
def fit_scaling(train: DataFrame) -> dict[str, float]:
    """Quartiles of log(1 + Amount) over the training rows: exact, three numbers."""
    logged = train.select(F.log1p("Amount").alias("_x"))
    return exact_quantiles(logged, "_x", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).first().asDict()


def model_inputs(df: DataFrame, scaling: dict[str, float], keep: Sequence[str] = ()) -> DataFrame:
    """The 31 model columns; everything else is dropped unless kept."""
    q = {name: F.lit(value) for name, value in scaling.items()}
    sine, cosine = cyclical_time(F.col("Time"))
    amount = robust_scaled(F.log1p("Amount"), q["q25"], q["q50"], q["q75"])
    return df.select(*keep, amount.alias("Amount"), sine.alias("time_sin"), cosine.alias("time_cos"), *V_COLUMNS)


class ModelInputs(Estimator):
    """Learns the scaling from the rows it is fitted on, so that inside a fold it never sees the rows held out."""

    def __init__(self, others: Sequence[str] = V_COLUMNS):
        super().__init__()
        self.others = others

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        return preprocessing(fit_scaling(dataset), self.others).fit(dataset)


def preprocessing(scaling: dict[str, float], others: Sequence[str] = V_COLUMNS) -> Pipeline:
    """The same inputs as ML stages with a known scaling, so that a saved model carries its preprocessing."""
    spread = scaling["q75"] - scaling["q25"] or 1.0
    statement = (
        f"SELECT *, (log1p(Amount) - {scaling['q50']!r}D) / {spread!r}D AS scaled_amount, "
        "sin(2 * pi() * pmod(Time, 86400) / 86400) AS time_sin, "
        "cos(2 * pi() * pmod(Time, 86400) / 86400) AS time_cos FROM __THIS__"
    )
    assembler = VectorAssembler(
        inputCols=["scaled_amount", "time_sin", "time_cos", *others], outputCol="features", handleInvalid="error"
    )
    return Pipeline(stages=[SQLTransformer(statement=statement), assembler])
