"""Labelled tables in and out of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskloom.operators.prep import RAW_FEATURES, TARGET


def check_columns(columns: list[str]) -> None:
    """Missing columns are an error that lists them sorted; extra ones are kept."""
    missing = sorted({*RAW_FEATURES, TARGET} - set(columns))
    if missing:
        raise ValueError(f"columns to be added to the table first: {missing}")


def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """A labelled CSV with header. Known columns are numeric; others stay text.

    Only the header is looked at to build the schema; the data is read once.
    """
    header = spark.read.option("header", True).csv(path).columns
    check_columns(header)
    kinds = {**{c: T.DoubleType() for c in RAW_FEATURES}, TARGET: T.IntegerType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer files than there are cores, dealt out to all of them before a costly step; others as they are.

    A file of one row group is read by one task, however large the step behind it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def save_splits(df: DataFrame, path: str, is_test: str = "is_test") -> None:
    """Raw values of both parts, unscaled, so that every later step sees the same rows."""
    for part, wanted in (("train", False), ("test", True)):
        df.where(df[is_test] == wanted).select(*RAW_FEATURES, TARGET).write.mode("overwrite").parquet(f"{path}/{part}")


def load_splits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/test")
