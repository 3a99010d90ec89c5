"""Positions and running totals over a whole table without a one-task window.

Spark runs `Window.orderBy(..)` without a partition key in a single task. Here a
range-partitioned sort lays the rows out over the cluster, the position inside
each block is written down once (so it cannot change on a retry), and a table
with one row per block carries the totals from one block to the next.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import checkpointed

POSITION_BITS = 33  # layout of monotonically_increasing_id: block above, row below


def laid_out(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Rows sorted by `order`, with `_block` and `_row` (0-based inside the block).

    `order` should end in a column that makes keys distinct: blocks are cut
    between keys, so equal keys stay in one block.
    """
    numbered = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = checkpointed(numbered)
    return (
        stored.withColumn("_block", F.shiftright("_at", POSITION_BITS).cast("int"))
        .withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))
        .drop("_at")
    )


def row_index(df: DataFrame, order: Sequence[Column | str], name: str = "position", start: int = 0) -> DataFrame:
    """Adds the dense position of each row in the total order, as a bigint."""
    laid = laid_out(df, order)
    # One row per block: bounded by the number of sort partitions, not by the data.
    heads = laid.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        laid.join(F.broadcast(heads), "_block")
        .withColumn(name, F.col("_before") + F.col("_row") + F.lit(start))
        .drop("_block", "_row", "_before")
    )


def broadcast_if_small(df: DataFrame, at_most: int = 10_000) -> DataFrame:
    """Hint a broadcast only after counting: at most `at_most` rows, else a plain join."""
    return F.broadcast(df) if df.limit(at_most + 1).count() <= at_most else df


def with_constants(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row frame as literals: totals need no join."""
    row = one_row.first()
    return df.select(
        "*", *(F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in one_row.schema.fields)
    )


def row_index_within(
    df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "position", start: int = 0
) -> DataFrame:
    """`row_index` restarted for each value of `by` (not null), however large a group is."""
    whole = row_index(df, [*by, *order], "_whole")
    firsts = whole.groupBy(*by).agg(F.min("_whole").alias("_first"))
    return (
        whole.join(broadcast_if_small(firsts), list(by))
        .withColumn(name, F.col("_whole") - F.col("_first") + F.lit(start))
        .drop("_whole", "_first")
    )


def _sums_within(totals: Mapping[str, str], by: Sequence[str]):
    """An Arrow function that adds running sums over one sorted partition, restarted where `by` changes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carried = None, dict.fromkeys(totals, 0)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            begins = np.zeros(n, bool)
            for c in by:
                column = batch.column(c)
                missing = pc.is_null(column).to_numpy(zero_copy_only=False)
                changed = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), False)
                begins[1:] |= changed.to_numpy(zero_copy_only=False) | (missing[1:] != missing[:-1])
            goes_on = group == [batch.column(c)[0].as_py() for c in by]
            group = [batch.column(c)[n - 1].as_py() for c in by]
            begins[0] = True
            heads = np.flatnonzero(begins)
            sizes = np.diff(np.append(heads, n))
            sums = []
            for new, source in totals.items():
                values = pc.fill_null(batch.column(source), 0).to_numpy(zero_copy_only=False)
                if values.dtype.kind == "f":  # no differences of sums: they would round
                    upto = np.concatenate([np.cumsum(run, dtype=np.float64) for run in np.split(values, heads[1:])])
                else:
                    upto = np.cumsum(values, dtype=np.int64)
                    upto -= np.repeat(upto[heads] - values[heads], sizes)
                if goes_on:
                    upto[: sizes[0]] += carried[new]
                carried[new] = upto[-1]
                sums.append(pa.array(upto))
            names = [*batch.schema.names, *(f"_in_{new}" for new in totals)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *sums], names)

    return rows


def running_totals(
    df: DataFrame, order: Sequence[Column | str], totals: Mapping[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Adds inclusive running sums in `order`, restarted per value of `by` (null is a value).

    `totals` maps new column names to the columns they sum, integers or doubles;
    nulls add nothing. `order` must be distinct inside each `by` group: collapse
    ties with a groupBy first, which also shrinks the table before it is sorted.

    Rows move once, in the sort. Sums inside a sorted partition are made while
    it is written down; the next partition needs what the one group that
    straddles the border had before it, one row per border.
    """
    odd = [c for c in totals.values() if not isinstance(df.schema[c].dataType, (T.IntegralType, T.FractionalType)) or isinstance(df.schema[c].dataType, T.DecimalType)]
    if odd:
        raise ValueError(f"running totals need integers or doubles: {odd}")
    kinds = {new: "double" if isinstance(df.schema[c].dataType, T.FractionalType) else "bigint" for new, c in totals.items()}
    placed = df.orderBy(*by, *order).withColumn("_block", F.spark_partition_id())
    fields = [*placed.schema.fields, *(T.StructField(f"_in_{new}", T._parse_datatype_string(kind)) for new, kind in kinds.items())]
    stored = checkpointed(placed.mapInArrow(_sums_within(totals, by), T.StructType(fields)))
    keys = [*by, "_block"]
    heads = stored.groupBy(*keys).agg(*(F.sum(source).alias(f"_sum_{new}") for new, source in totals.items()))
    blocks = Window.partitionBy(*by).orderBy("_block")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(
        *(F.col(k).alias(f"_at_{k}") for k in keys),
        F.row_number().over(blocks).alias("_nth"),
        *(F.sum(f"_sum_{new}").over(before).alias(f"_head_{new}") for new in totals),
    ).where("_nth > 1")
    # Sorted by group, a block can continue only one group of earlier blocks: fewer rows than sort partitions.
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys))
    joined = stored.join(F.broadcast(heads), same, "left")
    return joined.select(
        *df.columns, *((F.col(f"_in_{new}") + F.coalesce(f"_head_{new}", F.lit(0))).alias(new) for new in totals)
    )


APPROX_ACCURACY = 10_000  # percentile_approx is off by at most one in this many ranks


def _near_quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Keeps values near the wanted quantiles and collapses the rest onto what lies before them.

    Counts, and so ranks, stay what they were. Approximate quantiles twice their
    error away on either side bracket each exact one; small groups are kept whole.
    """
    margin, infinite = 2 / APPROX_ACCURACY, float("inf")
    asked = [q for p in probabilities for q in (max(p - margin, 0.0), min(p + margin, 1.0))]
    column = F.col(value).cast("double")
    approximate = F.percentile_approx(column, [float(q) for q in asked], APPROX_ACCURACY)
    open_ends = F.array(*(F.lit(x) for _ in probabilities for x in (-infinite, infinite)))
    ends = df.groupBy(*by).agg(
        F.when(F.count(F.lit(1)) < 5 * APPROX_ACCURACY, open_ends).otherwise(approximate).alias("_ends")
    )
    with_ends = df.join(broadcast_if_small(ends), list(by)) if by else with_constants(df, ends)
    brackets = []
    for i, p in enumerate(probabilities):
        low = F.lit(-infinite) if p <= margin else F.get("_ends", F.lit(2 * i))
        high = F.lit(infinite) if p >= 1 - margin else F.get("_ends", F.lit(2 * i + 1))
        brackets.append((low, high))
    inside = reduce(lambda x, y: x | y, (column.between(low, high) for low, high in brackets))
    before = [F.when(high < column, high).otherwise(F.lit(-infinite)) for _, high in brackets]
    gap = F.greatest(*before) if len(before) > 1 else before[0]
    return with_ends.select(*by, F.when(inside, column).otherwise(gap).alias(value))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Linear-interpolated quantiles, one row per `by` group, one column per name.

    Equal to the built-in `percentile`, whose buffer keeps every distinct value
    of a group in one task. Here an approximate first pass leaves only values
    near the wanted ranks apart (under a thousandth of a large group for each
    quantile), the rest is collapsed to counts, and what is left is ranked across
    the cluster; the result stays exact.
    """
    known = df.where(F.col(value).isNotNull()).select(*by, value)
    known = _near_quantiles(known, value, list(probabilities.values()), by)
    counted = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counted, [value], {"_upto": "_n"}, by)
    sizes = ranked.groupBy(*by).agg(F.max("_upto").alias("_size"))
    ranked = ranked.join(broadcast_if_small(sizes), list(by)) if by else with_constants(ranked, sizes)
    last = F.col("_size") - 1
    parts = []
    for name, p in probabilities.items():
        rank = F.lit(float(p)) * last
        low, high = F.floor(rank), F.ceil(rank)
        holds = lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n"))
        parts += [
            F.max(F.when(holds(low), F.col(value))).alias(f"_low_{name}"),
            F.max(F.when(holds(high), F.col(value))).alias(f"_high_{name}"),
            F.max(rank - low).alias(f"_part_{name}"),
        ]
    picked = ranked.groupBy(*by).agg(*parts)
    lerp = lambda n: F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")
    return picked.select(*by, *(lerp(name).alias(name) for name in probabilities))


def hot_keys(df: DataFrame, key: str, more_than: int) -> DataFrame:
    """All keys with over `more_than` rows, as one column `key`: counted with a map-side combine, never collected."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counted.where(F.col("_n") > more_than).select(key)
