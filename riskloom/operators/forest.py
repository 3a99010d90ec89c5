"""Isolation forest: many small trees on small samples, fitted and applied in parallel.

After Liu, Ting and Zhou (2008). A tree sees at most `sample_rows` rows, so the
fit touches a vanishing part of a large table; scoring is one pass over it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.evaluation import calibrated
from riskloom.operators.ranking import exact_quantiles

NODE_SCHEMA = "tree int, node int, feature int, cut double, below int, above int, path double"
SPARE = 1.3  # drawn beyond the sample size, so that trimming leaves full samples
EULER_GAMMA = 0.5772156649015329


def expected_path(rows: int) -> float:
    """Mean path length of an unsuccessful search among this many rows."""
    if rows <= 1:
        return 0.0
    if rows == 2:
        return 1.0
    return 2.0 * (math.log(rows - 1) + EULER_GAMMA) - 2.0 * (rows - 1) / rows


def deepest(rows: int) -> int:
    """The depth at which a tree over this many rows ends; growing and walking must agree on it."""
    return max(1, math.ceil(math.log2(max(rows, 2))))


def samples(df: DataFrame, row_id: str, features: Column, trees: int, sample_rows: int, seed: int) -> DataFrame:
    """(tree, x) with at most `sample_rows` rows per tree, chosen by hash.

    Every row asks every tree by a cheap hash whether it is wanted, as one array
    filter; only the few wanted pairs become rows. Trees want SPARE times the
    sample, so that all but a vanishing share end full. Copies of a row count.
    """
    share = min(1.0, SPARE * sample_rows / max(df.count(), 1))
    drawn = lambda t: F.pmod(F.xxhash64(F.col("_id"), t, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    base = df.select(F.col(row_id).alias("_id"), features.alias("x"))
    asked = base.withColumn("tree", F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: drawn(t) < share))
    wanted = asked.where(F.size("tree") > 0).select("_id", "x", F.explode("tree").alias("tree")).withColumn("_u", drawn(F.col("tree")))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("_u", "_id"))  # about 1.3 samples per group
    return wanted.withColumn("_place", place).where(F.col("_place") <= sample_rows).select("tree", "x")


def grow(tree: int, x: np.ndarray, limit: int, seed: int) -> pd.DataFrame:
    """One random tree over a sample, as node rows; leaves carry the path length they stand for."""
    rng = np.random.default_rng([seed, tree])
    nodes, waiting = [], [(0, np.arange(len(x)), 0)]
    made = 1
    while waiting:
        node, rows, depth = waiting.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varied):
            nodes.append((tree, node, -1, 0.0, node, node, depth + expected_path(len(rows))))
            continue
        feature = int(rng.choice(varied))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_below = x[rows, feature] <= cut
        nodes.append((tree, node, feature, cut, made, made + 1, 0.0))
        waiting += [(made, rows[goes_below], depth + 1), (made + 1, rows[~goes_below], depth + 1)]
        made += 2
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "below", "above", "path"])


@dataclass
class IsolationForest:
    """A fitted forest: fixed-size node tables, a few hundred rows per tree."""

    nodes: pd.DataFrame
    sample_rows: int

    def score(self, df: DataFrame, features: Column, name: str = "raw") -> DataFrame:
        """Adds the anomaly score; lower means stranger."""
        tables = [
            tuple(part[c].to_numpy() for c in ("feature", "cut", "below", "above", "path"))
            for _, part in self.nodes.sort_values(["tree", "node"]).groupby("tree")
        ]
        shared = df.sparkSession.sparkContext.broadcast(tables)
        depth = deepest(self.sample_rows)
        usual = expected_path(self.sample_rows)

        @F.pandas_udf("double")
        def isolation(rows: pd.Series) -> pd.Series:
            x = np.stack(rows.to_numpy()).astype("float64")
            total, every = np.zeros(len(x)), np.arange(len(x))
            for feature, cut, below, above, path in shared.value:
                at = np.zeros(len(x), dtype="int64")
                for _ in range(depth):  # leaves lead to themselves
                    at = np.where(x[every, feature[at]] <= cut[at], below[at], above[at])
                total += path[at]
            share = total / len(shared.value) / usual if usual else np.ones(len(x))  # of one row no path is unusual
            return pd.Series(-(2.0 ** -share))

        return df.withColumn(name, isolation(features))


def fit_forest(
    normal: DataFrame, row_id: str, features: Column, trees: int = 200, sample_rows: int = 256, seed: int = 42
) -> IsolationForest:
    """Trees grown one per group, in parallel; only their node rows come back.

    With fewer rows than a sample asks for, depth and usual path are those of the rows there are.
    """
    known = min(sample_rows, normal.count())
    if not known:
        raise ValueError("there are no normal rows to grow trees from")
    limit = deepest(known)

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return grow(int(key[0]), np.stack(part["x"].to_numpy()).astype("float64"), limit, seed)

    drawn = samples(normal, row_id, features, trees, sample_rows, seed)
    return IsolationForest(drawn.groupBy("tree").applyInPandas(fit, NODE_SCHEMA).toPandas(), known)


def forest_risk(forest: IsolationForest, normal: DataFrame, scored: DataFrame, features: Column) -> DataFrame:
    """Adds `raw` and `risk`, the share of normal rows that look less strange."""
    reference = forest.score(normal, features).select("raw")
    return calibrated(reference, forest.score(scored, features), "raw")


def contamination_cut(scored: DataFrame, share: float, name: str = "raw") -> DataFrame:
    """The score below which the strangest `share` of rows lies; it moves no ranking."""
    return exact_quantiles(scored, name, {"offset": share})


def vector(columns: Sequence[str]) -> Column:
    return F.array(*(F.col(c).cast("double") for c in columns))
