"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each source partition go to each target is drawn first, as if all rows had been shuffled: a matrix whose
rows sum to the partitions' sizes and whose columns to the targets'. Each partition then permutes its own rows and deals
them out by its row of the matrix; after the exchange each target permutes what it got. No sort of the whole table, and
every target has its exact size beforehand, so places in a shard are known without counting.

The matrix is never held anywhere. It is split by halves of the partitions: the left half of a range of partitions gets a
multivariate hypergeometric share of what the range sends to each target. These splits are seeded, so each task draws
those on the way to its own partition, and a task that is repeated draws the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.ranking import POSITION_BITS
from riskloom.session import checkpointed, ship

SHARDS, SEED = 8, 20_240
LANE_ROWS = 1 << 21  # rows of a target at most: what one task permutes after the exchange
LANES_PER_TASK = 4  # targets for each shuffle partition, so that these are about as full
PARTITIONS = 1 << 20  # source partitions at most, of which every task knows the sizes (8 bytes each)
NUMPY_MOST = 10**9 - 1  # rows up to which numpy's sampler draws


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int, numpy_most: int = NUMPY_MOST) -> int:
    """How many of `drawn` out of good + bad are good, without replacement.

    Beyond what numpy draws, by rejection for log-concave distributions (Devroye 1987): proposals are level around the
    mode and fall off exponentially, in units of the mode's probability.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    if good + bad <= numpy_most:
        return int(rng.hypergeometric(good, bad, drawn))
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    # Factorials as differences from the mode, so that large ones cancel before they are rounded.
    choose = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    def ratio(k: int) -> float:
        """The log of P(k) / P(mode)."""
        if abs(k - mode) <= 64:
            step = 1 if k > mode else -1
            total = 0.0
            for x in range(min(k, mode), max(k, mode)):
                total += log(good - x) + log(drawn - x) - log(x + 1) - log(bad - drawn + x + 1)
            return step * total
        return choose(good, k) - choose(good, mode) + choose(bad, drawn - k) - choose(bad, drawn - mode)

    peak = np.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    wide = 1 + peak / 2
    while True:
        u, level = rng.random(), rng.random()
        y, tail = (rng.random() * wide / peak, 0.0) if u <= wide / (1 + wide) else ((wide + (e := rng.exponential())) / peak, e)
        k = mode + (1 if rng.random() < 0.5 else -1) * int(y + 0.5)
        if low <= k <= high and log(max(level, 5e-324)) - tail <= ratio(k):
            return k


def split(rng: np.random.Generator, sizes: np.ndarray, drawn: int, numpy_most: int = NUMPY_MOST) -> np.ndarray:
    """How many of `drawn` rows come from each of `sizes`: a multivariate hypergeometric draw."""
    total = int(sizes.sum())
    if total <= numpy_most:
        return rng.multivariate_hypergeometric(sizes, drawn, method="marginals")
    out = np.zeros_like(sizes)
    for k, size in enumerate(sizes.tolist()):
        out[k] = hypergeometric(rng, size, total - size, drawn, numpy_most)
        total, drawn = total - size, drawn - int(out[k])
    return out


def matrix_row(counts: np.ndarray, targets: np.ndarray, partition: int, seed: int, numpy_most: int = NUMPY_MOST) -> np.ndarray:
    """The rows that `partition` sends to each target; `counts` and `targets` have the same sum."""
    before = np.concatenate([[0], np.cumsum(counts)])
    low, high, share = 0, len(counts), targets.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, (low << 32) | high]))
        left = split(rng, share, int(before[middle] - before[low]), numpy_most)
        low, high, share = (low, middle, left) if partition < middle else (middle, high, share - left)
    return share


def lane_sizes(rows: int, shards: int, lanes: int) -> np.ndarray:
    """Exact sizes: of the shards (at most one apart), then of each shard's lanes."""
    own = lambda n, k: np.array([n // k + (i < n % k) for i in range(k)], np.int64)
    return np.concatenate([own(int(n), lanes) for n in own(rows, shards)])


def _lane_rows(counts, targets: np.ndarray, names: list[str], seed: int):
    """Adds the lane of each row: the partition's row of the matrix, dealt to its rows in a random order."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lanes = -1, np.zeros(0, np.int32)
        for batch in batches:
            at = np.asarray(batch.column(names[-1]))
            of, row = at >> POSITION_BITS, at & ((1 << POSITION_BITS) - 1)
            out = np.zeros(len(at), np.int32)
            for p in np.unique(of).tolist():
                if p != known:
                    dealt = np.repeat(np.arange(len(targets), dtype=np.int32), matrix_row(counts.value, targets, p, seed))
                    order = np.random.Generator(np.random.Philox(key=[seed + 1, p])).permutation(len(dealt))
                    known, lanes = p, dealt[order]
                out[of == p] = lanes[row[of == p]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, "_lane"])

    return rows


def uniform_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, lane_rows: int = LANE_ROWS) -> DataFrame:
    """`rows` with `shard` (0 to shards - 1) and `slot` (from 0, no gaps): a uniform shuffle, shard sizes at most one apart.

    Every row is one, also if it repeats another or is null throughout. The rows are stored once, with their places in
    the partitions they are read in, since these must not change if a task runs again; own columns `shard`, `slot`,
    `_at` or `_lane` are refused. Fewer rows than shards leave some empty; an empty table gives no rows.
    """
    taken = {"shard", "slot", "_at", "_lane"} & set(rows.columns)
    if taken:
        raise ValueError(f"columns that the result names itself: {sorted(taken)}")
    spark = rows.sparkSession
    ship(spark)
    if rows.rdd.getNumPartitions() > PARTITIONS:
        rows = rows.coalesce(PARTITIONS)
    stored = checkpointed(rows.withColumn("_at", F.monotonically_increasing_id()))
    block = F.shiftright("_at", POSITION_BITS).alias("p")
    sizes = {r["p"]: r["n"] for r in stored.groupBy(block).agg(F.count(F.lit(1)).alias("n")).toLocalIterator()}
    counts = np.zeros(max(sizes, default=-1) + 1, np.int64)
    for p, n in sizes.items():
        counts[p] = n
    total = int(counts.sum())
    lanes = max(-(-total // (shards * lane_rows)), -(-LANES_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    targets = lane_sizes(total, shards, lanes)
    fields = [*stored.schema.fields]
    schema = stored.select("*", F.lit(0).alias("_lane")).schema
    known = spark.sparkContext.broadcast(counts)
    dealt = stored.mapInArrow(_lane_rows(known, targets, [f.name for f in fields], seed), schema)
    order = Window.partitionBy("_lane").orderBy(F.xxhash64("_at", F.lit(seed)), "_at")
    # Where a lane begins in its shard follows from the sizes: shard s has q + (s < r) rows, lane i of it likewise.
    shard, lane = F.col("shard"), F.col("_lane") % lanes
    own = F.lit(total // shards) + (shard < total % shards).cast("long")
    begin = lane * F.floor(own / lanes) + F.least(lane, own % lanes)
    placed = dealt.withColumns({"shard": F.floor(F.col("_lane") / lanes).cast("int"), "slot": F.row_number().over(order).cast("long") - 1})
    return placed.withColumn("slot", (F.col("slot") + begin).cast("long")).drop("_at", "_lane")


def shard_report(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The shard of each row of `docs` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: counts are at most one apart and, each order being as likely, copies of a text are spread like
    any rows. A null text has no bytes, so its size is 1 and its checksum 0; further columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = uniform_shards(small, shards, seed)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
