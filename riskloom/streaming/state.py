"""Per-card activity as streaming state: the trailing window of a live stream.

Arrival time is a column, so a replay gives the same answer, and an event is
measured against what arrived before it, also when it comes late. The state of a
card is its newest events, at most `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.operators.velocity import FEATURES, MICROS, VelocityWindows, nest, without_velocity

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# The kept events in order of arrival, one array per column: at most `keep` of them.
STATE_SCHEMA = "us array<bigint>, sequence array<bigint>, id array<string>, cents array<bigint>, place array<string>"
ROWS_OUT = 10_000  # rows handed back at a time
FLAT = [f"velocity_{name}" for name in FEATURES]
MEASURED = ("transaction_id", "Amount", "country", "arrival_us", "sequence")
# Instants keep their microseconds in JSON.
IN_FULL = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def windows_of(events: dict[str, list], new: list[int], windows: VelocityWindows) -> list[list]:
    """Columns of features of the events at the places `new`, each from the events up to it.

    `events` has the columns us, sequence, id, cents and place, sorted by the first three. Of deliveries of the same
    event only the last one up to a row counts for it.
    """
    us, cents, places = np.array(events["us"], np.int64), np.array(events["cents"], np.int64), events["place"]
    at, n = np.array(new, np.int64), len(us)
    identity = list(zip(events["id"], events["cents"], places))
    ahead = lambda seconds, side: np.searchsorted(us, us[at] - int(seconds * MICROS), side)
    oldest = ahead(windows.long, "right")
    if len(set(identity)) == n:
        first = np.maximum(oldest, at - windows.keep + 1)
        summed = np.concatenate([[0], np.cumsum(cents)])
        different = np.zeros(len(at), np.int64)
        named = np.array(places, object)
        for name in {p for p in places if p}:  # a card's countries: few
            different += np.maximum.accumulate(np.where(named == name, np.arange(n), -1))[at] >= first
        gap = np.where(at > first, us[at] - us[np.maximum(at - 1, 0)], -1)
        counts = [at - np.maximum(first, ahead(w, "left")) + 1 for w in (windows.short, windows.middle)]
        counts += [at - first + 1]
        amount = summed[at + 1] - summed[first]
    else:
        # Some event came again: each row looks at its own window, of `keep` events and their repeats.
        rows = []
        for i, low in zip(new, oldest.tolist()):
            own: dict[tuple, int] = {}
            for k in range(i, low - 1, -1):
                own.setdefault(identity[k], k)
                if len(own) == windows.keep:
                    break
            kept = list(own.values())
            since = [int(np.count_nonzero(us[kept] >= us[i] - int(w * MICROS))) for w in (windows.short, windows.middle)]
            rows.append((*since, len(kept), int(cents[kept].sum()), len({places[k] for k in kept if places[k]}), us[i] - us[kept[1]] if len(kept) > 1 else -1))
        *counts, amount, different, gap = (np.array(c) for c in zip(*rows))
    # Milliseconds rounded half up on whole microseconds, as the batch operator does.
    seconds = np.where(gap >= 0, (gap + 500) // 1000 / 1000, np.nan)
    return [*counts, amount / 100, different, seconds]


class CardActivity:
    """Measures each event of a card against what is kept and what came with it, then keeps the newest.

    Spark hands over a card's share of a micro-batch in pieces, in no order. They are put together first: an event may
    have come before one of an earlier piece. So a task holds one card's share of one micro-batch, which the trigger
    bounds.
    """

    def __init__(self, windows: VelocityWindows, columns: list[str], late_us: int | None = None):
        self.windows = windows
        self.columns = columns
        self.late_us = late_us

    def __call__(self, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pieces = list(rows)
        batch = pieces[0] if len(pieces) == 1 else pd.concat(pieces, ignore_index=True)
        cents = np.floor(batch["Amount"].to_numpy("float64") * 100 + 0.5).astype("int64")
        place = [p if isinstance(p, str) else "" for p in batch["country"]]
        own = zip(batch["arrival_us"].tolist(), batch["sequence"].tolist(), batch["transaction_id"], cents.tolist(), place, range(len(batch)))
        kept = [(*event, -1) for event in zip(*(list(column) for column in state.get))] if state.exists else []
        events = sorted([*kept, *own], key=lambda e: e[:3])
        new = [k for k, e in enumerate(events) if e[5] >= 0]
        measured = windows_of(dict(zip(("us", "sequence", "id", "cents", "place"), map(list, zip(*events)))), new, self.windows)
        order = np.array([events[k][5] for k in new], np.int64)
        given = {c: batch[c].to_numpy() for c in self.columns}
        for first in range(0, len(order), ROWS_OUT):
            part = slice(first, first + ROWS_OUT)
            features = dict(zip(FLAT, (column[part] for column in measured)))
            yield pd.DataFrame({**{c: values[order[part]] for c, values in given.items()}, **features})
        latest = {e[2:5]: e[:5] for e in events}  # of deliveries of the same event the last one
        newest = sorted(latest.values(), key=lambda e: e[:3])[-self.windows.keep :]
        state.update(tuple(map(list, zip(*newest))))
        if self.late_us is not None:
            idle = (newest[-1][0] + self.late_us) // 1000 + int(self.windows.long * 1000)
            state.setTimeoutTimestamp(max(idle, state.getCurrentWatermarkMs() + 1))


def live_velocity(
    events: DataFrame, windows: VelocityWindows = VelocityWindows(), late_seconds: float | None = None
) -> DataFrame:
    """Adds `velocity` to a stream of checked transactions.

    One shuffle by card. Rows without a card bypass the state, where they would
    all share one key. By default a card's few newest events are kept for good (on
    disk, in RocksDB), and no row is ever too late. With `late_seconds` a card
    expires, by event time, once it has been idle for the longest window and that
    long besides: nothing it held could still count. Spark then drops rows that come
    later still (its progress reports how many), so `late_seconds` has to exceed any
    delay between a message's time and its reading, an outage included.

    A call of Python per card costs by its columns, so a row travels through it as
    one text, beside the few columns that are measured.
    """
    columns = events.columns
    output = T.StructType(
        [
            T.StructField("_row", T.StringType()),
            *(T.StructField(n, T.IntegerType()) for n in FLAT[:3]),
            T.StructField(FLAT[3], T.DoubleType()),
            T.StructField(FLAT[4], T.IntegerType()),
            T.StructField(FLAT[5], T.DoubleType()),
        ]
    )
    carded, late_us, timeout = events.where(F.col("card_id").isNotNull()), None, GroupStateTimeout.NoTimeout
    if late_seconds is not None:
        late_us, timeout = int(late_seconds * MICROS), GroupStateTimeout.EventTimeTimeout
        carded = carded.withColumn("_arrived", F.timestamp_micros("arrival_us")).withWatermark("_arrived", f"{late_seconds} seconds")
    packed = F.to_json(F.struct(*columns), IN_FULL).alias("_row")
    measured = carded.select("card_id", *MEASURED, packed, *(c for c in carded.columns if c == "_arrived")).groupBy("card_id").applyInPandasWithState(
        CardActivity(windows, ["_row"], late_us), output, STATE_SCHEMA, "append", timeout
    )
    whole = T.StructType([T.StructField(f.name, f.dataType) for f in events.schema.fields])
    unpacked = measured.select(F.inline(F.array(F.from_json("_row", whole, {"mode": "FAILFAST", **IN_FULL}))), *FLAT)
    return nest(unpacked).unionByName(without_velocity(events.where(F.col("card_id").isNull())))
