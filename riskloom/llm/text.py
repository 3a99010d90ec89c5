"""Shared text kernels: Arrow columns as bytes, runs of bytes as tokens, 64-bit token and shingle hashes.

Everything works on the UTF-8 bytes of a whole Arrow batch with numpy. Texts are never cut:
long ones are only hashed piece by piece, so scratch memory stays at a few dozen MB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from riskloom.session import ship

PIECE = 1 << 18  # bytes hashed at a time
ROWS_PER_BATCH = 512  # documents in one Arrow batch, so that a batch of long texts fits a worker


def small_batches(spark: SparkSession) -> None:
    """Readies a session for Python functions over wide rows: Arrow batches of at most ROWS_PER_BATCH, code at the workers."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ROWS_PER_BATCH:
        spark.conf.set(key, str(ROWS_PER_BATCH))


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, one after the other, and where each begins (one more entry than rows). Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    return _mix(x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64))


_BASE = 0x5851F42D4C957F2D  # odd, so that it has an inverse modulo 2**64
_BYTE_VALUE = mixed(np.arange(256, dtype=np.uint64), 7)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 2 * PIECE)
        steps = np.full(size, base % 2**64, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * PIECE:
            _powers[base] = have
    return have


def runs(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one kind inside each text: begin, end, and the first run of each text.

    `kind` maps a byte to its kind; runs of kind 0 are gaps.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    k = kind[data]
    new = np.empty(len(data), bool)
    new[0] = True
    np.not_equal(k[1:], k[:-1], out=new[1:])
    new[at[:-1][at[:-1] < len(data)]] = True
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(data))
    real = k[begin] != 0
    begin, end = begin[real], end[real]
    return begin, end, np.searchsorted(begin, at)


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run; equal bytes have equal hashes wherever they stand."""
    out = np.empty(len(begin), np.uint64)
    inverse = pow(_BASE, -1, 2**64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + PIECE, side="right")))
        lo, hi = int(begin[i]), int(end[j - 1])
        total = np.empty(hi - lo + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE_VALUE[data[lo:hi]] * _power(_BASE, hi - lo)[: hi - lo], out=total[1:])
        b, e = begin[i:j] - lo, end[i:j] - lo
        out[i:j] = (total[e] - total[b]) * _power(inverse, hi - lo)[b] + (e - b).astype(np.uint64)
        i = j
    return _mix(out)


# Fixed: lower-case A-Z, then words are maximal runs outside \x00-\x2F, \x3A-\x60 and \x7B-\x7F.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
WORD = np.ones(256, np.uint8)
WORD[0x00:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = 0


class Words:
    """The words of a column: `hash`, byte span (`begin`, `end` in `data`) and `first` word of each text."""

    def __init__(self, column: pa.Array):
        raw, at = as_bytes(column)
        self.data = LOWER[raw]
        self.begin, self.end, self.first = runs(self.data, at, WORD)
        self.hash = run_hashes(self.data, self.begin, self.end)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the `size` consecutive words of one text; a text of fewer words, but not none, is one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for j in range(width):
        total += hashes[j : n - width + 1 + j] * np.uint64((0xD6E8FEB86659FD93 * (2 * j + 1)) % 2**64 | 1)
        total = (total << np.uint64(13)) | (total >> np.uint64(51))
    return _mix(total)


def pieces(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of `column`, or of one row where that is longer."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    upto, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def with_columns(docs: DataFrame, fields: list[tuple[str, str]], compute: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], most: int = 1 << 20) -> DataFrame:
    """`docs` with further columns that `compute` derives from its text; all other columns pass through unmoved.

    `fields` are (name, type); `compute` is called once in each task and returns what turns a batch into the columns. As
    with `withColumn`, a new column replaces an old one of its name.
    """
    new = {name for name, _ in fields}
    passed = [c for c in docs.columns if c not in new]
    wanted = T.StructType([*(docs.schema[c] for c in passed), *(T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields)])
    arrow = to_arrow_schema(wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = compute()
        for whole in batches:
            for batch in pieces(whole, "text", most):
                columns = [*(batch.column(c) for c in passed), *own(batch)]
                yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    return docs.mapInArrow(rows, wanted)
