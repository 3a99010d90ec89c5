"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing: every word owns a sparse ternary signature derived from its hash, and a word's vector is the sum of
its neighbours' signatures over the whole corpus. Words share a fixed number of hash buckets, so the table of vectors
has a fixed size whatever the corpus holds, and its counts are whole numbers, so their order of addition is of no
consequence. Beside its spelling each token has a shape (case, symbols, repeats), a word like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.text import as_bytes, mixed, pieces, run_hashes, runs, small_batches, with_columns

BUCKETS = 1 << 13  # spellings share so many vectors
SHAPES = 64
VOCABULARY = BUCKETS + SHAPES
WIDTH = 32  # of a vector
SIGNS = 4  # entries of a signature that are not 0
REACH = 2  # neighbours on either side
TOKENS = 1 << 17  # pooled at a time
LABELLED_PER_CLASS = 8_000  # labelled rows the network is fitted on, of each class at most; the bound of the fit
HIDDEN, EPOCHS, STEP_ROWS, RATE, DECAY = 32, 60, 256, 0.004, 1e-4
CUT_OFF = 0.3  # fixed by the contract: label 1 from this score on

_KIND = np.ones(256, np.uint8)  # words
_KIND[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = 0
for _low, _high in ((0x00, 0x09), (0x0E, 0x20), (0x21, 0x30), (0x3A, 0x41), (0x5B, 0x61), (0x7B, 0x80)):
    _KIND[_low:_high] = 2  # symbols
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def _signatures() -> tuple[np.ndarray, np.ndarray]:
    """For each word the places and the signs of its signature's entries."""
    draws = np.stack([mixed(np.arange(VOCABULARY, dtype=np.uint64), 100 + k) for k in range(SIGNS)], axis=1)
    return (draws % np.uint64(WIDTH)).astype(np.int64), np.where(draws >> np.uint64(63), 1, -1).astype(np.int64)


PLACES, SIGN = _signatures()


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spelling bucket and shape (as words of the vocabulary) of each token, and the first token of each text."""
    data, at = as_bytes(column)
    begin, end, first = runs(data, at, _KIND)
    if not len(begin):
        return begin, begin, first
    h = run_hashes(data, begin, end)
    length = end - begin
    upper = np.add.reduceat(_UPPER[data], begin, dtype=np.int64) if len(begin) else begin
    # reduceat runs on to the next token; gaps hold neither capitals nor digits
    digit = np.add.reduceat(_DIGIT[data], begin, dtype=np.int64) > 0
    symbol = _KIND[data[begin]] == 2
    case = np.where(upper == 0, 0, np.where((upper == length) & (length > 1), 2, 1))
    size = np.minimum(3, np.searchsorted([2, 4, 9], length, side="right"))
    again = np.zeros(len(h), np.int64)
    for back in (1, 2):
        again[back:] |= h[back:] == h[:-back]
    again[first[:-1][first[:-1] < len(h)]] = 0
    shape = np.where(symbol, 24 + size, case * 8 + size + 4 * digit) + 32 * again
    return (h % np.uint64(BUCKETS)).astype(np.int64), shape + BUCKETS, first


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbours' signatures of one task, as (place in the flat table, sum)."""
    table = np.zeros(VOCABULARY * WIDTH, np.int64)
    for whole in batches:
        for batch in pieces(whole, "text", 1 << 20):
            spelling, shape, first = tokens(batch.column("text"))
            text = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for lo in range(0, len(spelling), TOKENS):
                hi = min(lo + TOKENS, len(spelling))
                for back in range(1, REACH + 1):
                    a, b = max(lo, back), hi
                    left, right = slice(a - back, b - back), slice(a, b)
                    near = text[left] == text[right]
                    for near_words, own in (
                        (spelling[left], spelling[right]),
                        (spelling[right], spelling[left]),
                        (shape[left], shape[right]),
                        (shape[right], shape[left]),
                    ):
                        n, o = near_words[near], own[near] * WIDTH
                        for k in range(SIGNS):
                            s = SIGN[n, k] > 0
                            at = o + PLACES[n, k]
                            table += np.bincount(at[s], minlength=len(table)) - np.bincount(at[~s], minlength=len(table))
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(table[at])], ["at", "n"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all words, learnt from every text of `docs`: VOCABULARY x WIDTH, at most a few MB.

    What comes to the driver has that fixed size; tasks send their own sums, added up before and after the shuffle.
    """
    small_batches(docs.sparkSession)
    sums = docs.select("text").mapInArrow(_context_rows, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(VOCABULARY * WIDTH)
    flat[np.asarray(sums.column("at"))] = np.asarray(sums.column("n"))
    context = flat.reshape(VOCABULARY, WIDTH)
    context -= context.mean(axis=0) * (context.std() > 0)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    own = np.zeros_like(context)
    np.add.at(own, (np.arange(VOCABULARY)[:, None], PLACES), SIGN / np.sqrt(SIGNS))
    return (context + own).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row of features per text: mean spelling vector, mean shape vector, share of each shape, length."""
    spelling, shape, first = tokens(column)
    n = len(first) - 1
    out = np.zeros((n, 2 * WIDTH + SHAPES + 1), np.float32)
    text = np.repeat(np.arange(n), np.diff(first))
    for lo in range(0, len(spelling), TOKENS):
        own = text[lo : lo + TOKENS]
        heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for base, words in ((0, spelling), (WIDTH, shape)):
            out[own[heads], base : base + WIDTH] += np.add.reduceat(vectors[words[lo : lo + TOKENS]], heads, axis=0)
    if n:
        out[:, 2 * WIDTH : -1] = np.bincount(text * SHAPES + shape - BUCKETS, minlength=n * SHAPES).reshape(n, SHAPES)
    count = np.diff(first)[:, None]
    out /= np.maximum(count, 1)
    out[:, -1] = np.log1p(count[:, 0]) / 10
    return out


@dataclass
class Network:
    """Two layers of weights; `temperature` divides the last layer's output before the sigmoid."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x).astype(np.float64) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, calibration: np.ndarray) -> Network:
    """Adam on the rows outside `calibration`, which sets the temperature by its log loss."""
    rng = np.random.default_rng(0)
    rows = np.flatnonzero(~calibration)
    mean, scale = x[rows].mean(axis=0), x[rows].std(axis=0) + 1e-3
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    p = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    z = (x - mean) / scale
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + RATE / 50
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // STEP_ROWS)):
            h = np.tanh(z[part] @ p[0] + p[1])
            out = h @ p[2] + p[3][0]
            g = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[part]) * weight[part] / weight[part].sum()
            gh = np.outer(g, p[2]) * (1 - h * h)
            t += 1
            for q, d, mm, vv in zip(p, (z[part].T @ gh + DECAY * p[0], gh.sum(axis=0), h.T @ g + DECAY * p[2], np.array([g.sum()])), m, v):
                mm += 0.1 * (d - mm)
                vv += 0.001 * (d * d - vv)
                q -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    net.b2 = float(p[3][0])
    held = np.flatnonzero(calibration)
    if len(held) and len(np.unique(y[held])) == 2:
        raw = net.raw(x[held])
        tries = np.exp(np.linspace(np.log(0.25), np.log(8), 81))
        loss = [np.average(np.logaddexp(0, np.where(y[held] == 1, -raw, raw) / s), weights=weight[held]) for s in tries]
        net.temperature = float(tries[int(np.argmin(loss))])
    return net


def training_rows(labels: DataFrame, label: str, allowed: str, per_class: int = LABELLED_PER_CLASS) -> tuple[DataFrame, list[int]]:
    """(doc_id, y) of a bounded sample of labelled rows, the first by hash of each class, and the sizes of the classes.

    `allowed` says in SQL which `doc_id` may be learnt from. Rows without a label or doc_id are left out, and so are
    documents with contradictory labels; repeated rows count once.
    """
    clean = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .where(allowed)
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("_high"))
        .where("y = _high")
    )
    found = {r["y"]: r["n"] for r in clean.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = [clean.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", "y") for c in (0, 1)]
    return parts[0].unionAll(parts[1]), [found.get(0, 0), found.get(1, 0)]


def fitted(docs: DataFrame, labels: DataFrame, vectors: np.ndarray) -> Network | float:
    """The network, or the smoothed share of label 1 where one class has no labelled document."""
    sample, sizes = training_rows(labels, "quality", "crc32(cast(doc_id as string)) % 5 <> 0")
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                x = pooled(batch.column("text"), held.value)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), rows], ["doc_id", "y", "x"])

    # At most 2 x LABELLED_PER_CLASS rows of two numbers: a proven bound. So is that of the chosen documents, since of rows
    # that repeat a doc_id one is taken, the one of the least text.
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    chosen = chosen.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    table = chosen.mapInArrow(features, "doc_id long, y int, x array<float>").toArrow().sort_by("doc_id")
    y = np.asarray(table.column("y"), np.float64)
    if len(np.unique(y)) < 2:
        return (sizes[1] + 1) / (sum(sizes) + 2)
    x = np.asarray(table.column("x").combine_chunks().flatten(), np.float64).reshape(len(y), -1)
    ids = np.asarray(table.column("doc_id")).astype(np.uint64)
    share = np.array(sizes) / np.maximum(np.bincount(y.astype(int), minlength=2), 1)
    return fit(x, y, share[y.astype(int)], mixed(ids, 5) % np.uint64(5) == 0)


def with_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with the column `_score` (0 to 1, higher: label 1 likelier); other columns pass through.

    The network is fitted on a bounded sample of `labels` (LABELLED_PER_CLASS) whose rows are not held out; the word
    vectors come from every text. Null text is empty, and an empty text is scored by its (empty) features. Without
    labelled rows of both classes every score is the smoothed share of label 1.
    """
    small_batches(docs.sparkSession)
    vectors = word_vectors(docs)
    model = docs.sparkSession.sparkContext.broadcast((vectors, fitted(docs, labels, vectors)))

    def compute():
        vectors, net = model.value

        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            if isinstance(net, float):
                return [pa.array(np.full(batch.num_rows, net))]
            return [pa.array(net.probability(pooled(batch.column("text"), vectors)))]

        return columns

    return with_columns(docs, [("_score", "double")], compute)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score and predicted. A null doc_id is not held out."""
    return with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels).select(
        "doc_id",
        F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 = 0"), F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= CUT_OFF).cast("int").alias("predicted"),
    )
