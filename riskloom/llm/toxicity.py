"""Toxicity by class-conditional Kneser-Ney models of words' letters.

Two models, one of toxic and one of ordinary documents, give every word a log-likelihood from the bytes of its
spelling. Each has counts of its own for the longest contexts; below, both back off to the same continuation counts, so
a spelling that either class has hardly seen tells little, and one that shares its beginning with known expressions
tells much. A document is judged by its length-normalised log-likelihood ratio and by its most telling words; a
logistic layer, fitted on labelled documents the models have not seen, turns that into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.quality import training_rows
from riskloom.llm.text import Words, mixed, pieces, small_batches, with_columns

ORDER = 6  # bytes of a gram, the last of them predicted
LABELLED_PER_CLASS = 3_000  # labelled documents the models and the layer are fitted on, of each class at most
CUT_OFF = 0.3  # fixed by the contract: label 1 from this score on
WORDS_KEPT = 400_000  # words whose ratio a task remembers
BEGIN, END = 256, 257  # marks around a word


class Table:
    """Numbers by 64-bit key: sorted keys and the place where those of each leading bit pattern begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.bits = max(1, int(np.ceil(np.log2(len(keys) + 1))))
        heads = np.arange((1 << self.bits) + 1, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.start = np.searchsorted(self.keys, heads[:-1]).astype(np.int64)
        self.start = np.append(self.start, len(keys))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; 0 where there is none."""
        out = np.zeros(len(keys), np.float32)
        if not len(self.keys):
            return out
        head = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.start[head], self.start[head + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            place = at[open_]
            same = self.keys[place] == keys[open_]
            out[open_[same]] = self.values[place[same]]
            at[open_] += 1
            open_ = open_[~same & (at[open_] < end[open_])]
        return out


def grams(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """For every byte of each word and its end mark the word's number and, order by order, the keys of the gram of so
    many symbols that ends there and of its context.

    Where a word has fewer symbols before, the gram is its whole beginning with the mark.
    """
    length = end - begin
    size = length + 2
    first = np.cumsum(size) - size
    symbols = np.empty(int(size.sum()), np.uint64)
    symbols[first] = BEGIN
    symbols[first + length + 1] = END
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    symbols[np.repeat(first, length) + 1 + inner] = data[np.repeat(begin, length) + inner]
    values = mixed(symbols, 3)
    word = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(symbols)) - first[word]
    predicted = np.flatnonzero(nth > 0)

    def by_order() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, context = np.full(len(predicted), 1, np.uint64), np.full(len(predicted), 1, np.uint64)
        for back in range(ORDER):
            inside = nth[predicted] >= back
            symbol = values[np.maximum(predicted - back, 0)]
            # Symbols are folded in from the predicted one backwards, so that a longer gram extends a shorter one.
            key = np.where(inside, mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ symbol, 4), key)
            if back:
                context = np.where(inside, mixed(context * np.uint64(0x9E3779B97F4A7C15) ^ symbol, 5), context)
            yield key, context

    return word[predicted], by_order()


@dataclass
class Level:
    """Counts of grams and, by context, their sum and the number of different grams."""

    gram: Table
    total: Table
    kinds: Table
    discount: float

    def smoothed(self, gram: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
        total = self.total.find(context)
        known = total > 0
        top = np.maximum(self.gram.find(gram) - self.discount, 0) + self.discount * self.kinds.find(context) * lower
        return np.where(known, top / np.where(known, total, 1), lower)


def _level(gram: np.ndarray, context: np.ndarray, count: np.ndarray) -> Level:
    """From the keys of distinct grams, their contexts and counts."""
    one, two = np.count_nonzero(count == 1), np.count_nonzero(count == 2)
    heads, which = np.unique(context, return_inverse=True)
    total, kinds = np.bincount(which, weights=count, minlength=len(heads)), np.bincount(which, minlength=len(heads))
    return Level(Table(gram, count), Table(heads, total), Table(heads, kinds), min(0.95, max(0.1, one / max(1, one + 2 * two))))


class Models:
    """Both classes' models, from distinct words and the number of documents of each class that have them."""

    def __init__(self, words: list[bytes], ordinary: np.ndarray, toxic: np.ndarray):
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(lengths)
        word, by_order = grams(data, end - lengths, end)
        self.shared: list[Level] = []
        before = None
        for gram, context in by_order:
            distinct, first, which = np.unique(gram, return_index=True, return_inverse=True)
            if before is not None:
                # Continuation count: how many different grams of one symbol more end in this one.
                keys, at, count = np.unique(before[0][first], return_index=True, return_counts=True)
                self.shared.append(_level(keys, before[1][first][at], count))
            before = gram, context
        self.own = []
        for weight in (ordinary, toxic):
            count = np.bincount(which, weights=weight[word], minlength=len(distinct))
            have = count > 0
            self.own.append(_level(distinct[have], context[first][have], count[have]))

    def ratios(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word as toxic less that as ordinary."""
        word, by_order = grams(data, begin, end)
        p = np.full(len(word), 1 / 257, np.float32)
        for n, (gram, context) in enumerate(by_order):
            if n < len(self.shared):
                p = self.shared[n].smoothed(gram, context, p)
        ordinary, toxic = (level.smoothed(gram, context, p) for level in self.own)
        return np.bincount(word, weights=np.log(toxic / ordinary), minlength=len(begin))


class Scorer:
    """Models, the logistic layer, and the ratios of words met before."""

    def __init__(self, models: Models):
        self.models = models
        self.known: dict[int, float] = {}

    def ratio(self, words: Words) -> np.ndarray:
        distinct, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        found = [self.known.get(k) for k in keys]
        new = np.array([i for i, v in enumerate(found) if v is None], np.int64)
        if len(new):
            if len(self.known) > WORDS_KEPT:
                self.known.clear()
            for i, v in zip(new.tolist(), self.models.ratios(words.data, words.begin[at[new]], words.end[at[new]]).tolist()):
                found[i] = self.known[keys[i]] = v
        return np.array(found, np.float64)[which] if keys else np.zeros(0)

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text: mean ratio, the greatest, the mean of the three greatest, share of telling words, length."""
        words = Words(column)
        ratio = self.ratio(words)
        n = len(words.first) - 1
        out = np.zeros((n, 6))
        count = np.diff(words.first)
        text = np.repeat(np.arange(n), count)
        out[:, 0] = np.bincount(text, weights=ratio, minlength=n) / np.maximum(count, 1)
        out[:, 3] = np.bincount(text[ratio > 3], minlength=n)
        out[:, 4] = out[:, 3] / np.maximum(count, 1)
        out[:, 3] = np.log1p(out[:, 3])
        out[:, 5] = np.log1p(count)
        for i in range(n):
            own = ratio[words.first[i] : words.first[i + 1]]
            if len(own):
                top = np.partition(own, -min(3, len(own)))[-3:]
                out[i, 1], out[i, 2] = top.max(), top.mean()
        return out


@dataclass
class Layer:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.w + self.b, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> Layer:
    """Newton's steps on the weighted log loss with a small penalty."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (weight * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Layer(mean, scale, w[:-1], float(w[-1]))


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of each document, with the document's class."""
    for whole in batches:
        for batch in pieces(whole, "text", 1 << 20):
            words = Words(batch.column("text"))
            raw, out, y = words.data.tobytes(), [], []
            for i, label in enumerate(batch.column("y").to_pylist()):
                own = slice(int(words.first[i]), int(words.first[i + 1]))
                distinct = {raw[b:e] for b, e in zip(words.begin[own].tolist(), words.end[own].tolist())}
                out += distinct
                y += [label] * len(distinct)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(y, pa.int32())], ["word", "y"])


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Models, Layer] | float:
    """Models and layer, or the smoothed share of label 1 where one class has too few labelled documents.

    Of the bounded sample two thirds, by a hash, count for the models; the layer learns from the others.
    """
    sample, sizes = training_rows(labels, "toxic", "crc32(cast(doc_id as string)) % 4 <> 2", LABELLED_PER_CLASS)
    share = (sizes[1] + 1) / (sum(sizes) + 2)
    # At most 2 x LABELLED_PER_CLASS rows of two numbers: a proven bound. So is that of the chosen documents, since of rows
    # that repeat a doc_id one is taken, the one of the least text.
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    chosen = chosen.groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    third = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3))
    counted = chosen.where(third != 0).select("text", "y").mapInArrow(_word_rows, "word binary, y int")
    table = counted.groupBy("word").agg(F.count(F.when(F.col("y") == 0, 1)).alias("ordinary"), F.count(F.when(F.col("y") == 1, 1)).alias("toxic")).toArrow().sort_by("word")
    ordinary, toxic = (np.asarray(table.column(c), np.float64) for c in ("ordinary", "toxic"))
    if not ordinary.sum() or not toxic.sum():
        return share
    models = Models(table.column("word").to_pylist(), ordinary, toxic)
    held = docs.sparkSession.sparkContext.broadcast(models)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                x = scorer.features(batch.column("text"))
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), rows], ["doc_id", "y", "x"])

    rest = chosen.where(third == 0).mapInArrow(features, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    y = np.asarray(rest.column("y"), np.float64)
    if len(np.unique(y)) < 2:
        return share
    x = np.asarray(rest.column("x").combine_chunks().flatten()).reshape(len(y), -1)
    weight = (np.array(sizes) / np.bincount(y.astype(int), minlength=2) / sum(sizes) * len(y))[y.astype(int)]
    return models, logistic(x, y, weight)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score (0 to 1) and predicted.

    Models are fitted on a bounded sample of `labels` (LABELLED_PER_CLASS) whose rows are not held out. Null text is
    empty; a text without words is scored by its (empty) features. Without labelled documents of both classes every
    score is the smoothed share of label 1. A null doc_id is not held out; repeated rows have a row each.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def compute():
        got = model.value
        scorer = None if isinstance(got, float) else Scorer(got[0])

        def columns(batch: pa.RecordBatch) -> list[pa.Array]:
            if scorer is None:
                return [pa.array(np.full(batch.num_rows, got))]
            return [pa.array(got[1].probability(scorer.features(batch.column("text"))))]

        return columns

    rows = with_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), [("_score", "double")], compute)
    return rows.select(
        "doc_id",
        F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= CUT_OFF).cast("int").alias("predicted"),
    )
