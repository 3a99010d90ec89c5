"""Classifiers by held-out accuracy, language-model scores against SQL and plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import lm, quality, toxicity
from tests.llm.test_text import plain_words

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet"), spark.read.parquet(f"{TABLES}/labels.parquet")


def held_out(scores, labels, label):
    rows = scores.where("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    y = np.array([r[label] for r in rows])
    rank = np.argsort(np.argsort([r.score for r in rows]))
    ones = y.sum()
    auc = (rank[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))
    return auc, np.mean([r.predicted == r[label] for r in rows])


@pytest.mark.parametrize("score, label, remainder, least", [(quality.quality_scores, "quality", (5, 0), 0.97), (toxicity.toxicity_scores, "toxic", (4, 2), 0.95)])
def test_held_out_documents_are_told_apart(labelled, score, label, remainder, least):
    docs, labels = labelled
    scores = score(docs, labels).cache()
    auc, accuracy = held_out(scores, labels, label)
    assert auc > least and accuracy > 0.93
    assert scores.count() == docs.count() and scores.where("score < 0 or score > 1 or score is null").count() == 0
    assert scores.where(f"held_out <> (crc32(cast(doc_id as string)) % {remainder[0]} = {remainder[1]})").count() == 0
    assert scores.where("predicted <> cast(score >= 0.3 as int)").count() == 0
    # Labels of held-out rows change nothing.
    turned = labels.withColumn(label, F.when(F.expr(f"crc32(cast(doc_id as string)) % {remainder[0]} = {remainder[1]}"), 1 - F.col(label)).otherwise(F.col(label)))
    assert score(docs, turned).subtract(scores).count() == 0


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_odd_rows_and_labels(spark, odd, score):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in score(odd, none).collect()} == {0.5}
    strange = spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 0), (2, 0, 1), (5, 7, 7), (9, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    rows = score(odd, strange).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert score(odd.limit(0), strange).count() == 0


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_trained_models_score_odd_rows(labelled, odd, score):
    docs, labels = labelled
    rows = score(docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), labels).where("doc_id is null").collect()
    assert len(rows) == 2 and all(0 <= r.score <= 1 for r in rows)


def test_vectors_are_pooled_alike_in_any_piece(monkeypatch):
    import pyarrow as pa

    vectors = np.random.default_rng(0).normal(size=(quality.VOCABULARY, quality.WIDTH)).astype(np.float32)
    column = pa.array(["A b! 12 b b", None, "", "c" * 50 + " &&& d", "x y z " * 40])
    whole = quality.pooled(column, vectors)
    monkeypatch.setattr(quality, "TOKENS", 3)
    assert np.allclose(quality.pooled(column, vectors), whole, atol=1e-4)
    assert not whole[1].any()


def test_kneser_ney_probabilities_sum_to_one():
    words = [b"abc", b"abd", b"xbc", b"zzzz", b"abcabc"]
    models = toxicity.Models(words, np.array([3.0, 1, 0, 2, 1]), np.array([0.0, 2, 4, 0, 1]))

    def probabilities(level, spelt):
        """Of every symbol of some words of equal length, one row each."""
        data, ends = np.frombuffer(b"".join(spelt), np.uint8), np.arange(1, len(spelt) + 1) * len(spelt[0])
        word, by_order = toxicity.grams(data, ends - len(spelt[0]), ends)
        p = np.full(len(word), 1 / 257, np.float32)
        for n, (gram, context) in enumerate(by_order):
            p = models.shared[n].smoothed(gram, context, p) if n < len(models.shared) else level.smoothed(gram, context, p)
        return p.reshape(len(spelt), -1)

    for level in models.own:
        third = probabilities(level, [b"ab" + bytes([c]) for c in range(256)])[:, 2]
        ended = probabilities(level, [b"ab"])[0, -1]
        assert abs(third.sum() + ended - 1) < 1e-4


def plain_scores(texts):
    words = [plain_words(s) for s in texts]
    uni = Counter(w for ws in words for w in ws)
    total = sum(uni.values())
    own = [Counter(zip(ws, ws[1:])) for ws in words]
    pair = sum(own, Counter())
    out = []
    for ws, mine in zip(words, own):
        if not ws:
            out.append((0, None))
            continue
        x = math.log(uni[ws[0]] / total)
        for p, n in mine.items():
            x += n * (math.log(pair[p] / uni[p[0]]) if pair[p] > n else math.log(0.4 * uni[p[1]] / total))
        out.append((len(ws), x / len(ws)))
    return out


@pytest.mark.parametrize("bits, words", [(20, 21), (0, 21), (9, 10), (0, 4), (0, 0)])
def test_scores_are_those_of_plain_counts(spark, documents, odd, bits, words, monkeypatch):
    """With no frequent pairs (0 bits) every pair goes through its partition; with 10, 4 or 0 bits most or all words
    are rare, counted where their hash says, and pairs are of frequent, mixed and rare words."""
    monkeypatch.setattr(lm, "PAIRS_PER_GROUP", 20_000)
    docs = documents.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = docs.collect()
    want = sorted(((r.doc_id or -1, n, None if s is None else round(s, 8)) for r, (n, s) in zip(rows, plain_scores([r.text for r in rows]))), key=repr)
    got = sorted(((r.doc_id or -1, r.n_words, None if r.score is None else round(r.score, 8)) for r in lm.backoff_scores(docs, words, bits).collect()), key=repr)
    assert got == want


def test_scores_in_many_partitions(documents, monkeypatch):
    one = sorted(lm.backoff_scores(documents, frequent_bits=0).collect())
    monkeypatch.setattr(lm, "PAIRS_PER_GROUP", 5_000)
    many = sorted(lm.backoff_scores(documents, frequent_bits=0).collect())
    assert [(a.doc_id, a.n_words) for a in one] == [(a.doc_id, a.n_words) for a in many]
    assert all(abs(a.score - b.score) < 1e-9 for a, b in zip(one, many))
    assert lm.backoff_scores(documents.limit(0)).count() == 0


def test_rows_that_repeat_a_labelled_doc_id_are_one_example(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    some = documents.join(labels.where("quality is not null"), "doc_id", "left_semi").select("doc_id", "text").limit(1)
    repeated = documents.select("doc_id", "text").unionByName(some.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("k"))
    sizes, vectors = [], quality.word_vectors(documents)
    real = quality.fit
    try:
        quality.fit = lambda x, y, *rest: sizes.append(len(y)) or real(x, y, *rest)
        for docs in (documents.select("doc_id", "text"), repeated):
            quality.fitted(docs, labels, vectors)
    finally:
        quality.fit = real
    assert sizes[0] == sizes[1]
