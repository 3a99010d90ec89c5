"""Splits that lose no row, inputs learnt inside folds, copies counted once, full forests."""

import inspect
import math
import re

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from riskloom.operators import evaluation, forest, models, prep
from riskloom.operators.ranking import hot_keys
from riskloom.plans import learning


@pytest.fixture(scope="module")
def rows(spark):
    shifted = F.when(F.col("y") == 1, 3.0).otherwise(0.0)
    base = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    return base.select("*", (F.rand(3) + shifted).alias("a"), F.rand(4).alias("b"), (F.rand(5) * 90 + 10).alias("Amount")).cache()


@pytest.mark.parametrize("bad", [None, 2])
def test_rows_without_a_class_are_refused_not_dropped(spark, rows, bad):
    odd = rows.select("row_id", "y").unionByName(spark.createDataFrame([(-1, bad)], "row_id long, y int"))
    for split in (prep.folds, prep.holdout):
        with pytest.raises(ValueError, match="1 rows have a label"):
            split(odd, "y", "row_id")
    assert prep.folds(rows, "y", "row_id").where("fold is not null").count() == 600


def test_equal_rows_with_other_ids_count_once(rows):
    copied = rows.unionByName(rows.where("row_id < 50").withColumn("row_id", F.col("row_id") + 10_000))
    inputs = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features")])
    _, facts = models.train(copied, "y", "row_id", "Amount", inputs, capacity=0.9, k=2, max_trees=3, resamples=5)
    assert (facts["raw_rows"], facts["duplicates_removed"], facts["train_rows"] + facts["test_rows"]) == (650, 50, 600)


def test_inputs_are_learnt_from_the_rows_they_are_fitted_on(spark):
    own = [f"V{i}" for i in range(1, 29)]
    wide = spark.range(400).select(F.col("id").cast("double").alias("Amount"), F.lit(3600.0).alias("Time"), *(F.lit(float(i)).alias(c) for i, c in enumerate(own)))
    low, high = wide.where("Amount < 200"), wide.where("Amount >= 200")
    learnt = [Pipeline(stages=[prep.ModelInputs(own)]).fit(part).transform(wide.limit(1)).first()["features"][0] for part in (low, high)]
    known = [prep.preprocessing(prep.fit_scaling(part), own).fit(part).transform(wide.limit(1)).first()["features"][0] for part in (low, high)]
    assert learnt == known and learnt[0] != learnt[1]


def plain_precision(scored):
    """Average precision over distinct scores, from (score, label)."""
    hits = flagged = 0
    total, out = sum(y for _, y in scored), 0.0
    for score in sorted({s for s, _ in scored}, reverse=True):
        own = [y for s, y in scored if s == score]
        hits, flagged = hits + sum(own), flagged + len(own)
        out += sum(own) * hits / flagged
    return out / total


@pytest.fixture(scope="module")
def noisy(spark):
    """Two shifted columns under noise, so that many small trees are worth something."""
    shift = lambda by: F.when(F.col("y") == 1, by).otherwise(0.0)
    base = spark.range(1500).select(F.col("id").alias("row_id"), (F.col("id") % 6 == 0).cast("int").alias("y"))
    return base.select("*", *((F.randn(i) + shift(0.9)).alias(c) for i, c in enumerate("abcdef"))).repartition(3, "row_id").cache()


@pytest.fixture
def letters(spark):
    return Pipeline(stages=[VectorAssembler(inputCols=list("abcdef"), outputCol="features")])


def test_the_stopping_curve_is_the_average_precision_of_each_prefix(noisy, letters):
    model = models.fit_boosted(noisy, "y", "row_id", letters, max_trees=12, patience=12)
    rows = model.stages[0].transform(noisy)
    trees = model.stages[-1]
    curve = {r.trees: r.pr_auc for r in models.boosting_curve(trees, rows, "y").collect()}
    assert sorted(curve) == list(range(1, trees.getNumTrees + 1))
    margins = [0.0] * 1500
    each = trees.setLeafCol("leaf").transform(rows).select("y", "features", "leaf").collect()
    for k, (tree, weight) in enumerate(zip(trees.trees, trees.treeWeights), 1):
        margins = [m + weight * tree.predict(r.features) for m, r in zip(margins, each)]
        steps = [min(int(4096 / (1 + math.exp(-2 * m))), 4095) for m in margins]
        assert curve[k] == pytest.approx(plain_precision([(s, r.y) for s, r in zip(steps, each)]))


def test_the_best_number_of_trees_is_kept(noisy, letters):
    """The best prefix of the long run is what is kept; it is more than a handful, and it is the same trees."""
    kept = models.fit_boosted(noisy, "y", "row_id", letters, max_trees=60, patience=20).stages[-1]
    rows = noisy.select("row_id", "y", *"abcdef")
    long = models.fit_boosted(noisy, "y", "row_id", letters, max_trees=60, patience=60).stages[-1]
    assert kept.getNumTrees > 5
    same = min(kept.getNumTrees, long.getNumTrees)
    assert [t.toDebugString.split("\n", 1)[1] for t in kept.trees[:same]] == [t.toDebugString.split("\n", 1)[1] for t in long.trees[:same]]
    cut = models.first_trees(long, 2)
    probability = lambda m: [r.risk for r in models.fraud_probability(PipelineModel(stages=[letters.getStages()[0], m]), rows).orderBy("row_id").collect()]
    assembled = letters.getStages()[0].transform(rows).orderBy("row_id").select("features").collect()
    margin = [sum(w * t.predict(r.features) for t, w in zip(long.trees[:2], long.treeWeights[:2])) for r in assembled]
    assert probability(cut) == pytest.approx([1 / (1 + math.exp(-2 * m)) for m in margin])
    curve = noisy.sparkSession.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7), (4, None), (5, 0.6)], "trees int, pr_auc double")
    assert models.best_prefix(curve) == 2


@pytest.mark.parametrize("size", [100, 3000, 60_000])
def test_each_tree_has_a_full_sample_whatever_the_size(spark, size):
    df = spark.range(size).select("id", F.array(F.col("id").cast("double")).alias("x"))
    drawn = forest.samples(df, "id", F.col("x"), 40, 64, 1).groupBy("tree").agg(F.count("x").alias("n"), F.count_distinct("x").alias("d")).collect()
    assert len(drawn) == 40 and all(r.n == r.d <= 64 for r in drawn)
    assert sum(r.n for r in drawn) > 0.97 * 40 * 64
    assert hot_keys(df, "id", 1).count() == 0


@pytest.mark.parametrize("name", ["gbt_scores", "gain_importance", "out_of_fold", "metrics_by_source", "train_metadata"])
def test_queries_train_with_all_folds_and_resamples(spark, monkeypatch, name):
    used = []

    def recorded(f):
        def call(*args, **kwargs):
            bound = inspect.signature(f).bind(*args, **kwargs)
            bound.apply_defaults()
            used.append({k: v for k, v in bound.arguments.items() if k in ("max_trees", "k", "resamples")})
            if f.__name__ != "fit_boosted":
                raise StopIteration

        return call

    for f in (models.fit_boosted, models.out_of_fold, models.train):
        monkeypatch.setattr(models, f.__name__, recorded(f))
    for other in ("fraud_probability", "importance"):
        monkeypatch.setattr(models, other, lambda *_: None)
    with pytest.raises((StopIteration, AttributeError)):
        getattr(learning, name)(spark, "/root/testdata/sf0.001")
    wanted = {"max_trees": learning.TREES, "k": 5, "resamples": 1000}
    assert used and all(wanted[k] == v for u in used for k, v in u.items())


def test_train_metadata_grows_until_the_patience_runs_out(spark, monkeypatch):
    """All six fits go on while the score rises and keep the best of all trees; no smaller number of trees ends them."""
    number = F.col("doc_id").cast("double")
    rows = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") % 4 != 0).cast("int").alias("label"))
    rows = rows.select("*", *((number * (k + 3) % 17).alias(c) for k, c in enumerate(learning.TEXT_FEATURES)))
    asked, kept, fit, cut = [], [], models.GBTClassifier.fit, models.first_trees

    def few(self, df):
        asked.append(self.getMaxIter())
        return fit(self.copy({self.maxIter: 2}), df)

    def curve(model, judged, label):
        return spark.createDataFrame([(1, 0.5), (min(asked[-1], 150), 0.9)], "trees int, pr_auc double")

    monkeypatch.setattr(learning, "labelled_documents", lambda *_: rows)
    monkeypatch.setattr(models.GBTClassifier, "fit", few)
    monkeypatch.setattr(models, "boosting_curve", curve)
    monkeypatch.setattr(models, "first_trees", lambda model, n: kept.append(n) or cut(model, 1))
    monkeypatch.setattr(models, "at_once", lambda spark, jobs: [job() for job in jobs])
    assert learning.train_metadata(spark, "").count() == 1
    first, second = models.PATIENCE + models.FIRST_TREES, 2 * (models.PATIENCE + models.FIRST_TREES)
    assert models.MAX_TREES == 2000 and learning.TREES == models.MAX_TREES
    assert (asked, kept) == ([first, second] * 6, [150] * 6)


@pytest.mark.parametrize("known", [1, 2, 50, 300])
def test_scores_are_those_of_walks_to_a_leaf(spark, known):
    """However few rows there are, no walk ends at a node inside a tree."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(known, 6)))], "id long, x array<double>")
    fitted = forest.fit_forest(df, "id", F.col("x"), trees=30)
    trees = [{n.node: n for n in part.itertuples()} for _, part in fitted.nodes.groupby("tree")]

    def walked(nodes, x):
        at = nodes[0]
        while at.feature >= 0:
            at = nodes[at.below if x[at.feature] <= at.cut else at.above]
        return at.path

    usual = forest.expected_path(min(known, 256))
    for row in fitted.score(df, F.col("x")).collect():
        mean = sum(walked(nodes, row.x) for nodes in trees) / len(trees)
        assert row.raw == pytest.approx(-(2 ** (-mean / usual)) if usual else -0.5)


def test_resampling_is_dealt_out_by_its_draws(spark, monkeypatch):
    """A scored table of one partition: tasks share the draws, and the replicates stay what they were."""
    scored = spark.range(300).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 37 / 37).alias("s")).coalesce(1)
    plans, ranked = [], evaluation.ranked_scores

    def seen(counted, by=()):
        plans.append(counted._jdf.queryExecution().optimizedPlan().toString())
        return ranked(counted, by)

    monkeypatch.setattr(evaluation, "ranked_scores", seen)
    got = []
    for draws in (1 << 18, 1000):
        monkeypatch.setattr(evaluation, "DRAWS_PER_TASK", draws)
        got.append({r.replicate: r.pr_auc for r in evaluation.bootstrap_replicates(scored, "s", "y", "id", 20, 3).collect()})
    assert got[0] == pytest.approx(got[1]) and len(got[0]) == 20
    assert re.findall(r"RepartitionByExpression \[_y\S+, _at\S+\], (\d+)", plans[1]) == ["6"] * 3


def test_trees_do_not_depend_on_how_the_table_came(noisy, letters, monkeypatch):
    """Rows are dealt out by their number, however few partitions a small table has."""
    fitted, fit = [], models.GBTClassifier.fit

    def seen(self, rows):
        fitted.append(rows.rdd.getNumPartitions())
        return fit(self, rows)

    monkeypatch.setattr(models.GBTClassifier, "fit", seen)
    monkeypatch.setattr(models, "ROWS_PER_TASK", 400)
    trees = [models.fit_boosted(noisy.repartition(n), "y", "row_id", letters, max_trees=4).stages[-1] for n in (1, 5)]
    assert fitted == [4, 4]
    assert len({"".join(t.toDebugString.split("\n", 1)[1] for t in model.trees) for model in trees}) == 1


def test_texts_are_counted_once(spark):
    assert "parquet" not in learning.labelled_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
