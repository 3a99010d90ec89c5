"""The supervised model: boosted trees with early stopping, scored out of fold."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators import evaluation, policy, prep
from riskloom.session import checkpointed, ship

# Training settings. Early stopping on average precision decides the number of trees.
BOOSTING = {"stepSize": 0.05, "maxDepth": 4, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
MAX_TREES = 2000
VALIDATION_SHARE = 0.2


PATIENCE = 100  # trees without a better validation score after which no more are grown
FIRST_TREES = 28  # grown beyond the patience at first; then twice as many as before
SCORE_STEPS = 1 << 12  # probabilities are compared in that many steps when a number of trees is judged
ROWS_PER_TASK = 1 << 15  # the inputs of trees are narrow: by their size alone, most tables would be one task's work


def at_once(spark: SparkSession, jobs: Sequence[Callable]) -> list:
    """Results of functions that run side by side, in their order.

    Growing a tree is many small jobs, one after the other, which leave most of a cluster idle.
    """
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [job.result() for job in [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]]


def _leaf_values(model: GBTClassificationModel) -> list[np.ndarray]:
    """The weighted value of each leaf of each tree, in the order in which Spark numbers leaves."""
    values = [re.findall(r"Predict: (\S+)", tree.toDebugString) for tree in model.trees]
    return [weight * np.array(own, np.float64) for weight, own in zip(model.treeWeights, values)]


def _staged_rows(values: list[np.ndarray]):
    """Leaf numbers and labels to counts: (trees, step, n, pos) for every number of trees."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = np.asarray(batch.column("leaves").flatten()).reshape(batch.num_rows, len(values))
            label = np.asarray(batch.column("label"), np.int64)
            margin = np.zeros(batch.num_rows)
            for k, own in enumerate(values):
                margin += own[leaves[:, k]]
                step = np.minimum(SCORE_STEPS / (1 + np.exp(-2 * margin)), SCORE_STEPS - 1).astype(np.int64)
                n = np.bincount(step, minlength=SCORE_STEPS)
                at = np.flatnonzero(n)
                columns = [np.full(len(at), k + 1, np.int32), at.astype(np.int32), n[at], np.bincount(step, label, SCORE_STEPS).astype(np.int64)[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["trees", "step", "n", "pos"])

    return rows


def boosting_curve(model: GBTClassificationModel, rows: DataFrame, label: str) -> DataFrame:
    """(trees, pr_auc): the average precision on `rows` of the first 1, 2, .. trees of the ensemble, in one pass.

    Rows are counted per number of trees and step of the probability before anything moves, so what is shuffled does not
    grow with them. A row has the leaf it ends in for each tree, up to thousands, so these are passed as small numbers.
    """
    ship(rows.sparkSession)
    leaves = vector_to_array("_leaf").cast("array<smallint>").alias("leaves")
    marked = model.setLeafCol("_leaf").transform(rows).select(leaves, F.col(label).cast("long").alias("label"))
    steps = marked.mapInArrow(_staged_rows(_leaf_values(model)), "trees int, step int, n long, pos long")
    counted = steps.groupBy("trees", "step").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    upto = Window.partitionBy("trees").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.select("trees", "pos", F.sum("n").over(upto).alias("flagged"), F.sum("pos").over(upto).alias("tp"))
    return ranked.groupBy("trees").agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("flagged")), F.sum("pos")).alias("pr_auc"))


def best_prefix(curve: DataFrame) -> int:
    """The smallest number of trees with the highest average precision."""
    row = curve.where("pr_auc is not null").agg(F.min_by("trees", F.struct(-F.col("pr_auc"), "trees")).alias("best")).first()
    return row["best"] or 1


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The ensemble cut after its first `n` trees."""
    context = SparkContext.getOrCreate()
    jvm, gateway = context._jvm, context._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    for k, (tree, weight) in enumerate(zip(model.trees[:n], model.treeWeights)):
        trees[k], weights[k] = tree._java_obj, float(weight)
    java = jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{model.uid}_{n}", trees, weights, model.numFeatures, 2)
    return GBTClassificationModel(java).setFeaturesCol(model.getFeaturesCol())


def fit_boosted(
    train: DataFrame, label: str, row_id: str, inputs: Pipeline, max_trees: int = MAX_TREES, seed: int = 42, patience: int = PATIENCE
) -> PipelineModel:
    """Fits inputs and trees; an exact stratified slice of the rows decides how many trees are kept.

    Trees are grown until `patience` of them have not raised the average precision on the slice, and cut after the best
    one. Growing goes on in doubling runs, since Spark can't add trees to a model. A tree costs some five small jobs,
    about a quarter of a second, however few the rows are. Rows are dealt out by their number and lie in the order of
    their ids, so that the samples trees are grown on do not depend on how the table came.
    """
    marked = prep.holdout(train, label, row_id, VALIDATION_SHARE, seed, "_validation")
    prepared = inputs.fit(marked)
    dealt = prepared.transform(marked).select(row_id, "features", label, "_validation").repartition(-(-train.count() // ROWS_PER_TASK) or 1, row_id)
    rows = checkpointed(dealt.sortWithinPartitions(row_id))
    fit_rows, judged = rows.where(~F.col("_validation")).persist(), rows.where("_validation")
    grown = lambda n: GBTClassifier(labelCol=label, featuresCol="features", maxIter=n, seed=seed, **BOOSTING).fit(fit_rows)
    try:
        trees = min(max_trees, patience + FIRST_TREES)
        while True:
            model = grown(trees)
            best = best_prefix(boosting_curve(model, judged, label))
            if trees == max_trees or best + patience <= trees:
                break
            trees = min(max_trees, 2 * trees)
    finally:
        fit_rows.unpersist()
    return PipelineModel(stages=[*prepared.stages, first_trees(model, best)])


def fraud_probability(model: PipelineModel, df: DataFrame, name: str = "risk") -> DataFrame:
    """Adds the probability of class 1."""
    return model.transform(df).select(*df.columns, vector_to_array(F.col("probability"))[1].alias(name))


def out_of_fold(
    train: DataFrame, label: str, row_id: str, inputs: Pipeline, k: int = 5, max_trees: int = MAX_TREES, seed: int = 42
) -> DataFrame:
    """Each row scored once, by a model that never saw it. k is a small parameter."""
    folded = checkpointed(prep.folds(train, label, row_id, k, seed))

    def scored(fold: int) -> DataFrame:
        model = fit_boosted(folded.where(F.col("fold") != fold), label, row_id, inputs, max_trees, seed)
        return fraud_probability(model, folded.where(F.col("fold") == fold))

    return reduce(DataFrame.unionByName, at_once(train.sparkSession, [partial(scored, fold) for fold in range(k)]))


def importance(df: DataFrame, model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """Share of the total gain per input, largest first."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    total = sum(values) or 1.0
    rows = [(name, value / total) for name, value in zip(names, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, share double").orderBy(F.desc("share"), "feature")


def metrics_by_source(sources: dict[str, DataFrame], score: str, label: str) -> DataFrame:
    """The same metrics for several scorings, e.g. in-sample, out-of-fold and test."""
    parts = [df.select(F.lit(name).alias("source"), score, label) for name, df in sources.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return evaluation.metrics(every, score, label, ["source"])


def train(
    raw: DataFrame,
    label: str,
    row_id: str,
    amount: str,
    inputs: Pipeline,
    costs: policy.Costs = policy.Costs(),
    capacity: float = 0.02,
    k: int = 5,
    max_trees: int = MAX_TREES,
    resamples: int = 1000,
    seed: int = 42,
) -> tuple[PipelineModel, dict]:
    """Clean, split, score out of fold, choose thresholds on that, fit, and measure on the test part.

    `inputs` are unfitted stages ending in `features`; they are fitted on training rows only.
    """
    # Rows equal in all but their id are one; it goes by the least id.
    rest = [c for c in raw.columns if c != row_id]
    distinct = raw.groupBy(*rest).agg(F.min(row_id).alias(row_id)).select(*raw.columns)
    clean = checkpointed(prep.holdout(distinct, label, row_id, 0.2, seed))
    evaluation.check_inputs(clean, label, amount)
    fit_rows, test_rows = clean.where(~F.col("is_test")), clean.where("is_test")
    oof, model = at_once(
        raw.sparkSession,
        [
            lambda: checkpointed(out_of_fold(fit_rows, label, row_id, inputs, k, max_trees, seed)),
            lambda: fit_boosted(fit_rows, label, row_id, inputs, max_trees, seed),
        ],
    )
    grid = policy.PROBABILITY_GRID
    priced = policy.policy_costs(oof, label, "risk", amount, costs, grid, (*grid, None))
    chosen = policy.choose_thresholds(priced, capacity).first()
    pair = (chosen["review_threshold"], chosen["block_threshold"])
    tested = checkpointed(fraud_probability(model, test_rows))
    interval = evaluation.interval(evaluation.bootstrap_replicates(tested, "risk", label, row_id, resamples, seed)).first()
    both = {
        row["source"]: row
        for row in metrics_by_source({"out_of_fold": oof, "test": tested}, "risk", label).collect()
    }
    at_pair = lambda df: policy.policy_summary(df, label, "risk", amount, *pair, costs).first().asDict()
    size = raw.count()
    metadata = {
        "model_type": "gradient boosted trees",
        "trained_review": pair[0],
        "trained_block": pair[1],
        "review_cost": costs.review,
        "false_block_cost": costs.false_block,
        "chargeback_fee": costs.chargeback_fee,
        "max_review_rate": capacity,
        "raw_rows": size,
        "duplicates_removed": size - both["out_of_fold"]["n"] - both["test"]["n"],
        "train_rows": both["out_of_fold"]["n"],
        "train_fraud": both["out_of_fold"]["n_fraud"],
        "trees": model.stages[-1].getNumTrees,
        "out_of_fold_pr_auc": both["out_of_fold"]["pr_auc"],
        "out_of_fold_policy": at_pair(oof),
        "test_rows": both["test"]["n"],
        "test_fraud": both["test"]["n_fraud"],
        "test_pr_auc": both["test"]["pr_auc"],
        "test_pr_auc_low": interval["low"],
        "test_pr_auc_high": interval["high"],
        "test_roc_auc": both["test"]["roc_auc"],
        "test_policy": at_pair(tested),
    }
    return model, metadata
