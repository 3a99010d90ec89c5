"""Models and streams over the given tables. Trees and streams are checked by rows and
properties; what the stream records is also checked in SQL, since it must equal a batch."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions import rules as R
from riskloom.operators import decisions as D
from riskloom.operators import evaluation as E
from riskloom.operators import forest as IF
from riskloom.operators import models as M
from riskloom.operators import prep
from riskloom.operators.ranking import with_constants
from riskloom.plans import sql
from riskloom.plans.messaging import _BROKEN, messages
from riskloom.plans.quality import rounded
from riskloom.plans.registry import query
from riskloom.plans.tables import LIMITS, THRESHOLDS, VERSION, WINDOWS, stub_risk, table
from riskloom.session import checkpointed, run_folder, ship
from riskloom.sources import messages as msg
from riskloom.streaming import jobs as J

# At most so many trees a fit in the queries, as many as the operators grow; early stopping decides how many are kept.
TREES = M.MAX_TREES
TEXT_FEATURES = ("chars", "words", "digits", "capitals", "lines")


def labelled_documents(spark, sf_dir):
    """Counts over whole texts, with the quality label; the 'amount' at stake is the length.

    Stored, as every split and fit reads these rows again, and counting is the dear part.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.col("text")
    counted = docs.select(
        "doc_id",
        F.length(text).cast("double").alias("chars"),
        F.size(F.split(text, r"\s+")).cast("double").alias("words"),
        F.regexp_count(text, F.lit("[0-9]")).cast("double").alias("digits"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("double").alias("capitals"),
        F.regexp_count(text, F.lit("\n")).cast("double").alias("lines"),
    )
    return checkpointed(counted.join(labels.where("quality is not null").select("doc_id", F.col("quality").alias("label")), "doc_id"))


def inputs():
    return Pipeline(stages=[VectorAssembler(inputCols=list(TEXT_FEATURES), outputCol="features")])


@query()
def gbt_scores(spark, sf_dir):
    rows = prep.holdout(labelled_documents(spark, sf_dir), "label", "doc_id")
    model = M.fit_boosted(rows.where(~F.col("is_test")), "label", "doc_id", inputs(), max_trees=TREES)
    return rounded(M.fraud_probability(model, rows.where("is_test")).select("doc_id", "label", "risk"), "risk")


@query()
def gain_importance(spark, sf_dir):
    rows = labelled_documents(spark, sf_dir)
    model = M.fit_boosted(rows, "label", "doc_id", inputs(), max_trees=TREES)
    return rounded(M.importance(rows, model, TEXT_FEATURES), "share")


@query()
def out_of_fold(spark, sf_dir):
    scored = M.out_of_fold(labelled_documents(spark, sf_dir), "label", "doc_id", inputs(), max_trees=TREES)
    return rounded(scored.select("doc_id", "label", "fold", "risk"), "risk")


@query()
def metrics_by_source(spark, sf_dir):
    rows = labelled_documents(spark, sf_dir)
    model, scored = M.at_once(
        spark,
        [
            lambda: M.fit_boosted(rows, "label", "doc_id", inputs(), max_trees=TREES),
            lambda: M.out_of_fold(rows, "label", "doc_id", inputs(), max_trees=TREES),
        ],
    )
    both = {"in sample": M.fraud_probability(model, rows), "out of fold": scored}
    return rounded(M.metrics_by_source(both, "risk", "label"), "pr_auc", "pr_auc_baseline", "roc_auc")


@query()
def train_metadata(spark, sf_dir):
    _, metadata = M.train(
        labelled_documents(spark, sf_dir), "label", "doc_id", "chars", inputs(), capacity=0.9, max_trees=TREES
    )
    row = spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string")
    return row


def forest_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", F.when(F.col("label") == 0, 0).otherwise(1).alias("label"), F.col("embedding").cast("array<double>").alias("x"))


@query()
def isolation_forest(spark, sf_dir):
    """Cluster 0 is 'normal'; risk is calibrated against it."""
    ship(spark)
    rows = forest_rows(spark, sf_dir)
    normal = prep.normal_only(rows, "label")
    forest = IF.fit_forest(normal, "vec_id", F.col("x"))
    return rounded(IF.forest_risk(forest, normal, rows, F.col("x")).select("vec_id", "label", "raw", "risk"), "raw", "risk")


@query()
def forest_quality(spark, sf_dir):
    ship(spark)
    rows = forest_rows(spark, sf_dir)
    normal = prep.normal_only(rows, "label")
    forest = IF.fit_forest(normal, "vec_id", F.col("x"))
    scored = IF.forest_risk(forest, normal, rows, F.col("x"))
    return rounded(E.metrics(scored, "risk", "label"), "pr_auc", "pr_auc_baseline", "roc_auc")


@query(
    """SELECT count(*) AS rows, count(*) FILTER (WHERE label = 0) AS normals, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS inversions,
  CAST(0 AS BIGINT) AS odd_paths, true AS normals_spread_evenly FROM embeddings"""
)
def forest_facts(spark, sf_dir):
    """What must hold whatever trees are drawn: risks lie in [0, 1] and follow the raw scores, half of the normals have a
    risk above one half, and vectors without outliers have raw scores near -0.5, the usual path."""
    ship(spark)
    rows = forest_rows(spark, sf_dir)
    normal = prep.normal_only(rows, "label")
    scored = checkpointed(IF.forest_risk(IF.fit_forest(normal, "vec_id", F.col("x")), normal, rows, F.col("x")).select("label", "raw", "risk"))
    strange = scored.groupBy((-F.col("raw")).alias("strange")).agg(F.min("risk").alias("least"), F.max("risk").alias("most"))
    bins = strange.groupBy(F.floor(F.col("most") * 1024).alias("bin")).agg(F.min("strange").alias("low"), F.max("strange").alias("high"), F.count_if(F.col("least") < F.col("most")).alias("within"))
    before = F.max("high").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))  # at most 1,025 rows
    inversions = bins.withColumn("before", before).agg((F.count_if(F.col("low") <= F.col("before")) + F.sum("within")).alias("inversions"))
    total = scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("label") == 0).alias("normals"),
        F.count_if(~F.col("risk").between(0, 1)).alias("outside"),
        (F.abs(F.avg(F.when(F.col("label") == 0, (F.col("risk") > 0.5).cast("int"))) - 0.5) < 0.1).alias("normals_spread_evenly"),
        F.count_if(~F.col("raw").between(-0.75, -0.35)).alias("odd_paths"),
    )
    return with_constants(total, inversions)


@query()
def contamination_offset(spark, sf_dir):
    ship(spark)
    rows = forest_rows(spark, sf_dir)
    normal = prep.normal_only(rows, "label")
    scored = IF.fit_forest(normal, "vec_id", F.col("x")).score(normal, F.col("x"))
    return rounded(IF.contamination_cut(scored, 0.0017), "offset")


# ------------------------------------------------------------------- streams
EVERY_FILE = 1_000_000  # all files that are there make one batch


def _halves(spark, sf_dir):
    """The messages of the first and of the second half of the month."""
    sent = messages(spark, sf_dir).select(*msg.MESSAGE_SCHEMA.fieldNames())
    half = F.lit("2024-01-16").cast("timestamp")
    return sent.where(F.col("timestamp") < half), sent.where(F.col("timestamp") >= half)


def _ingest(spark, root):
    source = msg.file_stream(spark, f"{root}/messages", EVERY_FILE)
    J.start_ingest(
        source, f"{root}/clean", J.folder_writer(f"{root}/dead"), f"{root}/ingest", f"{root}/stats"
    ).awaitTermination()


_STREAM = (
    sql.SCORED.replace("FROM events)", "FROM events WHERE event_id % 40 > 9)", 1)
)


@query(
    sql.with_(
        _STREAM,
        """SELECT transaction_id, risk AS risk_score, decision, model_decision, card_id, CAST(c1m AS INT) AS velocity_count_1m, CAST(c1h AS INT) AS velocity_count_1h,
  amount_1h AS velocity_amount_1h, CAST(places AS INT) AS velocity_countries_1h, gap AS velocity_seconds_since_previous, reasons FROM scored""",
    )
)
def stream_decisions(spark, sf_dir):
    """Broken messages set aside, the rest measured with state that spans both batches."""
    ship(spark)
    root = run_folder(spark, "stream")
    job = J.ScoringJob(stub_risk(), THRESHOLDS, VERSION, WINDOWS, R.velocity_rules(LIMITS))
    for part in _halves(spark, sf_dir):
        # Both queries stop when the input is used up and resume from their checkpoints.
        part.write.mode("append").parquet(f"{root}/messages")
        _ingest(spark, root)
        J.start_scoring(
            spark, f"{root}/clean", job, J.decision_log(f"{root}/log"), f"{root}/scoring", f"{root}/scores"
        ).awaitTermination()
    latest = D.latest_decisions(spark.read.parquet(f"{root}/log"))
    return latest.select(
        "transaction_id", "risk_score", "decision", "model_decision", "card_id", "velocity_count_1m", "velocity_count_1h",
        "velocity_amount_1h", "velocity_countries_1h", "velocity_seconds_since_previous", F.concat_ws(",", "reasons").alias("reasons"),
    )


@query(
    sql.with_(
        _BROKEN,
        """SELECT CAST(count(*) AS BIGINT) AS consumed, count(*) FILTER (WHERE problem IS NULL) AS scored, count(*) FILTER (WHERE problem IS NOT NULL) AS dead_lettered,
  CAST(0 AS BIGINT) AS duplicates, CAST(2 AS BIGINT) AS batches FROM judged""",
    )
)
def stream_ingest_stats(spark, sf_dir):
    """Only the first query: what it consumed, kept and set aside in its two batches."""
    root = run_folder(spark, "ingest")
    for part in _halves(spark, sf_dir):
        part.write.mode("append").parquet(f"{root}/messages")
        _ingest(spark, root)
    stats = spark.read.parquet(f"{root}/stats")
    names = ("consumed", "scored", "dead_lettered", "duplicates")
    return stats.agg(*(F.sum(n).alias(n) for n in names), F.count(F.lit(1)).alias("batches"))
