import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import identities as I
from riskloom.functions.scalars import utc_timestamp, window_start
from riskloom.operators import decisions as D
from riskloom.operators import explore, forest, models, prep
from riskloom.operators import rollups as O
from riskloom.sources import artifacts, replay, tables

BASE = datetime(2026, 9, 16, 12, tzinfo=timezone.utc)


# ----------------------------------------------------------------- decisions
def row(ident, risk, decision, minutes, card="card-1", model=None, reasons=None, velocity=(None,) * 6, **changes):
    values = dict(
        transaction_id=ident, risk_score=risk, decision=decision, review_threshold=0.24, block_threshold=0.95, model_version="v-test",
        scored_at=BASE + timedelta(minutes=minutes), card_id=card, velocity_count_1m=velocity[0], velocity_count_5m=velocity[1],
        velocity_count_1h=velocity[2], velocity_amount_1h=velocity[3], velocity_countries_1h=velocity[4],
        velocity_seconds_since_previous=velocity[5], model_decision=model or decision, reasons=reasons,
    )
    values.update(changes)
    return tuple(values[f.name] for f in D.DECISION_SCHEMA.fields)


@pytest.fixture(scope="module")
def board(spark):
    rows = [row(f"tx-{i}", 0.01, "approve", 0) for i in range(5)]
    rows.append(row("tx-review", 0.5, "review", 1))
    rows.append(row("tx-escalated", 0.1, "review", 1, model="approve", reasons=["many_in_a_minute"], velocity=(7, 9, 12, 250.5, 2, 1.0)))
    rows.append(row("tx-block", 0.99, "block", 2, card="card-2"))
    return spark.createDataFrame(rows, D.DECISION_SCHEMA)


def test_summary(board):
    s = D.summary(board).first()
    assert (s["total"], s["approve"], s["review"], s["block"], s["escalated"], s["cards"]) == (8, 5, 2, 1, 1, 2)
    assert s["per_second"] == pytest.approx(8 / 120) and s["block_rate"] == 1 / 8
    empty = D.summary(board.limit(0)).first()
    assert empty["total"] == 0 and empty["per_second"] == 0.0 and empty["review_rate"] == 0.0 and empty["first_at"] is None


def test_time_buckets(board):
    counts = lambda df: [(r["approve"], r["review"], r["block"]) for r in D.over_time(df, 60).orderBy("bucket_start").collect()]
    assert counts(board) == [(5, 0, 0), (0, 2, 0), (0, 0, 1)]
    assert counts(board.where("decision <> 'review'")) == [(5, 0, 0), (0, 0, 0), (0, 0, 1)]
    assert counts(board.limit(0)) == []
    assert D.bucket_width(board, 60).first()[0] == 5 and D.bucket_width(board, 2).first()[0] == 60
    assert D.bucket_width(board.limit(0)).first()[0] == 1


def test_histogram(board):
    rows = D.risk_histogram(board).orderBy("bin").collect()
    assert len(rows) == 50 and sum(r["decisions"] for r in rows) == 8
    assert sum(r["decisions"] for r in rows if r["risk_upto"] > 0.3) == 2
    low = D.risk_histogram(board.limit(1).withColumn("risk_score", F.lit(0.0))).orderBy("bin").first()
    assert low["decisions"] == 1


def test_queue_rules_and_cards(board):
    assert D.review_queue(board).count() == 3
    only = D.review_queue(board, only_escalated=True).collect()
    assert [r["transaction_id"] for r in only] == ["tx-escalated"] and only[0]["rules"] == ["many_in_a_minute"]
    assert [tuple(r) for r in D.rule_counts(board).collect()] == [("many_in_a_minute", 1)]
    busy = D.busiest_cards(board).collect()
    assert [(r["card_id"], r["transactions"]) for r in busy] == [("card-1", 7), ("card-2", 1)]
    assert (busy[0]["peak_1m"], busy[0]["escalated"], busy[0]["amount"]) == (7, 1, 250.5)
    assert D.card_history(board, "card-2").first()["transaction_id"] == "tx-block"
    assert {r["decision"]: r["decisions"] for r in D.counts_by_kind(board.where("decision <> 'block'")).collect()} == {"approve": 5, "review": 2, "block": 0}


def test_recent_and_view(board):
    assert [r["transaction_id"] for r in D.recent(board, 2).collect()] == ["tx-block", "tx-escalated"]
    with pytest.raises(ValueError):
        D.recent(board, 501)
    seen = D.view(board, BASE + timedelta(minutes=1), limit=2)
    assert seen.columns == list(D.VIEW_COLUMNS) and D.truncation(seen, 2).first()["truncated"]
    assert not D.truncation(D.view(board), 8).first()["truncated"]
    assert window_start(900, BASE) == BASE - timedelta(minutes=15) and window_start(None, BASE) is None


def test_upsert_replaces_every_column(spark, board, tmp_path):
    path = str(tmp_path / "log")
    first = row("tx-1", 0.10, "approve", 0, velocity=(1, 1, 1, 5.0, 1, None))
    D.append_batch(spark.createDataFrame([first], D.DECISION_SCHEMA), path, 1)
    D.append_batch(spark.createDataFrame([row("tx-1", 0.99, "block", 1)], D.DECISION_SCHEMA), path, 2)
    D.append_batch(spark.createDataFrame([row("tx-1", 0.99, "block", 1)], D.DECISION_SCHEMA), path, 2)
    (now,) = D.latest_decisions(spark.read.parquet(path)).collect()
    assert now["decision"] == "block" and now["velocity_count_1h"] is None


def test_rows_outside_the_contract_are_not_written(spark, tmp_path):
    bad = spark.createDataFrame([row("tx-1", 1.5, "approve", 0)], D.DECISION_SCHEMA)
    assert D.violations(bad).first()["problems"] == "risk_score outside [0, 1]"
    with pytest.raises(Exception, match="outside its contract"):
        D.append_batch(bad, str(tmp_path / "log"), 1)


def test_naive_times_are_refused(spark, board):
    with pytest.raises(ValueError, match="time zone"):
        D.to_rows(board, datetime(2026, 1, 1))
    naive = spark.sql("select timestamp_ntz'2026-01-01 00:00:00' as t")
    with pytest.raises(ValueError, match="no time zone"):
        utc_timestamp(naive, "t")


def test_additive_evolution(board):
    old = board.drop("model_decision", "reasons")
    assert [f.name for f in D.added_columns(old.schema)] == ["model_decision", "reasons"]
    assert D.evolved(old).schema.names == D.DECISION_SCHEMA.names and D.evolved(old).where("reasons is not null").isEmpty()
    with pytest.raises(ValueError, match="cannot be required"):
        D.added_columns(board.drop("decision").schema)
    with pytest.raises(ValueError, match="changed type"):
        D.added_columns(board.withColumn("card_id", F.lit(1)).schema)
    with pytest.raises(ValueError, match="dropped"):
        D.added_columns(T.StructType([*D.DECISION_SCHEMA.fields, T.StructField("more", T.StringType())]))


# ------------------------------------------------------------------- rollups
def test_knee(spark):
    stages = lambda *rows: spark.createDataFrame(rows, "stage int, throughput double, p95 double")
    assert O.knee(stages((1, 100.0, 10.0), (2, 190.0, 11.0), (4, 195.0, 50.0)), "stage").first()["stage"] == 2
    assert O.knee(stages((1, 100.0, 10.0), (2, 200.0, 10.0), (4, 400.0, 10.0)), "stage").isEmpty()


def test_stage_summary(spark):
    good = [(1, 200, float(i)) for i in range(1, 101)] + [(1, 500, 900.0), (2, 500, 1.0)]
    log = spark.createDataFrame(good, "stage int, status int, latency_s double")
    spans = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 0.0)], "stage int, seconds double")
    got = {r["stage"]: tuple(r)[1:] for r in O.stage_summary(log, "stage", spans).collect()}
    assert got[1] == (100, 1, 10.0, 50.0, 95.0, 99.0)
    assert got[2] == (0, 1, 0.0, 0.0, 0.0, 0.0) and got[3] == (0, 0, 0.0, 0.0, 0.0, 0.0)


def test_routes(spark):
    paths = ["/score", "/transactions/tx-1", "/transactions", "/transactions/a/b", "/wp-admin", "/score/"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, path string")
    got = [r[0] for r in df.orderBy("i").select(O.route_of(F.col("path"))).collect()]
    assert got == ["/score", "/transactions/{transaction_id}", "/transactions", "unmatched", "unmatched", "unmatched"]


def test_counter_means(spark):
    scrapes = [("a", 1, 1.0, 10), ("a", 2, 4.0, 16), ("b", 1, 1.0, 10), ("b", 2, 1.0, 10)]
    df = spark.createDataFrame(scrapes, "stage string, scraped_at int, total double, count bigint")
    assert {r[0]: r[1] for r in O.counter_means(df, "stage").collect()} == {"a": 0.5, "b": None}


# ---------------------------------------------------------------- identities
def test_keyed_identities_of_repeated_and_missing_ids(spark):
    def plain(own):
        u = I.keyed_digest(own, "card") / 2**64
        card = sum(1 for end in I.card_ends() if end <= u)
        name = f"card-{card:05d}"
        merchant = I.MERCHANTS[I.keyed_digest(own, "merchant") % 12]
        if I.keyed_digest(own, "abroad") / 2**64 < 0.03:
            return name, merchant, I.FOREIGN_COUNTRIES[I.keyed_digest(own, "country") % 6]
        return name, merchant, I.HOME_COUNTRIES[I.keyed_digest(name, "home") % 8]

    ids = [f"test-row-{i % 400}" for i in range(900)] + [None, "", None]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(ids)], "n long, transaction_id string")
    got = {r.n: r for r in I.with_identities(df.repartition(3), keyed=True).collect()}
    assert [(got[i].card_id, got[i].merchant, got[i].country) for i in range(len(ids))] == [(None,) * 3 if k is None else plain(k) for k in ids]
    assert I.with_identities(df.limit(0), keyed=True).count() == 0
    assert I.with_identities(df.where("transaction_id is null"), keyed=True).where("country is null").count() == 2


def test_identities(spark):
    ids = spark.range(20_000).select(F.concat(F.lit("test-row-"), "id").alias("transaction_id"))
    known = I.with_identities(ids.where("transaction_id = 'test-row-7'"), keyed=True).first()
    assert (known["card_id"], known["merchant"], known["country"]) == ("card-00370", "online-marketplace", "IN")
    for keyed in (False, True):
        made = I.with_identities(ids, keyed=keyed).cache()
        per_card = made.groupBy("card_id").count().orderBy(F.desc("count")).collect()
        top = sum(r["count"] for r in per_card[:50]) / 20_000
        assert 0.05 < top < 0.20 and per_card[0]["count"] < 400 and len(per_card) > 2500
        assert made.select("merchant").distinct().count() == 12
        abroad = made.where(F.col("country").isin(*I.FOREIGN_COUNTRIES)).count() / 20_000
        assert 0.02 < abroad < 0.04
        homes = made.where(F.col("country").isin(*I.HOME_COUNTRIES)).groupBy("card_id").agg(F.count_distinct("country").alias("n"))
        assert homes.agg(F.max("n")).first()[0] == 1
        nobody = I.with_identities(ids.limit(3).withColumn("transaction_id", F.lit(None).cast("string")), keyed=keyed)
        assert nobody.agg(F.count("card_id"), F.count("merchant"), F.count("country")).first() == (0, 0, 0)


def test_replay(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 1.0), (2, 5.0), (3, 0.0)], "row int, Time double")
    got = replay.replay_window(df, "Time", "row", 1, 2).orderBy("position").collect()
    assert [r["transaction_id"] for r in got] == ["test-row-1", "test-row-0"]
    with pytest.raises(ValueError, match="past the end"):
        replay.replay_window(df, "Time", "row", 4)
    window = replay.replay_window(df, "Time", "row", 1)
    due = replay.schedule(window, F.lit(BASE), 2.0).orderBy("position").collect()
    assert [(r["due_at"].timestamp() - due[0]["due_at"].timestamp()) for r in due] == [0.0, 0.5, 1.0]
    sent = replay.report(window, 1, 3).collect()
    assert sum(r["sent"] for r in sent) == 3 and {r["next_start"] for r in sent} == {4}
    body = replay.sample_bodies(window.select("transaction_id", "card_id", "position"), ["transaction_id", "card_id"], True, "position").first()["body"]
    assert [t["transaction_id"] for t in json.loads(body)["transactions"]] == ["test-row-1", "test-row-0", "test-row-2"]


# ---------------------------------------------------------- preparation, files
@pytest.fixture(scope="module")
def labelled(spark):
    """2,000 rows, 50 fraud, shifted on five columns."""
    shifted = {"V3", "V10", "V12", "V14", "V17"}
    base = spark.range(2000).select("id", F.when(F.col("id") < 50, 1).otherwise(0).alias("Class"))
    cols = {"Time": F.rand(0) * 172_800, "Amount": -80 * F.log(1 - F.rand(1))}
    for i, v in enumerate(prep.V_COLUMNS):
        cols[v] = F.randn(i + 2) - (F.when(F.col("Class") == 1, 7.0).otherwise(0.0) if v in shifted else F.lit(0.0))
    return base.withColumns(cols).select("id", *prep.RAW_FEATURES, "Class").cache()


def test_splits_are_exact_and_disjoint(labelled):
    doubled = labelled.unionByName(labelled.where("id < 10"))
    assert prep.deduplicate(doubled).count() == 2000
    marked = prep.holdout(labelled, "Class", "id")
    parts = {(r["is_test"], r["Class"]): r["count"] for r in marked.groupBy("is_test", "Class").count().collect()}
    assert parts == {(True, 1): 10, (True, 0): 390, (False, 1): 40, (False, 0): 1560}
    again = prep.holdout(labelled.repartition(7), "Class", "id")
    assert marked.select("id", "is_test").exceptAll(again.select("id", "is_test")).isEmpty()
    leak = prep.leakage(marked.where("is_test"), marked.where("not is_test"), "id", prep.RAW_FEATURES).first()
    assert (leak["shared_ids"], leak["shared_rows"], leak["rows_pairs"]) == (0, 0, 0)


def test_folds_cover_every_row_once(labelled):
    folded = prep.folds(labelled, "Class", "id", 5)
    assert folded.count() == 2000
    per = folded.where("Class = 1").groupBy("fold").count().collect()
    assert [r["count"] for r in per] == [10] * 5


def test_model_inputs(labelled):
    scaling = prep.fit_scaling(labelled)
    out = prep.model_inputs(labelled.withColumn("extra", F.lit(1)), scaling)
    assert out.columns == list(prep.MODEL_FEATURES) and len(out.columns) == 31
    middle = out.agg(F.median("Amount")).first()[0]
    assert middle == pytest.approx(0, abs=1e-9)
    near = labelled.limit(2).withColumn("Time", F.when(F.monotonically_increasing_id() == 0, 86_399.0).otherwise(1.0))
    a, b = prep.model_inputs(near, scaling).select("time_sin", "time_cos").collect()
    assert abs(a[0] - b[0]) < 1e-3 and abs(a[1] - b[1]) < 1e-3


def test_raw_csv_and_splits(spark, labelled, tmp_path):
    path = str(tmp_path / "raw.csv")
    labelled.write.option("header", True).csv(path)
    read = tables.read_raw_csv(spark, path)
    assert read.count() == 2000 and dict(read.dtypes)["Class"] == "int" and "id" in read.columns
    labelled.drop("V9", "Amount").write.option("header", True).csv(path + "2")
    with pytest.raises(ValueError, match=r"\['Amount', 'V9'\]"):
        tables.read_raw_csv(spark, path + "2")
    tables.save_splits(prep.holdout(labelled, "Class", "id"), str(tmp_path / "splits"))
    train, test = tables.load_splits(spark, str(tmp_path / "splits"))
    assert (train.count(), test.count()) == (1600, 400)


def test_density_integrates_to_one(labelled):
    out = explore.density_histogram(labelled, F.log1p("Amount"), "Class", 60)
    assert out.count() == 120
    width = out.groupBy("Class").agg(((F.max("bin_low") - F.min("bin_low")) / 59).alias("w"), F.sum("density").alias("d")).collect()
    assert all(r["w"] * r["d"] == pytest.approx(1.0) for r in width)


# -------------------------------------------------------------------- models
def test_boosted_trees_and_artifacts(spark, labelled, tmp_path):
    inputs = prep.preprocessing(prep.fit_scaling(labelled))
    model = models.fit_boosted(labelled, "Class", "id", inputs, 3)
    scored = models.fraud_probability(model, labelled)
    assert scored.count() == 2000 and scored.where("not risk between 0 and 1").isEmpty()
    means = {r["Class"]: r["m"] for r in scored.groupBy("Class").agg(F.avg("risk").alias("m")).collect()}
    assert means[1] > means[0] + 0.1
    saved = artifacts.save_model(spark, model, str(tmp_path / "m"), {"trees": 3, "bad": float("nan")}, prep.RAW_FEATURES)
    assert saved["bad"] is None and saved["model_version"].endswith(saved["model_sha256"][:8])
    loaded, metadata = artifacts.load_model(spark, str(tmp_path / "m"), prep.RAW_FEATURES)
    assert metadata == saved
    assert models.fraud_probability(loaded, labelled).select("id", "risk").exceptAll(scored.select("id", "risk")).isEmpty()
    with pytest.raises(ValueError, match="input features"):
        artifacts.load_model(spark, str(tmp_path / "m"), prep.RAW_FEATURES[:-1])
    with pytest.raises(ValueError, match="set by saving itself"):
        artifacts.save_model(spark, model, str(tmp_path / "n"), {"model_version": "x"}, prep.RAW_FEATURES)
    (tmp_path / "m" / "model" / "more").write_text("changed")
    with pytest.raises(ValueError, match="SHA-256.*added more; input features differ: lacking"):
        artifacts.load_model(spark, str(tmp_path / "m"), prep.RAW_FEATURES[:-1])


def test_out_of_fold_scores_every_row_once(labelled):
    inputs = Pipeline(stages=[VectorAssembler(inputCols=["V3", "V10"], outputCol="features")])
    scored = models.out_of_fold(labelled.select("id", "V3", "V10", "Class"), "Class", "id", inputs, 2, 2)
    assert scored.count() == 2000 and scored.select("id").distinct().count() == 2000


@pytest.mark.parametrize("trees,sample_rows", [(40, 256), (200, 16)])
def test_isolation_forest_separates(labelled, trees, sample_rows):
    x = forest.vector(prep.V_COLUMNS)
    normal = prep.normal_only(labelled)
    fitted = forest.fit_forest(normal, "id", x, trees=trees, sample_rows=sample_rows)
    assert fitted.nodes["tree"].nunique() == trees
    scored = forest.forest_risk(fitted, normal, labelled, x).cache()
    risks = {r["Class"]: r["m"] for r in scored.groupBy("Class").agg(F.avg("risk").alias("m")).collect()}
    assert risks[1] > 0.9 and 0.4 < risks[0] < 0.6
    again = forest.fit_forest(normal.repartition(5), "id", x, trees=trees, sample_rows=sample_rows)
    assert again.nodes.sort_values(["tree", "node"]).reset_index(drop=True).equals(fitted.nodes.sort_values(["tree", "node"]).reset_index(drop=True))


def test_no_normal_rows_is_an_error(labelled):
    with pytest.raises(ValueError, match="no normal"):
        prep.normal_only(labelled.where("Class = 1"))
