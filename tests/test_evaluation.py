import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluation as E
from riskloom.operators import policy as P
from riskloom.operators import ranking as K


def frame(spark, y, s, amount=None):
    amount = amount or [0.0] * len(y)
    rows = [(i, int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, s, amount))]
    return spark.createDataFrame(rows, "id bigint, y int, s double, amount double").repartition(3)


HAND = ([0, 0, 1, 1, 0, 1], [0.1, 0.95, 0.99, 0.5, 0.2, 0.999], [10, 20, 300, 100, 5, 600])


def test_confusion_by_hand(spark):
    df = frame(spark, *HAND)
    assert tuple(E.confusion_at(df, "s", "y", 0.9).first()) == (2, 1, 1, 2)
    row = E.threshold_table(df, "s", "y", [0.9], "amount").first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"], row["flagged"]) == (2, 1, 1, 2, 3)
    assert row["precision"] == row["recall"] == pytest.approx(2 / 3)
    assert row["alerts_per_fraud"] == 1.5 and row["fraud_amount_caught_pct"] == pytest.approx(90)


def test_nothing_flagged(spark):
    row = E.threshold_table(frame(spark, *HAND), "s", "y", [1.5]).first()
    assert row["flagged"] == 0 and row["precision"] is None and row["recall"] == 0 and row["alerts_per_fraud"] is None


def test_budget_by_hand(spark):
    df = frame(spark, [0, 1, 0, 1, 1, 0, 0, 0, 0, 0], [0.1, 0.9, 0.8, 0.7, 0.2, 0.3, 0.05, 0.01, 0.02, 0.03])
    row = E.budget_table(df, "s", "y", "id", [0.3]).first()
    assert (row["alerts"], row["tp"]) == (3, 2)
    assert row["precision"] == row["recall"] == pytest.approx(2 / 3)


def test_budget_rounds_half_to_even_and_breaks_ties_by_row(spark):
    y = [1, 0, 1, 0, 1, 0, 0, 0, 0, 0]
    df = frame(spark, y, [0.5] * 10)
    rows = {r["budget_pct"]: r for r in E.budget_table(df, "s", "y", "id", [0.25, 0.35, 0.05, 1.0]).collect()}
    assert [rows[b]["alerts"] for b in (25.0, 35.0, 5.0, 100.0)] == [2, 4, 0, 10]
    assert [rows[b]["tp"] for b in (25.0, 35.0, 5.0, 100.0)] == [1, 2, 0, 3]
    assert rows[5.0]["precision"] is None


def slow_ap(y, s):
    total, out = sum(y), 0.0
    for cut in sorted(set(s), reverse=True):
        hit = [a for a, b in zip(y, s) if b >= cut]
        new = sum(a for a, b in zip(y, s) if b == cut)
        out += new / total * sum(hit) / len(hit)
    return out


def slow_auc(y, s):
    pairs = [(a, b) for a, la in zip(s, y) if la for b, lb in zip(s, y) if not lb]
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)


def test_metrics_against_brute_force_with_a_third_tied(spark):
    rng = random.Random(1)
    y = [int(rng.random() < 0.2) for _ in range(300)]
    s = [0.5 if rng.random() < 0.34 else round(rng.random() + 0.2 * a, 2) for a in y]
    row = E.metrics(frame(spark, y, s), "s", "y").first()
    assert row["pr_auc"] == pytest.approx(slow_ap(y, s)) and row["roc_auc"] == pytest.approx(slow_auc(y, s))
    recalls = [r["recall"] for r in E.curve(frame(spark, y, s), "s", "y").orderBy("score").collect()]
    assert recalls == sorted(recalls, reverse=True) and recalls[0] == 1.0


def test_inputs_are_refused(spark):
    with pytest.raises(ValueError, match="neither 0 .normal. nor 1"):
        E.check_inputs(frame(spark, [0, 2], [0.1, 0.2]), "y")
    with pytest.raises(ValueError, match="both normal and fraud"):
        E.check_inputs(frame(spark, [1, 1], [0.1, 0.2]), "y")
    with pytest.raises(ValueError, match="s contains"):
        E.check_inputs(frame(spark, [0, 1], [float("nan"), 0.2]), "y", "s")
    with pytest.raises(ValueError, match="at least one fraud"):
        E.check_inputs(frame(spark, [0, 0], [0.1, 0.2]), "y", both=False)


def test_calibration(spark):
    reference = spark.range(1001).select((F.col("id") * 0.2 / 1000 - 0.6).alias("raw"))
    asked = spark.createDataFrame([(-1e9,), (1e9,), (-0.5,)], "raw double")
    got = {r["raw"]: r["risk"] for r in E.calibrated(reference, asked, "raw").collect()}
    assert got[-1e9] == 1.0 and got[1e9] == 0.0 and got[-0.5] == pytest.approx(0.5, abs=0.01)
    with pytest.raises(Exception, match="NaN or infinite"):
        E.calibrated(reference, spark.createDataFrame([(float("nan"),)], "raw double"), "raw").collect()


def test_bootstrap_is_reproducible_and_brackets_the_estimate(spark):
    rng = random.Random(2)
    y = [int(i < 40) for i in range(400)]
    df = frame(spark, y, [rng.random() + 0.3 * a for a in y])
    one = [r["pr_auc"] for r in E.bootstrap_replicates(df, "s", "y", "id", 20, 1).orderBy("replicate").collect()]
    two = [r["pr_auc"] for r in E.bootstrap_replicates(df.repartition(7), "s", "y", "id", 20, 1).orderBy("replicate").collect()]
    assert one == pytest.approx(two) and len(set(one)) > 1
    estimate = E.metrics(df, "s", "y").first()["pr_auc"]
    assert min(one) < estimate < max(one)
    cheap = E.interval(E.poisson_replicates(df, "s", "y", "id", 20, 1)).first()
    assert cheap["low"] < estimate < cheap["high"]


def test_positions_totals_and_quantiles(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), (F.col("id") % 3).alias("g")).repartition(9)
    assert [r["position"] for r in K.row_index(df, ["v"]).orderBy("v").collect()] == list(range(1000))
    within = K.row_index_within(df, ["g"], ["v"])
    per = within.groupBy("g").agg(F.max("position").alias("m"), F.count_distinct("position").alias("n")).collect()
    assert all(r["m"] + 1 == r["n"] for r in per)
    totals = K.running_totals(df, ["v"], {"t": "v"}).orderBy("v").collect()
    assert [r["t"] for r in totals][-1] == 999 * 500 and totals[4]["t"] == 10
    q = K.exact_quantiles(df, "v", {"low": 0.0, "mid": 0.5, "odd": 0.333, "top": 1.0}).first()
    assert tuple(q) == pytest.approx((0, 499.5, 332.667, 999))
    assert [r.g for r in K.hot_keys(df.select(F.col("g").cast("string").alias("g")), "g", 333).collect()] == ["0"]


def test_bracketed_quantiles_equal_the_exact_aggregate(spark):
    """A group large enough to be bracketed, with a third of its rows on one value, and a small one."""
    v = F.when(F.col("id") % 3 == 0, 500.0).otherwise(F.round(F.rand(1) * F.rand(2) * 1e6, 1))
    big = spark.range(150_000).select(F.lit("big").alias("g"), v.alias("v"))
    df = big.unionByName(spark.range(1000).select(F.lit("small").alias("g"), (F.col("id") * 1.5).alias("v"))).cache()
    ps = {"a": 0.0, "b": 0.0001, "c": 0.25, "d": 0.5, "e": 0.75, "f": 0.9999, "h": 1.0}
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, ps.values()))).alias("q")).collect()}
    got = {r["g"]: list(r)[1:] for r in K.exact_quantiles(df, "v", ps, ["g"]).collect()}
    for g in want:
        assert got[g] == pytest.approx(want[g])
    alone = K.exact_quantiles(df.where("g = 'big'"), "v", {"d": 0.5, "e": 0.75}).first()
    assert tuple(alone) == pytest.approx((want["big"][3], want["big"][4]))
    kept = K._near_quantiles(df.where("g = 'big'"), "v", [0.5, 0.75], ["g"])
    assert kept.count() == 150_000 and kept.select("v").distinct().count() < 1000


# -------------------------------------------------------------------- policy
POLICY = ([0, 0, 0, 0, 1, 1], [0.1, 0.5, 0.96, 0.995, 0.97, 0.999], [10, 10, 10, 10, 100, 200])


def test_policy_by_hand(spark):
    df, per = frame(spark, *POLICY), 100_000 / 6
    table = P.policy_costs(df, "y", "s", "amount", P.Costs(), [0.95, 0.98], [0.99, None])
    rows = {(r["review_threshold"], r["block_threshold"]): r for r in table.collect()}
    assert rows[0.95, None]["review_rate"] == pytest.approx(4 / 6)
    assert rows[0.95, None]["cost_per_100k"] == pytest.approx(20 * per)
    both = rows[0.98, 0.99]
    assert both["block_cost"] == pytest.approx(50 * per) and both["missed_fraud_cost"] == pytest.approx(115 * per)
    assert both["fraud_stopped"] == 0.5 and both["fraud_loss_stopped"] == pytest.approx(215 / 330)
    assert len(rows) == 4
    assert P.approve_all_cost(df, "y", "amount", P.Costs()).first()[0] == pytest.approx(330 * per)


def test_choice(spark):
    rows = [(0.98, None, 0.021, 0.0, 100.0), (0.99, None, 0.011, 0.0, 100.5), (0.99, 0.999, 0.010, 0.001, 99.0), (0.995, None, 0.005, 0.0, 130.0)]
    table = spark.createDataFrame(rows, "review_threshold double, block_threshold double, review_rate double, block_rate double, cost_per_100k double")
    pick = lambda **k: tuple(P.choose_thresholds(table, **k).first())[:2]
    assert pick(capacity=0.02, tolerance=0.0) == (0.99, 0.999)
    assert pick(capacity=0.02, tolerance=0.02) == (0.99, None)
    with pytest.raises(Exception, match="no policy reviews at most"):
        P.choose_thresholds(table, 0.001).collect()


def test_grids():
    assert len(P.PROBABILITY_GRID) == 108 and P.PROBABILITY_GRID[0] == 0.001 and P.PROBABILITY_GRID[-1] == 0.99
    assert len(P.PERCENTILE_GRID) == 100 and P.PERCENTILE_GRID[-1] == 0.999


def test_running_totals_in_many_blocks(spark):
    """Ties in the block column, nulls, groups without a key and both directions against plain sums."""
    rows = [(g, None if i % 97 == 0 else float((i * 7919) % 1500), i, i % 5) for i in range(3000) for g in ("a", None)][:-7]
    df = spark.createDataFrame(rows, "g string, v double, id long, w long")
    for down in (False, True):
        want, total = {}, {}
        for g, v, i, w in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0.0), r[2]), reverse=down):
            total[g] = total.get(g, 0) + w
            want[g, i] = total[g]
        got = K.running_totals(df, [c.desc() if down else c for c in (F.col("v"), F.col("id"))], {"t": "w"}, ["g"])
        assert {(r["g"], r["id"]): r["t"] for r in got.collect()} == want
    assert K.running_totals(df.limit(0), ["v"], {"t": "w"}).count() == 0


def test_totals_are_carried_over_batches_and_groups(spark):
    """Partitions that hold several groups, groups that hold several partitions and batches; sums of doubles."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    df = spark.range(5_000).select("id", F.when(F.col("id") < 3_000, -1).otherwise(F.col("id") % 40).alias("g"), (F.col("id") / 8).alias("w"))
    spark.conf.set(key, "37")
    try:
        got = {r["id"]: r["t"] for r in K.running_totals(df, ["id"], {"t": "w"}, ["g"]).collect()}
    finally:
        spark.conf.set(key, kept)
    want, total = {}, {}
    for i in range(5_000):
        g = -1 if i < 3_000 else i % 40
        want[i] = total[g] = total.get(g, 0) + i / 8
    assert got == want
    with pytest.raises(ValueError, match="integers or doubles"):
        K.running_totals(df.select("id", F.col("g").cast("decimal(9,2)").alias("g")), ["id"], {"t": "g"})


def test_average_precision_moves_scores_once(spark):
    df = spark.range(10_000).select((F.col("id") % 977 / 977).alias("s"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    ranked = E.ranked_scores(E.per_score(df, "s", "y"))
    plan = ranked._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    # After the sort only the heads of blocks are grouped and put in order.
    executed = ranked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(score" not in executed and "rangepartitioning" not in executed
