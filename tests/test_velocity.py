import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions import rules as R
from riskloom.operators import scoring as S
from riskloom.operators import velocity as V

NOW = 1_800_000_000
SCHEMA = "transaction_id string, card_id string, Amount double, country string, arrival_us bigint, sequence bigint"


def events(spark, *rows, card="card-a"):
    """(id, seconds after NOW, amount, country)"""
    made = [(i, card, float(a), c, int((NOW + s) * 1_000_000), n) for n, (i, s, a, c) in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA)


def features(df, windows=V.VelocityWindows(), **options):
    rows = V.measure(df, windows, **options).select("transaction_id", "velocity").collect()
    return {r["transaction_id"]: None if r["velocity"] is None else tuple(r["velocity"]) for r in rows}


def test_counts_amounts_countries_and_gap(spark):
    got = features(events(spark, ("a", 0, 10, "GB"), ("b", 30, 20, "GB"), ("c", 45, 5, "NG")))
    assert got["a"] == (1, 1, 1, 10.0, 1, None)
    assert got["c"] == (3, 3, 3, 35.0, 2, 15.0)


def test_window_ends(spark):
    """Shorter windows include an event exactly at their start, the retention does not."""
    got = features(events(spark, ("a", 0, 1, ""), ("b", 60, 1, ""), ("c", 300, 1, ""), ("d", 3600, 1, "")))
    assert got["b"][0] == 2
    assert got["c"][1] == 3
    assert got["d"][2] == 3 and got["d"][4] == 0


def test_one_batch_sees_itself_in_order(spark):
    got = features(events(spark, ("a", 0, 1, None), ("b", 0, 1, None), ("c", 0, 1, None)))
    assert [got[i][2] for i in "abc"] == [1, 2, 3]
    assert [got[i][5] for i in "abc"] == [None, 0.0, 0.0]


def test_retention_and_cap(spark):
    short = V.VelocityWindows(60, 60, 60)
    assert features(events(spark, ("a", 0, 1, ""), ("b", 61, 1, "")), short)["b"][2] == 1
    many = events(spark, *((f"t{i:02d}", i, 1, "") for i in range(20)))
    assert features(many, V.VelocityWindows(keep=5))["t19"][:4] == (5, 5, 5, 5.0)


def test_no_card_means_no_features(spark):
    df = events(spark, ("a", 0, 1, "GB"), ("b", 1, 1, "GB"), card=None)
    assert features(df) == {"a": None, "b": None}


def test_redelivery_moves_an_event(spark):
    df = events(spark, ("a", 0, 1, "GB"), ("a", 5, 1, "GB"), ("b", 6, 1, "GB"), ("b", 7, 2, "GB"))
    once = V.collapse_redeliveries(df)
    assert once.count() == 3
    rows = V.flatten(V.measure(once)).orderBy("arrival_us").collect()
    assert [r["velocity_count_1h"] for r in rows] == [1, 2, 3]
    assert rows[0]["velocity_seconds_since_previous"] is None


def brute(rows, windows):
    """All pairs, for a small fixture."""
    out = {}
    for i, (ident, card, amount, country, us, n) in enumerate(rows):
        if card is None:
            out[ident] = None
            continue
        seen = sorted((r for r in rows if r[1] == card and (r[4], r[5]) <= (us, n)), key=lambda r: (r[4], r[5]))
        kept = [r for r in seen[-windows.keep :] if r[4] > us - windows.long * 1e6]
        since = lambda w: sum(r[4] >= us - w * 1e6 for r in kept)
        previous = kept[-2][4] if len(kept) > 1 else None
        out[ident] = (
            since(windows.short), since(windows.middle), len(kept), sum(round(r[2] * 100) for r in kept) / 100,
            len({r[3] for r in kept if r[3]}), None if previous is None else round((us - previous) / 1e6, 3),
        )
    return out


@pytest.mark.parametrize("hot_rows", [10**6, 50])
def test_against_brute_force_with_a_card_holding_a_third(spark, hot_rows):
    rng = random.Random(3)
    rows, at = [], NOW * 1_000_000
    for n in range(600):
        at += rng.choice([0, 1_000_000, 30_000_000, 200_000_000])
        card = "hot" if n % 3 == 0 else rng.choice([f"card-{i}" for i in range(40)] + [None])
        rows.append((f"tx-{n}", card, rng.randint(0, 9999) / 100, rng.choice(["GB", "NG", "US", None]), at, n))
    windows = V.VelocityWindows(keep=7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert features(df, windows, hot_rows=hot_rows, slice_rows=16) == brute(rows, windows)


def test_members_are_read_from_the_right(spark):
    row = spark.createDataFrame([("od|d|id", 10.0, None)], "i string, a double, c string")
    text = V.member_text(F.col("i"), F.col("a"), F.col("c"))
    parsed = row.select(text.alias("m")).select("m", V.parse_member(F.col("m")).alias("p")).first()
    assert parsed["m"] == "od|d|id|10.00|"
    assert tuple(parsed["p"]) == ("od|d|id", 10.0, "")


def test_windows_are_checked():
    with pytest.raises(ValueError):
        V.VelocityWindows(60, 30, 3600)
    with pytest.raises(ValueError):
        V.VelocityWindows(keep=0)


# ----------------------------------------------------------- rules, decisions
def with_features(spark, *values):
    rows = [(i, None if v is None else v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"n int, velocity {V.VELOCITY_TYPE}").orderBy("n")


def test_rules_fire_just_past_their_limits(spark):
    at = (5, 5, 10, 1.0, 2, 2.0)
    past = [(6, 6, 10, 1.0, 2, 2.0), (5, 5, 11, 1.0, 2, 2.0), (5, 5, 10, 1.0, 3, 2.0), (5, 5, 10, 1.0, 2, 1.9), (6, 6, 11, 1.0, 3, 1.9)]
    df = with_features(spark, at, *past, (1, 1, 1, 1.0, 1, None), None)
    got = [r["r"] for r in df.select("n", R.reasons(R.velocity_rules()).alias("r")).orderBy("n").collect()]
    names = [r.name for r in R.velocity_rules()]
    assert got == [[], [names[0]], [names[1]], [names[2]], [names[3]], names, [], []]


def test_decisions_are_inclusive(spark):
    risks = spark.createDataFrame([(float(r),) for r in (0, 0.2399, 0.24, 0.9499, 0.95, 1)], "r double")
    levels = [x[0] for x in risks.select(R.decide(F.col("r"), R.Thresholds())).collect()]
    assert levels == ["approve", "approve", "review", "review", "block", "block"]
    never = [x[0] for x in risks.select(R.decide(F.col("r"), R.Thresholds(0.24, None))).collect()]
    assert never[-1] == "review"


@pytest.mark.parametrize("pair", [(-0.1, None), (1.1, None), (0.5, 0.4), (0.5, 1.1)])
def test_thresholds_are_checked(pair):
    with pytest.raises(ValueError):
        R.Thresholds(*pair)


def test_rules_only_escalate_approvals(spark):
    busy = (9, 9, 9, 9.0, 1, 100.0)
    rows = [("a", 10.0, "c", busy), ("b", 50.0, "c", busy), ("d", 99.0, "c", busy), ("e", 10.0, "c", None)]
    df = spark.createDataFrame(rows, f"transaction_id string, Amount double, card_id string, velocity {V.VELOCITY_TYPE}")
    out = {r["transaction_id"]: r for r in S.score(df, F.col("Amount") / 100).collect()}
    assert {k: (v["model_decision"], v["decision"]) for k, v in out.items()} == {
        "a": ("approve", "review"), "b": ("review", "review"), "d": ("block", "block"), "e": ("approve", "approve")}
    assert out["d"]["reasons"] == ["many_in_a_minute"] and out["e"]["reasons"] == []
    assert S.score(df.limit(0), F.col("Amount") / 100).count() == 0


def test_batching_does_not_change_answers(spark):
    rows = [(f"t{i}", float(i), "c", None) for i in range(100)]
    df = spark.createDataFrame(rows, f"transaction_id string, Amount double, card_id string, velocity {V.VELOCITY_TYPE}")
    score = lambda d: sorted(map(str, S.score(d, F.col("Amount") / 100).collect()))
    assert score(df.repartition(1)) == score(df.repartition(17))


def test_features_are_attached_one_to_one(spark):
    tx = spark.createDataFrame([("a",), ("b",)], "transaction_id string")
    one = (1, 1, 1, 1.0, 1, None)
    schema = f"transaction_id string, velocity {V.VELOCITY_TYPE}"
    good = spark.createDataFrame([("b", None), ("a", one)], schema)
    got = {r["transaction_id"]: r["velocity"] for r in S.attach_features(tx, good).collect()}
    assert got["b"] is None and tuple(got["a"]) == one
    for bad in ([("a", one)], [("a", one), ("b", one), ("b", one)]):
        with pytest.raises(Exception, match="no single feature row"):
            S.attach_features(tx, spark.createDataFrame(bad, schema)).collect()


def test_too_few_samples_is_an_error(spark):
    scored = spark.createDataFrame([("a", "block")], "transaction_id string, decision string")
    with pytest.raises(ValueError, match="only 1 transactions match"):
        S.first_with_decision(scored, "block", 2, ["transaction_id"])
