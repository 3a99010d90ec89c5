"""The batch job and the log by time."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from riskloom.operators import batch
from riskloom.operators import decisions as D

EVENT = "transaction_id string, card_id string, Amount double, country string, arrival_us bigint, sequence bigint"
DAY = 86_400_000_000
START = 1_704_067_200_000_000  # 2024-01-01


def events(spark, *rows):
    return spark.createDataFrame([(i, c, a, p, START + at, n) for n, (i, c, a, p, at) in enumerate(rows)], EVENT)


def run(df, path, batch_id=1):
    model = F.least(F.col("Amount") / 100, F.lit(1.0))
    return batch.run_batch(df, path, batch_id, model, scored_at=F.timestamp_micros("arrival_us")).first().asDict()


def test_a_batch_is_collapsed_counted_and_replaced(spark, tmp_path):
    rows = events(spark, ("a", "x", 10.0, "GB", 0), ("a", "x", 10.0, "GB", 60_000_000), ("b", "x", 99.0, None, 30_000_000), ("c", None, 30.0, "GB", 5))
    for _ in range(2):
        report = run(rows, f"{tmp_path}/log")
    assert report == {"batch_id": 1, "received": 4, "repeated": 1, "scored": 3, "approve": 1, "review": 1, "block": 1}
    log = {r.transaction_id: r for r in D.current_since(spark, f"{tmp_path}/log").collect()}
    assert len(log) == 3 and log["a"].velocity_count_1h == 2 and log["c"].velocity_count_1h is None


@pytest.mark.parametrize(
    ("rows", "why"),
    [
        ([], "without transactions"),
        ([("a", "x", 1.0, "GB", 0), ("a", "x", 2.0, "GB", 1)], "1 ids of two events, such as a"),
        ([("a", "x", float("nan"), "GB", 0)], "1 amounts that can't be"),
        ([("a", "x", None, "GB", 0)], "1 amounts"),
        ([("a", "x", -1.0, "GB", 0)], "1 amounts"),
        ([(None, "x", 1.0, "GB", 0)], "1 rows without an id"),
    ],
)
def test_a_bad_batch_is_refused_whole(spark, tmp_path, rows, why):
    with pytest.raises(ValueError, match=why):
        run(events(spark, *rows) if rows else spark.createDataFrame([], EVENT), f"{tmp_path}/log")
    assert not (tmp_path / "log").exists()


def test_a_view_by_time_opens_the_files_of_its_days(spark, tmp_path):
    path = f"{tmp_path}/log"
    run(events(spark, *((f"t{d}", "x", 10.0, "GB", d * DAY + 7) for d in range(5))), path, 1)
    run(events(spark, ("t0", "x", 50.0, "GB", 4 * DAY), ("t4", "x", 60.0, "GB", 9)), path, 2)
    since = datetime(2024, 1, 4, tzinfo=timezone.utc)
    found = D.current_since(spark, path, since)
    assert {(r.transaction_id, r.risk_score) for r in found.collect()} == {("t3", 0.1), ("t4", 0.1), ("t0", 0.5)}
    whole = D.latest_decisions(D.read_log(spark, path)).where(F.col("scored_at") >= F.lit(since))
    assert sorted(map(str, whole.collect())) == sorted(map(str, found.collect()))
    plan = D.read_log(spark, path, since)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "day#" in plan
    with pytest.raises(ValueError, match="time zone"):
        D.read_log(spark, path, datetime(2024, 1, 4))
