import json
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions.rules import Thresholds
from riskloom.operators import decisions as D
from riskloom.operators import rollups as O
from riskloom.operators import velocity as V
from riskloom.operators.prep import RAW_FEATURES
from riskloom.sources import messages as M
from riskloom.streaming import jobs as J
from riskloom.streaming.state import CardActivity

BASE = 1_800_000_000


def stub():
    return F.least(F.col("Amount") / 100, F.lit(1.0))


def message(n, ident, amount, card, at, partition=0, country="GB", raw=None):
    doc = {"transaction_id": ident, **{name: 0.0 for name in RAW_FEATURES}, "Amount": amount, "card_id": card, "country": country}
    value = json.dumps(doc).encode() if raw is None else raw
    return (ident.encode(), value, "transactions", partition, n, at)


def write_messages(spark, path, rows):
    schema = "key binary, value binary, topic string, partition int, offset bigint, at double"
    df = spark.createDataFrame(rows, schema).withColumn("timestamp", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    df.drop("at").coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.05)


class Pipeline:
    def __init__(self, spark, root, **job):
        self.spark, self.root = spark, root
        self.job = J.ScoringJob(stub(), Thresholds(0.24, 0.95), "v-test", **job)

    def run(self, name="a"):
        r = self.root
        source = M.file_stream(self.spark, f"{r}/in")
        J.start_ingest(source, f"{r}/clean-{name}", J.folder_writer(f"{r}/dead-{name}"), f"{r}/cp1-{name}", f"{r}/stats1-{name}").awaitTermination()
        J.start_scoring(
            self.spark, f"{r}/clean-{name}", self.job, J.decision_log(f"{r}/log-{name}"), f"{r}/cp2-{name}", f"{r}/stats2-{name}"
        ).awaitTermination()
        return D.latest_decisions(self.spark.read.parquet(f"{r}/log-{name}"))


def test_cycle_restart_and_replay(spark, tmp_path):
    root = str(tmp_path)
    write_messages(spark, f"{root}/in", [
        message(0, "tx-1", 10.0, "card-a", BASE + 0.0),
        message(1, "tx-2", 50.0, "card-a", BASE + 1.0, country="NG"),
        message(2, "bad", 1.0, None, BASE + 1.5, raw=b"not json"),
        message(3, "tx-1", 99.0, "card-a", BASE + 2.0),
        message(4, "tx-3", 5.0, None, BASE + 3.0),
    ])
    pipe = Pipeline(spark, root)
    first = {r["transaction_id"]: r for r in pipe.run().collect()}
    assert set(first) == {"tx-1", "tx-2", "tx-3"}
    assert first["tx-1"]["decision"] == "block" and first["tx-1"]["risk_score"] == pytest.approx(0.99)
    assert first["tx-1"]["velocity_count_1h"] == 2 and first["tx-1"]["velocity_seconds_since_previous"] == 1.0
    assert first["tx-1"]["reasons"] == ["back_to_back"] and first["tx-1"]["velocity_countries_1h"] == 2
    assert first["tx-2"]["velocity_count_1h"] == 1 and first["tx-2"]["velocity_seconds_since_previous"] is None
    assert first["tx-3"]["velocity_count_1h"] is None and first["tx-3"]["decision"] == "approve"
    letters = spark.read.parquet(f"{root}/dead-a").select(M.header(F.col("headers"), M.REASON), "value").collect()
    assert [(r[0], bytes(r[1])) for r in letters] == [("Invalid JSON", b"not json")]
    stats = O.cumulative_stats(spark.read.parquet(f"{root}/stats1-a")).first()
    assert (stats["consumed"], stats["scored"], stats["dead_lettered"], stats["duplicates"]) == (5, 3, 1, 1)
    recorded = O.cumulative_stats(spark.read.parquet(f"{root}/stats2-a")).first()
    assert (recorded["scored"], recorded["approve"], recorded["review"], recorded["block"]) == (3, 1, 1, 1)

    # A restart with nothing new reads nothing again.
    assert pipe.run().count() == 3
    assert spark.read.parquet(f"{root}/stats1-a").count() == 1

    # State carries over: the next batch of the card sees what came before.
    write_messages(spark, f"{root}/in", [message(5, "tx-4", 7.0, "card-a", BASE + 30.0), message(6, "tx-2", 50.0, "card-a", BASE + 40.0, country="NG")])
    again = {r["transaction_id"]: r for r in pipe.run().collect()}
    assert again["tx-4"]["velocity_count_1m"] == 3 and again["tx-4"]["velocity_amount_1h"] == 156.0
    # tx-2 delivered again moves in time and is counted once.
    assert again["tx-2"]["velocity_count_1h"] == 3 and len(again) == 4

    # A new checkpoint replays everything and ends with the same rows.
    replayed = {r["transaction_id"]: r for r in pipe.run("b").collect()}
    assert {k: (v["risk_score"], v["decision"]) for k, v in replayed.items()} == {k: (v["risk_score"], v["decision"]) for k, v in again.items()}


def test_without_velocity_batches_are_still_recorded(spark, tmp_path):
    root = str(tmp_path)
    write_messages(spark, f"{root}/in", [message(0, "tx-1", 10.0, "card-a", BASE + 0.0), message(1, "tx-2", 10.0, "card-a", BASE + 0.5)])
    rows = Pipeline(spark, root, windows=None).run().collect()
    assert {(r["decision"], r["velocity_count_1m"], tuple(r["reasons"])) for r in rows} == {("approve", None, ())}


def test_a_stored_batch_is_replaced_not_doubled(spark, tmp_path):
    batch = spark.createDataFrame(
        [message(0, "tx-1", 10.0, "card-a", 1.0)[:5]], "key binary, value binary, topic string, partition int, offset bigint"
    ).withColumn("timestamp", F.timestamp_seconds(F.lit(BASE)))
    clean, dead = J.folder_writer(f"{tmp_path}/clean"), J.folder_writer(f"{tmp_path}/dead")
    for _ in range(2):
        J.ingest_batch(batch, 7, clean, dead)
    assert spark.read.parquet(f"{tmp_path}/clean").count() == 1


def test_outages_are_waited_out_with_growing_delays():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) <= 7:
            raise ConnectionError("store is away")

    outage = J.record_patiently(flaky, sleep=waits.append, clock=lambda: float(sum(waits)))
    assert waits == [1.0, 2.0, 4.0, 8.0, 15.0, 15.0, 15.0]
    assert outage.count == 1 and outage.seconds == 60.0
    assert J.record_patiently(lambda: None).count == 0


def test_an_endless_outage_leaves_the_batch_uncommitted():
    def down():
        raise ConnectionError("store is away")

    with pytest.raises(ConnectionError):
        J.record_patiently(down, attempts=3, sleep=lambda s: None)
    waits = []
    with pytest.raises(ConnectionError):  # without a limit it goes on until the job is stopped
        J.record_patiently(down, sleep=waits.append, stopped=lambda: len(waits) == 50)
    assert len(waits) == 50


def test_an_error_that_is_no_outage_is_raised_at_once():
    calls = []

    def wrong():
        calls.append(1)
        raise ValueError("a column is missing")

    with pytest.raises(ValueError):
        J.record_patiently(wrong, sleep=lambda s: pytest.fail("it waited"))
    assert calls == [1]


def test_only_passing_errors_are_outages():
    import errno

    assert J.is_away(TimeoutError()) and J.is_away(J.StoreAway("maintenance")) and J.is_away(OSError(errno.ETIMEDOUT, "slow"))
    assert J.is_away(RuntimeError("java.net.ConnectException: refused"))
    for wrong in (PermissionError(errno.EACCES, "no"), FileNotFoundError(errno.ENOENT, "where"), OSError(errno.ENOSPC, "full"), RuntimeError("java.io.IOException: Mkdirs failed")):
        assert not J.is_away(wrong)


def test_a_batch_cut_off_after_publishing_is_handed_over_once(spark, tmp_path):
    """The first query ends between writing its clean rows and Spark noting the batch as done."""
    root = str(tmp_path)
    write_messages(spark, f"{root}/in", [message(0, "tx-1", 10.0, "card-a", BASE + 0.0), message(1, "tx-2", 20.0, "card-a", BASE + 5.0)])
    pipe = Pipeline(spark, root)
    publish = J.publish_once(f"{root}/clean-a", f"{root}/cp1-a")

    def run(batch, batch_id):
        J.ingest_batch(batch, batch_id, publish, J.folder_writer(f"{root}/dead-a"))
        raise RuntimeError("cut off")

    cut = M.file_stream(spark, f"{root}/in").writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/cp1-a").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="cut off"):
        cut.awaitTermination()
    scored = lambda: J.start_scoring(spark, f"{root}/clean-a", pipe.job, J.decision_log(f"{root}/log-a"), f"{root}/cp2-a", f"{root}/stats2-a").awaitTermination()
    scored()  # the second query reads what was published before the first one starts again
    write_messages(spark, f"{root}/in", [message(2, "tx-3", 30.0, "card-a", BASE + 9.0)])
    rows = {r["transaction_id"]: r for r in pipe.run().collect()}
    assert spark.read.parquet(f"{root}/clean-a").count() == 3
    assert O.cumulative_stats(spark.read.parquet(f"{root}/stats2-a")).first()["scored"] == 3
    assert [rows[f"tx-{n}"]["velocity_count_1h"] for n in (1, 2, 3)] == [1, 2, 3]


def test_another_checkpoint_publishes_its_own_batches(spark, tmp_path):
    root = str(tmp_path)
    write_messages(spark, f"{root}/in", [message(0, "tx-1", 10.0, None, BASE + 0.0)])
    for name in ("a", "b"):
        source = M.file_stream(spark, f"{root}/in")
        J.start_ingest(source, f"{root}/clean", J.folder_writer(f"{root}/dead-{name}"), f"{root}/cp-{name}").awaitTermination()
    assert spark.read.parquet(f"{root}/clean").select("transaction_id", "run").distinct().count() == 2


@pytest.mark.parametrize("most", ["7", "10000"])
def test_a_card_in_several_pieces_and_batches_equals_the_batch_operator(spark, tmp_path, most):
    """Rows of a micro-batch come in no order and in pieces of `most`; four micro-batches follow each other in time."""
    import random

    rng = random.Random(9)
    at, events = BASE * 1_000_000, []
    for n in range(400):
        at += rng.choice([0, 500_000, 20_000_000, 400_000_000])
        events.append((f"tx-{n}", float(rng.randint(0, 5000)) / 100, rng.choice(["card-a", "card-a", "card-b", f"card-{n}", None]), rng.choice(["GB", "NG", None]), at, n))
    names = "transaction_id string, Amount double, card_id string, country string, arrival_us bigint, sequence bigint"
    windows = V.VelocityWindows(keep=20)
    want = {r[0]: tuple(r)[1:] for r in flat(V.measure(spark.createDataFrame(events, names), windows))}
    for k in range(4):
        part = events[100 * k : 100 * k + 100]
        rng.shuffle(part)
        rows = spark.createDataFrame(part, names).withColumns({c: F.lit(0.0) for c in RAW_FEATURES if c != "Amount"} | {c: F.lit(None).cast("string") for c in J.contract.ENTITIES if c not in ("card_id", "country")})
        rows.select(*J.CLEAN_SCHEMA.fieldNames()).coalesce(1).write.parquet(f"{tmp_path}/clean/run=x/batch_id={k}")
        time.sleep(0.05)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    try:
        job = J.ScoringJob(stub(), windows=windows)
        J.start_scoring(spark, f"{tmp_path}/clean", job, J.decision_log(f"{tmp_path}/log"), f"{tmp_path}/cp", files_per_batch=1).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.select("batch_id").distinct().count() == 4
    got = {r[0]: tuple(r)[1:] for r in log.select("transaction_id", *(f"velocity_{n}" for n in V.FEATURES)).collect()}
    assert got == want


def flat(measured):
    return V.flatten(measured).select("transaction_id", *(f"velocity_{n}" for n in V.FEATURES)).collect()


def test_the_state_of_an_idle_card_is_given_up(spark, tmp_path):
    """A card idle for the longest window and the allowed delay has no state left, and no answer changes by it."""
    events = [("tx-0", "card-idle", 0), ("tx-1", "card-busy", 5), ("tx-2", "card-busy", 3000), ("tx-3", "card-busy", 9000), ("tx-4", "card-busy", 9030), ("tx-5", "card-idle", 9040)]
    names = "transaction_id string, card_id string, Amount double, country string, arrival_us bigint, sequence bigint"
    rows = spark.createDataFrame([(i, c, 1.0, "GB", (BASE + s) * 1_000_000, n) for n, (i, c, s) in enumerate(events)], names)
    want = {r[0]: tuple(r)[1:] for r in flat(V.measure(rows))}
    filled = rows.withColumns({c: F.lit(0.0) for c in RAW_FEATURES if c != "Amount"} | {c: F.lit(None).cast("string") for c in J.contract.ENTITIES if c not in ("card_id", "country")})
    kept = {}
    for late in (None, 60.0):
        root = f"{tmp_path}/{late}"
        for k in range(len(events) - (late is not None)):
            filled.where(F.col("sequence") == k).select(*J.CLEAN_SCHEMA.fieldNames()).coalesce(1).write.mode("overwrite").parquet(f"{root}/clean/run=x/batch_id={k}")
            time.sleep(0.02)
        job = J.ScoringJob(stub(), late_seconds=late)
        J.start_scoring(spark, f"{root}/clean", job, J.decision_log(f"{root}/log"), f"{root}/cp", files_per_batch=1).awaitTermination()
        got = {r[0]: tuple(r)[1:] for r in spark.read.parquet(f"{root}/log").select("transaction_id", *(f"velocity_{n}" for n in V.FEATURES)).collect()}
        assert got == {k: v for k, v in want.items() if k in got} and len(got) == len(events) - (late is not None)
        kept[late] = {r[0] for r in spark.read.format("statestore").load(f"{root}/cp").select("key.card_id").collect()}
    assert kept == {None: {"card-idle", "card-busy"}, 60.0: {"card-busy"}}


def test_recording_retries_inside_a_batch(spark, tmp_path):
    rows = spark.createDataFrame([("tx-1", 10.0, None)], "transaction_id string, Amount double, card_id string")
    tries = []

    def record(df, batch_id):
        tries.append(batch_id)
        if len(tries) < 3:
            raise ConnectionError("store is away")
        D.append_batch(df, f"{tmp_path}/log", batch_id)

    job = J.ScoringJob(stub(), sleep=lambda s: None)
    J.record_batch(V.without_velocity(rows), 4, job, record, f"{tmp_path}/stats")
    assert tries == [4, 4, 4]
    stats = O.outage_totals(spark.read.parquet(f"{tmp_path}/stats")).first()
    assert stats["outages"] == 1
    assert spark.read.parquet(f"{tmp_path}/log").count() == 1


def test_state_equals_the_batch_operator(spark):
    """The streaming state on its own, against the window expression, event by event."""
    import random

    rng = random.Random(5)
    windows = V.VelocityWindows(short=60, middle=300, long=3600, keep=5)
    at, events = BASE * 1_000_000, []
    for n in range(200):
        at += rng.choice([0, 500_000, 20_000_000, 400_000_000, 3_600_000_000])
        events.append((f"tx-{n}", "card-a", rng.randint(0, 5000) / 100, rng.choice(["GB", "NG", None]), at, n))
    df = spark.createDataFrame(events, "transaction_id string, card_id string, Amount double, country string, arrival_us bigint, sequence bigint")
    batch = {r["transaction_id"]: tuple(r)[1:] for r in V.flatten(V.measure(df, windows)).select("transaction_id", *(f"velocity_{n}" for n in V.FEATURES)).collect()}
    names = ["transaction_id", "card_id", "Amount", "country", "arrival_us", "sequence"]
    for shuffled in (False, True):
        whole = pd.DataFrame(events, columns=names)
        if shuffled:  # late within a batch of rows, never across: each row still sees all that came before it
            whole = pd.concat([whole.iloc[i : i + 40].sample(frac=1, random_state=1) for i in range(0, 200, 40)])
        activity, state, got = CardActivity(windows, names), FakeState(), {}
        for i in range(0, 200, 40):
            for part in activity(("card-a",), iter([whole.iloc[i : i + 40].reset_index(drop=True)]), state):
                got |= {r[0]: r[len(names) :] for r in part.itertuples(index=False)}
        assert {k: tuple(None if x != x else x for x in v) for k, v in got.items()} == batch


class FakeState:
    """What Spark hands a stateful function, without Spark."""

    hasTimedOut = False

    def __init__(self):
        self.value = None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def setTimeoutTimestamp(self, at):
        self.timeout = at

    def getCurrentWatermarkMs(self):
        return 0


def activity_of(*batches, windows=V.VelocityWindows(), late_us=None):
    """Features by id after each batch of (id, seconds, amount, country)."""
    names = ["transaction_id", "Amount", "country", "arrival_us", "sequence"]
    activity, state, got = CardActivity(windows, names, late_us), FakeState(), {}
    for n, rows in enumerate(batches):
        frame = pd.DataFrame([(i, a, c, int(s * 1e6), 10 * n + k) for k, (i, s, a, c) in enumerate(rows)], columns=names)
        for part in activity(("card",), iter([frame]), state):
            got |= {r[0]: tuple(None if x != x else x for x in r[5:]) for r in part.itertuples(index=False)}
    return got, state


def test_a_late_event_sees_nothing_later():
    got, _ = activity_of([("a", 40, 1.0, "GB"), ("b", 100, 2.0, "NG")], [("late", 50, 4.0, "GB")], [("c", 101, 8.0, None)])
    assert got["late"] == (2, 2, 2, 5.0, 1, 10.0)
    assert got["c"] == (3, 4, 4, 15.0, 2, 1.0)
    assert activity_of([("b", 100, 2.0, "NG")], [("late", 50, 4.0, "GB")])[0]["late"] == (1, 1, 1, 4.0, 1, None)


def test_a_delivery_again_counts_once_and_moves():
    got, _ = activity_of([("a", 10, 1.0, "GB"), ("b", 20, 2.0, "GB")], [("a", 30, 1.0, "GB")], [("c", 40, 3.0, "GB")])
    assert got["a"] == (2, 2, 2, 3.0, 1, 10.0) and got["c"] == (3, 3, 3, 6.0, 1, 10.0)


def test_a_stop_of_the_job_loses_no_history():
    """Expiry is by event time or not at all; how long the job stood still has no part in it."""
    _, state = activity_of([("a", 10, 1.0, "GB")])
    assert not hasattr(state, "timeout")
    _, state = activity_of([("a", 10, 1.0, "GB")], late_us=5_000_000)
    assert state.timeout == 10_000 + 5_000 + 3_600_000


def test_the_newest_events_are_kept():
    windows = V.VelocityWindows(keep=4)
    _, state = activity_of([(f"e{i}", i, 1.0, "GB") for i in range(10)], windows=windows)
    assert state.get[2] == ["e6", "e7", "e8", "e9"]


def test_positions_from_progress(spark):
    progress = {"sources": [{"endOffset": '{"transactions":{"0":7,"1":4}}', "latestOffset": {"transactions": {"0": 12}}}]}
    positions = J.positions_from_progress(spark, progress)
    assert {r["partition"]: r["lag"] for r in M.lag(positions).collect()} == {0: 5, 1: None}
    assert M.total_lag(positions).first()[0] is None




def test_a_row_passes_the_state_as_one_text(spark, tmp_path):
    """A call per card costs by its columns: only those that are measured go beside the text."""
    spark.createDataFrame([], J.CLEAN_SCHEMA).write.parquet(f"{tmp_path}/clean")
    rows = spark.readStream.schema(J.CLEAN_SCHEMA).parquet(f"{tmp_path}/clean")
    measured = J.live_velocity(rows, V.VelocityWindows())
    (step,) = [line for line in measured._jdf.queryExecution().analyzed().toString().split("\n") if "FlatMapGroupsInPandasWithState" in line]
    assert "_row#" in step and "V28#" not in step
    assert measured.columns == [*rows.columns, "velocity"]


def test_large_batches_are_dealt_out_and_sound_messages_drop_their_bytes(spark, tmp_path, monkeypatch):
    """One file of many messages is several tasks' work, and only refused letters are kept with their bytes."""
    rows = [message(n, f"tx-{n}", 10.0, "card-a", float(n), raw=b"not json" if n % 10 == 0 else None)[:5] for n in range(100)]
    batch = spark.createDataFrame(rows, "key binary, value binary, topic string, partition int, offset bigint").withColumn("timestamp", F.timestamp_seconds(F.lit(BASE))).coalesce(1)
    monkeypatch.setattr(J, "MESSAGES_PER_TASK", 30)
    seen, dead_letters = [], M.dead_letters

    def kept(refused):
        seen.append(refused.rdd.getNumPartitions())
        return dead_letters(refused)

    monkeypatch.setattr(J.msg, "dead_letters", kept)
    J.ingest_batch(batch, 0, J.folder_writer(f"{tmp_path}/clean"), J.folder_writer(f"{tmp_path}/dead"), f"{tmp_path}/stats")
    assert seen == [4]
    assert {bytes(r.value) for r in spark.read.parquet(f"{tmp_path}/dead").collect()} == {b"not json"}
    assert spark.read.parquet(f"{tmp_path}/clean").count() == 90
    assert spark.read.parquet(f"{tmp_path}/stats").select("consumed", "scored", "dead_lettered").first()[:] == (100, 90, 10)
