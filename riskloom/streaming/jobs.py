"""Messages to recorded decisions, as two streaming queries.

The first checks messages, sets bad ones aside and keeps the last message per id
of each batch; the second measures, scores and records. Each has its own
checkpoint. Dead letters, statistics and decisions are written under their batch
id, so a batch that is run again replaces itself. The clean rows between the two
queries are published once: the second may have read them already.
"""

from __future__ import annotations

import errno
import json
import time
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskloom.functions.rules import KINDS, Rule, Thresholds
from riskloom.operators import contract, decisions
from riskloom.operators.prep import RAW_FEATURES
from riskloom.operators.scoring import RiskProvider, score
from riskloom.operators.velocity import VelocityWindows, without_velocity
from riskloom.sources import messages as msg
from riskloom.streaming.state import ROCKSDB, live_velocity

# Seconds between attempts to record while the store is away; the last one repeats.
RETRY_DELAYS = (1.0, 2.0, 4.0, 8.0, 15.0)
# Fixed value: messages one task checks. Files hold many times that, as JSON packs well.
MESSAGES_PER_TASK = 1 << 16

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField("transaction_id", T.StringType()),
        *(T.StructField(name, T.DoubleType()) for name in RAW_FEATURES),
        *(T.StructField(name, T.StringType()) for name in contract.ENTITIES),
        T.StructField("arrival_us", T.LongType()),
        T.StructField("sequence", T.LongType()),
    ]
)
STATS_SCHEMA = (
    "batch_id bigint, consumed bigint, scored bigint, dead_lettered bigint, duplicates bigint, "
    "approve bigint, review bigint, block bigint, outages int, seconds_waiting double, seconds double"
)

BatchWriter = Callable[[DataFrame, int], None]


def folder_writer(path: str) -> BatchWriter:
    """Writes each batch to its own folder, replacing what an earlier attempt left."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave a query when its checkpoint was made; a restart has the same, a new checkpoint another one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def publish_once(path: str, checkpoint: str) -> BatchWriter:
    """Writes each batch of a query to a hidden folder and then moves it to its place, unless that exists.

    Readers of `path` never see part of a batch, and a batch that is run again after it was published (the process ended
    before Spark noted the batch as done) is not published a second time: it holds the same messages, and a reader that
    tells files by their names would take new ones for new rows. Moving a folder has to be one step in the file system.
    """

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        run = run_id(spark, checkpoint)
        to_path = spark._jvm.org.apache.hadoop.fs.Path
        place = to_path(f"{path}/run={run}/batch_id={batch_id}")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(place):
            return
        hidden = f"{path}/_unpublished/{run}-{batch_id}-{uuid.uuid4().hex}"
        df.write.parquet(hidden)
        files.mkdirs(place.getParent())
        if not files.rename(to_path(hidden), place):
            raise RuntimeError(f"can't publish batch {batch_id} in {path}")

    return write


def kafka_writer(servers: str, topic: str) -> BatchWriter:
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option(
            "includeHeaders", "true"
        ).save()

    return write


def decision_log(path: str) -> BatchWriter:
    return lambda df, batch_id: decisions.append_batch(df, path, batch_id)


# What exceptions of a JVM client are called while a store can't be reached, and system errors that pass.
AWAY = (
    "java.net.ConnectException", "java.net.NoRouteToHostException", "java.net.SocketException", "java.net.SocketTimeoutException",
    "java.net.UnknownHostException", "java.sql.SQLTransient", "java.sql.SQLRecoverable", "java.util.concurrent.TimeoutException",
    "org.apache.hadoop.ipc.RetriableException", "org.apache.hadoop.ipc.StandbyException", "org.apache.hadoop.net.ConnectTimeoutException",
    "org.apache.kafka.common.errors.Retriable", "org.apache.kafka.common.errors.TimeoutException",
)
PASSING = {
    errno.EAGAIN, errno.EBUSY, errno.EHOSTDOWN, errno.EHOSTUNREACH, errno.EINTR, errno.EIO, errno.ENETDOWN, errno.ENETRESET,
    errno.ENETUNREACH, errno.ENOBUFS, errno.ESTALE, errno.ETIMEDOUT,
}


class StoreAway(Exception):
    """What a writer of one's own raises while its store can't be reached."""


def is_away(error: Exception) -> bool:
    """Whether an error says that a store is unavailable, as opposed to refusing the rows or being called wrongly.

    A missing permission or a wrong path is no outage: waiting does not mend it.
    """
    if isinstance(error, (ConnectionError, TimeoutError, StoreAway)) or getattr(error, "errno", None) in PASSING:
        return True
    java = getattr(error, "java_exception", None)
    named = java.toString() if java is not None else str(error)
    return any(name in named for name in AWAY)


@dataclass
class Outage:
    count: int = 0
    seconds: float = 0.0


def record_patiently(
    write: Callable[[], None],
    attempts: int | None = None,
    delays: Sequence[float] = RETRY_DELAYS,
    sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.monotonic,
    away: Callable[[Exception], bool] = is_away,
    stopped: Callable[[], bool] = lambda: False,
) -> Outage:
    """Runs `write` until it succeeds, waiting longer each time, as long as the outage lasts.

    The batch is held meanwhile and the next one is not planned. An error that is
    no outage is raised at once; so is an outage when `stopped` says so or a given
    number of further attempts runs out. Nothing is committed then, and a restart repeats the batch.
    """
    started, failed = clock(), 0
    while True:
        try:
            write()
        except Exception as error:  # noqa: BLE001 - `away` decides
            if not away(error) or failed == attempts or stopped():
                raise
            sleep(delays[min(failed, len(delays) - 1)])
            failed += 1
        else:
            return Outage(1, clock() - started) if failed else Outage()


def _write_stats(spark: SparkSession, path: str, batch_id: int, **numbers) -> None:
    names = [f.split()[0] for f in STATS_SCHEMA.split(", ")]
    row = tuple(batch_id if n == "batch_id" else numbers.get(n, 0.0 if "seconds" in n else 0) for n in names)
    spark.createDataFrame([row], STATS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def dealt(batch: DataFrame) -> DataFrame:
    """A batch whose tasks would have too many messages each, dealt out by their number; others as they are."""
    tasks = -(-batch.count() // MESSAGES_PER_TASK)
    return batch.repartition(tasks, "partition", "offset") if tasks > batch.rdd.getNumPartitions() else batch


def ingest_batch(batch: DataFrame, batch_id: int, clean: BatchWriter, dead: BatchWriter, stats_path: str | None = None) -> None:
    """One batch of raw messages: dead letters are stored first, then the clean rows."""
    started = time.monotonic()
    ok = F.col("problem").isNull()
    # Read by both writes and the counts; only letters that are set aside need their bytes again.
    decoded = contract.decode(dealt(batch)).withColumns({c: F.when(~ok, F.col(c)) for c in ("key", "value")}).persist()
    try:
        dead(msg.dead_letters(decoded.where(~ok)), batch_id)
        rows = decoded.where(ok).withColumns({"arrival_us": F.unix_micros("timestamp"), "sequence": F.col("offset")})
        rows = msg.last_wins(rows.select(*CLEAN_SCHEMA.fieldNames(), "partition"), ("partition", "sequence"))
        clean(rows.select(*CLEAN_SCHEMA.fieldNames()), batch_id)
        if stats_path is not None:
            counts = msg.outcome_counts(decoded).first().asDict()
            seconds = time.monotonic() - started
            _write_stats(batch.sparkSession, stats_path, batch_id, seconds=seconds, **counts)
    finally:
        decoded.unpersist()


def start_ingest(
    messages: DataFrame, clean_path: str, dead: BatchWriter, checkpoint: str, stats_path: str | None = None, **trigger
) -> StreamingQuery:
    """The first query. A new checkpoint reads everything again; the same one resumes."""

    def run(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, publish_once(clean_path, checkpoint), dead, stats_path)

    return (
        messages.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


@dataclass
class ScoringJob:
    """What the second query needs to know. `windows=None` scores without velocity.

    With `late_seconds` the state of cards that stay idle is given up: see `live_velocity`.
    """

    model: RiskProvider
    thresholds: Thresholds = field(default_factory=Thresholds)
    version: str = "unversioned"
    windows: VelocityWindows | None = field(default_factory=VelocityWindows)
    rules: Sequence[Rule] | None = None
    late_seconds: float | None = None
    attempts: int | None = None
    sleep: Callable[[float], None] = time.sleep


def record_batch(batch: DataFrame, batch_id: int, job: ScoringJob, record: BatchWriter, stats_path: str | None = None) -> None:
    """One batch of measured rows: scored and recorded with a single time of decision."""
    started = time.monotonic()
    results = score(batch, job.model, job.thresholds, job.version, job.rules)
    rows = decisions.to_rows(results, F.current_timestamp()).persist()
    try:
        outage = record_patiently(lambda: record(rows, batch_id), job.attempts, sleep=job.sleep)
        if stats_path is not None:
            kinds = [F.count_if(F.col("decision") == k).alias(k) for k in KINDS]
            counts = rows.agg(F.count(F.lit(1)).alias("scored"), *kinds).first().asDict()
            _write_stats(
                batch.sparkSession, stats_path, batch_id, outages=outage.count, seconds_waiting=outage.seconds,
                seconds=time.monotonic() - started, **counts,
            )
    finally:
        rows.unpersist()


@contextmanager
def _setting(spark: SparkSession, values: dict[str, str]):
    """Session settings a query copies when it starts, put back afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def start_scoring(
    spark: SparkSession, clean_path: str, job: ScoringJob, record: BatchWriter, checkpoint: str,
    stats_path: str | None = None, files_per_batch: int | None = None, **trigger,
) -> StreamingQuery:
    """The second query, over the clean rows of the first."""
    trigger = trigger or {"availableNow": True}
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if trigger.get("availableNow"):
        # Idle cards expire in batches without data, which a live query runs; a query
        # that should end once the input is used up would go on with them for ever.
        settings["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    reader = spark.readStream.schema(CLEAN_SCHEMA)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(clean_path).select(*CLEAN_SCHEMA.fieldNames())
    measured = without_velocity(rows) if job.windows is None else live_velocity(rows, job.windows, job.late_seconds)

    def run(batch: DataFrame, batch_id: int) -> None:
        record_batch(batch, batch_id, job, record, stats_path)

    with _setting(spark, settings):
        return (
            measured.writeStream.foreachBatch(run)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )


def positions_from_progress(spark: SparkSession, progress: dict) -> DataFrame:
    """(topic, partition, high_water, position) from a Kafka query's progress report."""
    rows = []
    parsed = lambda text: json.loads(text) if isinstance(text, str) else (text or {})
    for source in progress.get("sources", []):
        ends, newest = parsed(source.get("endOffset")), parsed(source.get("latestOffset"))
        for topic, partitions in ends.items():
            for number, position in partitions.items():
                high = newest.get(topic, {}).get(number)
                rows.append((topic, int(number), None if high is None else int(high), int(position)))
    return spark.createDataFrame(rows, "topic string, partition int, high_water bigint, position bigint")
