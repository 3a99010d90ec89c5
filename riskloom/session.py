"""Session helpers: settings that every job of the library relies on."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

# Settings a result depends on, as opposed to tuning the cluster decides.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of turning the row into null.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


_shipping = Lock()


def build_session(app: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; extra settings use `__` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the result-relevant settings to a session somebody else created."""
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, for jobs with Python functions.

    Not needed where it is installed on the cluster; harmless there.
    """
    context = spark.sparkContext
    with _shipping:  # jobs may be started side by side
        if getattr(context, "_riskloom_shipped", False):
            return
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="riskloom-package-")) / "riskloom.zip"
        with zipfile.ZipFile(archive, "w") as bundle:
            for file in sorted(root.rglob("*.py")):
                bundle.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))  # read on the driver, handed out by Spark
        context._riskloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, reachable by every executor.

    It comes from the session's `spark.checkpoint.dir`. Only where the cluster
    names none (a local test run) does a scratch folder stand in.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="riskloom-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A new, not yet existing folder under the shared one."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
