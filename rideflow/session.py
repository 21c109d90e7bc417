"""Session set-up and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_RUN_FOLDER: ContextVar[str | None] = ContextVar("run_folder", default=None)


def local_session(cpus: str | int = "*", app: str = "rideflow") -> SparkSession:
    """Session for tests and the benchmark; on a cluster the submitter brings its own."""
    # Spark 4 sets the checkpoint directory from spark.checkpoint.dir by itself.
    partitions = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, as the cluster sets it.

    Only a local session, where driver and executors are one process, may fall back to a
    folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="rideflow-")
    return _LOCAL_DIRS[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path nobody else writes to, in the folder of the run if there is one.

    Otherwise it lives as long as the checkpoint folder's contents do.
    """
    parent = _RUN_FOLDER.get() or f"{shared_dir(spark)}/rideflow"
    return f"{parent}/{label}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made within go to one folder, which is removed at the end.

    What is returned from within must have been written elsewhere by then.
    """
    path = f"{shared_dir(spark)}/rideflow/run-{uuid.uuid4().hex}"
    token = _RUN_FOLDER.set(path)
    try:
        yield path
    finally:
        _RUN_FOLDER.reset(token)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Cuts the lineage at a table that outlives lost executors, and fixes values that would
    differ between two evaluations (partition numbers, for one).
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
