"""Session settings and materialisation shared by the composite jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. Partition counts and memory are left to the cluster;
# adaptive execution coalesces or splits shuffle partitions at run time.
SESSION_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
    # Recording the Python call site of every column costs several JVM calls per expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "claimspark", master: str | None = None, **settings) -> SparkSession:
    """Session with the settings above; keyword settings use ``_`` for ``.`` in their names."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, **values) -> Iterator[None]:
    """Session settings (``_`` for ``.``) that hold inside the block and are put back afterwards."""
    before = {key.replace("_", "."): None for key in values}
    for key in before:
        before[key] = spark.conf.get(key, None)
    try:
        for key, value in values.items():
            spark.conf.set(key.replace("_", "."), str(value))
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, taken from ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, so that driver and executors share a disk, a private folder
    is used; it goes when the process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors can reach.")
    if context.applicationId not in _OWN_DIRS:
        own = _OWN_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="claimspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return _OWN_DIRS[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later jobs scan the columns they need instead of recomputing the plan, and a lost
    executor costs one re-read of its splits.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
