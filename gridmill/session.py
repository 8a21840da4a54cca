"""Session settings the jobs expect."""

from __future__ import annotations

import tempfile

from uuid import uuid4

from pyspark.sql import SparkSession

SETTINGS = {
    # Meter timestamps carry no zone; UTC keeps casts of zoned input free of DST gaps.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    # Joins change to broadcast, split skewed partitions and merge small ones from measured sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Recording the Python call site of every expression doubles the time it takes to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "gridmill", master: str | None = None, **settings: str) -> SparkSession:
    """Get or create a session with ``SETTINGS``; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a fresh local one only in local mode without it."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridmill-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder of one run's own in the shared folder; Hadoop deletes it when the driver ends."""
    folder = f"{shared_folder(spark)}/gridmill/{name}-{uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder
