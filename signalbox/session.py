"""Session helpers: durable checkpoints, shared folders and input spreading."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

EVERY = 3.0
"""Seconds between two collections of garbage."""
_collected = 0.0


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taking the one the session names if there is one.

    A private folder is made only on a local master; a cluster has to name a
    folder all executors share.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="signalbox-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the stored copy.

    Used before loops that scan the same data many times, so that a lost executor
    costs a re-read and not a recomputation of everything upstream.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only when the scan yields fewer partitions than there are cores.

    Large inputs already arrive in many splits and pass through without a shuffle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys) if keys else df.repartition(wanted)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder that all executors share."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder URI and the path in it, for use inside a task."""
    scheme, sep, rest = uri.partition(":")
    if sep and scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(uri)


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of tables that nothing refers to any more.

    It does so when the driver's JVM collects garbage, which a driver that holds little may not do for
    long; loops of small jobs would keep the files of all rounds.
    """
    global _collected
    if time.monotonic() - _collected > EVERY:
        spark._jvm.System.gc()
        _collected = time.monotonic()
