"""The Spark session of tests, benchmarks and scripts."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8, app: str = "emend") -> SparkSession:
    """A session on this machine; on a cluster the caller brings a session of its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EMEND_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine find this package wherever the driver was started. Clusters bring it by their own means."""
    own, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if own not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, own])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Unset on one machine (tests): a temporary one; unset on a cluster: an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='emend-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        _delete_at_exit(spark, found)
    return found.rstrip("/")


def delete(path: str, jvm, conf) -> None:
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def gone() -> None:
        try:
            delete(path, jvm, conf)
        except (Py4JError, OSError):  # the JVM has ended before the driver
            pass

    atexit.register(gone)


_run_dirs: set[str] = set()


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends."""
    found = f"{shared_dir(spark)}/emend-{spark.sparkContext.applicationId}"
    if found not in _run_dirs:
        _run_dirs.add(found)
        _delete_at_exit(spark, found)
    return found


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder in this application's part of the shared one."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """A write in it deletes its shuffle files as it ends; else they stay until the driver's JVM happens to collect garbage, and add up."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


#: Share of the driver's heap in use from which a write asks for a collection of garbage as it ends, and the fewest seconds between two of these.
HEAP_SHARE, COLLECT_SECONDS = 0.4, 10.0
_collected = 0.0


def heap_released(spark: SparkSession) -> None:
    """Let a driver with much of its heap in use collect garbage. Tables that were broadcast and plans of ended writes are freed only then; left to itself, the JVM takes more memory of the machine first."""
    global _collected
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if time.monotonic() - _collected > COLLECT_SECONDS and heap.totalMemory() - heap.freeMemory() > HEAP_SHARE * heap.maxMemory():
        gc.collect()  # Python's references keep plans alive
        heap.gc()
        _collected = time.monotonic()


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to a new folder of the shared one and read from there."""
    path = work_dir(df.sparkSession, label)
    with shuffles_released(df.sparkSession):
        df.write.parquet(path, compression="zstd")
    heap_released(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def unstored(*tables: DataFrame) -> None:
    """Delete what stored() wrote, once nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "_stored_path", None):
            delete(path, df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration())
