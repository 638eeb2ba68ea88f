"""Where results are kept between jobs: the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master without that setting, a temporary folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df, computed once, read from the shared folder from then on, whichever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows unless the session says otherwise: a row here is a whole text, and 10,000 of them are too much for a small executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "1000")


def release() -> None:
    """Gives freed memory back to the system: a worker that waits for its next task shall not hold the peak of its last one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _run(f, *args):
    try:
        return f(*args)
    finally:
        release()


def swept(f):
    """f, a function of batches, that releases memory after the last one."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def tidily(f, sides: int = 1):
    """f as a function of a group (or of a cogroup of two sides) that releases memory after each."""
    return (lambda key, table: _run(f, key, table)) if sides == 1 else (lambda key, left, right: _run(f, key, left, right))
