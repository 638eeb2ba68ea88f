"""Results kept between jobs in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master without that setting, a temporary folder of this machine, set for the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def durable(rows: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """rows, computed once (a checkpoint would compute them twice) and read as a table of the shared folder from then on, whichever executors are lost.

    The table stays until the folder is cleared, as later plans may still read it. It is read in the session given, or in that of rows.
    """
    path = fresh_path(rows.sparkSession, "table")
    rows.write.parquet(path)
    return (spark or rows.sparkSession).read.schema(rows.schema).parquet(path)


def keyed_session(spark: SparkSession) -> SparkSession:
    """A session of the same settings, but that joins of sides dealt alike by a part of their keys don't deal them again; the caller's own session stays as it is."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own
