"""Long work over a table in steps whose progress is kept: a stopped run goes on where it was.

The table's files are a stream; each step takes some of them, and its result is a
folder of its own number. Spark notes in the checkpoint which files belong to which
step before a step begins and that it is done after it; a step that was stopped
half way is done again over the same files and replaces its own folder, so no
row is there twice and none is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

BOM = "\ufeff"


def work_in_steps(spark: SparkSession, source: str, schema, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 1) -> int:
    """Does work on all files of the Parquet table source that no earlier run with this checkpoint did; the number of steps done now."""
    done = []

    def step(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{out}/step={number}")
        done.append(number)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)


def finished(spark: SparkSession, out: str) -> DataFrame:
    """The results of all steps so far, with the column step."""
    return spark.read.parquet(out)


def write_csv_with_mark(rows: DataFrame, path: str, columns: list[str]) -> None:
    """CSV files of the given columns in order, each with a header that begins with a byte order mark; extra columns are an error of the caller, missing ones are empty."""
    from pyspark.sql import functions as F

    have = {c: F.col(c) if c in rows.columns else F.lit("").alias(c) for c in columns}
    if extra := [c for c in rows.columns if c not in columns]:
        raise ValueError(f"columns that the file has no place for: {', '.join(extra)}")
    rows.select([have[c].alias(BOM + c if k == 0 else c) for k, c in enumerate(columns)]).write.mode("overwrite").csv(path, header=True, emptyValue="", quote='"', escape='"')
