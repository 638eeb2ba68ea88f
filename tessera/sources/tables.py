"""Sources: test tables, forgiving text tables, ragged CSV, sheets, replies, snapshots."""

from __future__ import annotations

import csv
import io
import json
import os
import zipfile

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ragged
from ..operators.projects import ProjectTableError, normalize_projects, prepare_projects, union_projects


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, every column as text, blanks as empty texts, with or without a byte order mark."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    rows = rows.toDF(*[c.removeprefix("\ufeff") for c in rows.columns])
    return rows.na.fill("")


def read_keyed_csv(spark: SparkSession, path: str) -> DataFrame:
    """`read_text_csv` of a table with identity columns; a blank project_id is an error, a blank utility is not."""
    rows = read_text_csv(spark, path)
    if missing := [c for c in ("utility", "project_id") if c not in rows.columns]:
        raise ProjectTableError(f"{path}: missing identity columns: {', '.join(missing)}")
    if blank := rows.where("trim(project_id) = ''").limit(1).count():
        raise ProjectTableError(f"{path}: {blank} row or more without project_id")
    return rows


def read_ragged_csv(spark: SparkSession, path: str, headers: list[str]) -> DataFrame:
    """(line, cells): the cells of each row, however many, of CSV files whose header is one of headers; blank rows are left out."""
    rows = ragged.records(spark, path)
    wrong = rows.where("line = 0").where(~F.array_join("cells", ",").isin(headers))
    if rows.isEmpty() or not wrong.isEmpty():
        raise ProjectTableError(f"{path}: the header is none of those known")
    return rows.where((F.col("line") > 0) & F.exists("cells", lambda c: F.trim(c) != "")).select("line", "cells")


def read_sheets(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of a workbook by "file / sheet"; a CSV counts as one sheet. Small files, read by the driver."""
    name, suffix = os.path.basename(path), os.path.splitext(path)[1].lower()
    if suffix == ".csv":
        return {name: read_text_csv(spark, path)}
    if suffix in (".xlsx", ".xlsm"):
        import pandas as pd

        sheets = pd.read_excel(path, sheet_name=None, dtype=str, keep_default_na=False)
        return {f"{name} / {k}": spark.createDataFrame(v) for k, v in sheets.items() if len(v)}
    if suffix == ".pdf":
        raise ProjectTableError(f"{name} is a PDF; upload its project table as CSV or XLSX")
    raise ProjectTableError(f"{name} has an unsupported file type; CSV and XLSX can be read")


def load_projects(spark: SparkSession, files_a: list[str], files_b: list[str], owner_a: str, owner_b: str) -> DataFrame | None:
    """All sheets of all files as one prepared project table; what is wrong with any file is raised together."""
    tables, errors = [], []
    for files, owner in ((files_a, owner_a), (files_b, owner_b)):
        for path in files:
            try:
                found = [t for source, sheet in read_sheets(spark, path).items() if (t := normalize_projects(sheet, owner, source)) is not None]
                tables += found
                if not found:
                    errors.append(f"{os.path.basename(path)}: no sheet has a project name column")
            except ProjectTableError as e:
                errors.append(str(e))
    if errors:
        raise ProjectTableError("\n".join(errors))
    return prepare_projects(union_projects(tables)) if tables else None


def known_source(files: DataFrame, known: DataFrame, strict: bool = False) -> DataFrame:
    """Binary files (content) joined to a table of known digests (sha256, ...); unknown ones have null there, or are an error if strict."""
    rows = files.withColumn("sha256", F.sha2("content", 256)).join(known.withColumn("_known", F.lit(True)), "sha256", "left")
    if strict:
        stop = F.raise_error(F.concat(F.lit("unknown file of digest "), F.col("sha256"))).cast("string")
        rows = rows.withColumn("sha256", F.when(F.col("_known"), F.col("sha256")).otherwise(stop))
    return rows.drop("_known")


def numbered(rows: DataFrame, name: str = "number") -> DataFrame:
    """Adds the place of each row, from 1: by file name and place in it for rows of a file scan, else by partition.

    Rows are numbered inside each range of a file; only the ranges' counts meet in
    one place, a row a range.
    """
    try:
        place = rows.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_id"), "*")
        place.schema  # noqa: B018  an analysis error here: no file scan
    except AnalysisException:
        place = rows.select(F.lit("").alias("_file"), F.spark_partition_id().cast("long").alias("_range"), F.monotonically_increasing_id().alias("_id"), "*")
    own = F.row_number().over(Window.partitionBy("_file", "_range").orderBy("_id"))
    before = Window.orderBy("_file", "_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = place.groupBy("_file", "_range").count().select("_file", "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    return place.withColumn("_own", own).join(starts, ["_file", "_range"]).withColumn(name, (F.col("_start") + F.col("_own")).cast("long")).select(*rows.columns, name)


def read_locations_csv(spark: SparkSession, path: str) -> DataFrame:
    """Projects of a parser's table with their place from 1, and voltages and locations as lists of what is filled."""
    rows = numbered(read_text_csv(spark, path))
    listed = lambda *names: F.filter(F.array(*map(F.col, names)), lambda x: x != "")
    return rows.select(
        "number", "project_id", "utility", "state", "project_name", "project_type",
        listed("voltage_1", "voltage_2").alias("voltages"), listed("location_1", "location_2", "location_3").alias("locations"))


#: The columns of an override file, in their order.
OVERRIDE_COLUMNS = ["utility", "project_id", "target_location", "latitude", "longitude", "matched_name", "osm_type", "osm_id", "source", "note"]


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """An override file, checked: columns in order, both coordinates numbers or both blank, owner, place and source filled, no key twice."""
    rows = read_text_csv(spark, path)
    if rows.columns != OVERRIDE_COLUMNS:
        raise ProjectTableError(f"{path} must have the columns {', '.join(OVERRIDE_COLUMNS)}, in that order")
    rows = numbered(rows.select(*[F.trim(c).alias(c) for c in OVERRIDE_COLUMNS]), "line").withColumn("line", F.col("line") + 1)
    number = lambda c: F.col(c).try_cast("double").isNotNull()
    blank = (F.col("latitude") == "") & (F.col("longitude") == "")
    key = ["utility", "project_id", F.lower("target_location").alias("place")]
    twice = rows.groupBy(*key).agg(F.max("line").alias("line"), F.count("*").alias("n")).where("n > 1").select("line", F.lit("a second override for its key").alias("problem"))
    wrong = rows.where(~blank & ~(number("latitude") & number("longitude"))).select("line", F.lit("latitude and longitude must both be numbers, or both blank").alias("problem"))
    bare = rows.where("utility = '' or target_location = '' or source = ''").select("line", F.lit("utility, target_location and source are required").alias("problem"))
    if first := wrong.unionByName(bare).unionByName(twice).orderBy("line").first():
        raise ProjectTableError(f"{path} line {first['line']}: {first['problem']}")
    return rows.drop("line").withColumns({c: F.col(c).try_cast("double") for c in ("latitude", "longitude")})


def page_numbers(ranges: DataFrame, column: str = "pages") -> DataFrame:
    """(page): the distinct numbers of range texts such as "171-474,500", in order of value."""
    part = F.explode(F.split(F.replace(column, F.lit(" "), F.lit("")), ","))
    ends = ranges.select(part.alias("part")).select(F.split("part", "-").alias("e")).select(F.get("e", F.lit(0)).cast("int").alias("lo"), F.coalesce(F.get("e", F.lit(1)), F.get("e", F.lit(0))).cast("int").alias("hi"))
    return ends.select(F.explode(F.sequence("lo", "hi")).alias("page")).distinct()


def read_replies(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Cached JSON replies, one file each, with a fixed nested schema."""
    return spark.read.json(path, schema=schema, multiLine=True)


SNAPSHOT_VERSION, SNAPSHOT_BYTES = 1, 20 * 1024 * 1024


def restore_snapshot(spark: SparkSession, content: bytes) -> tuple[DataFrame, dict]:
    """The project table and settings of a snapshot archive, checked."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        if any(i.file_size > SNAPSHOT_BYTES for i in archive.infolist()):
            raise ValueError("a member of the snapshot is too large")
        settings = json.loads(archive.read("settings.json"))
        names, *rows = list(csv.reader(io.StringIO(archive.read("projects.csv").decode("utf-8-sig")))) or [[]]
    checks = {
        "format_version": settings.get("format_version") == SNAPSHOT_VERSION,
        "ranking_mode": settings.get("ranking_mode") in ("score", "distance_first"),
        "include_low": isinstance(settings.get("include_low"), bool),
        "threshold_miles": isinstance(settings.get("threshold_miles"), int | float) and 1 <= settings["threshold_miles"] <= 100,
    }
    if wrong := [k for k, ok in checks.items() if not ok]:
        raise ValueError(f"the snapshot's settings are not valid: {', '.join(wrong)}")
    if not {"utility", "project_id"} <= set(names):
        raise ValueError("the snapshot's projects have no identity columns")
    cells = [tuple((r + [None] * len(names))[: len(names)]) for r in rows if r]
    projects = spark.createDataFrame(cells, T.StructType([T.StructField(c, T.StringType()) for c in names]))
    owners = {r[0] for r in projects.select("utility").distinct().collect()}
    if not {settings.get("utility_a"), settings.get("utility_b")} <= owners:
        raise ValueError("the snapshot's owners are not in its projects")
    return prepare_projects(projects), settings
