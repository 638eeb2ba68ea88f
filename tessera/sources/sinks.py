"""Sinks: CSV in a fixed order, ranked tables, evidence JSON, snapshots, map layers, text reports."""

from __future__ import annotations

import csv
import io
import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_miles

METERS_PER_MILE = 1609.344


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None, one_file: bool = False) -> None:
    """CSV parts with a header; one_file only for results that fit a task."""
    rows = rows.select(*columns) if columns else rows
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").csv(path, header=True, emptyValue="", quote='"', escape='"')


def write_ranked(ranked: DataFrame, path: str) -> None:
    """Ranked pairs in order of rank; no rows are an error."""
    if ranked.isEmpty():
        raise ValueError("there are no pairs to write")
    write_csv(ranked.repartitionByRange("rank").sortWithinPartitions("rank"), path)


def write_evidence(projects: DataFrame, review: DataFrame, evidence: DataFrame, path: str) -> None:
    """Three outputs under one path: projects and review as CSV, evidence with its nested arrays as JSON lines."""
    write_csv(projects, f"{path}/projects")
    write_csv(review, f"{path}/review")
    evidence.write.mode("overwrite").json(f"{path}/evidence")


def _csv_text(rows: DataFrame) -> str:
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(rows.columns)
    for row in rows.toLocalIterator():
        writer.writerow(["" if v is None else v for v in row])
    return out.getvalue()


def snapshot(projects: DataFrame, ranked: DataFrame, settings: dict, readme: str = "") -> bytes:
    """A small archive for people: projects, ranked pairs, settings, a note. For tables a person can open."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("projects.csv", _csv_text(projects))
        archive.writestr("ranked_pairs.csv", _csv_text(ranked.orderBy("rank")))
        archive.writestr("settings.json", json.dumps({"format_version": 1, **settings}, indent=2))
        archive.writestr("README.txt", readme)
    return out.getvalue()


def map_points(projects: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """A point per project with its circle (radius_meters is half the threshold) and whether it has a pair."""
    from ..operators.overlaps import both_sides

    near = both_sides(pairs).distinct().withColumn("has_pair", F.lit(True))
    rows = projects.where("latitude is not null and longitude is not null").join(near, ["utility", "project_id"], "left")
    label = F.concat_ws(" ", F.col("project_id"), F.col("project_name"))
    return rows.select("utility", "project_id", label.alias("label"), "latitude", "longitude", F.coalesce("has_pair", F.lit(False)).alias("has_pair"), F.lit(threshold / 2 * METERS_PER_MILE).alias("radius_meters"))


def map_lines(projects: DataFrame, pairs: DataFrame) -> DataFrame:
    """Lines to draw: between a project's two endpoints, and between the centers of each pair."""
    ends = ["point_1_latitude", "point_1_longitude", "point_2_latitude", "point_2_longitude"]
    own = projects.where(" and ".join(f"{c} is not null" for c in ends)).select(F.lit("endpoints").alias("kind"), F.concat_ws(":", "utility", "project_id").alias("id"), *[F.col(c).alias(n) for c, n in zip(ends, ("lat_1", "lon_1", "lat_2", "lon_2"), strict=True)])
    between = pairs.select(F.lit("pair").alias("kind"), F.col("overlap_id").alias("id"), F.col("latitude_a").alias("lat_1"), F.col("longitude_a").alias("lon_1"), F.col("latitude_b").alias("lat_2"), F.col("longitude_b").alias("lon_2"))
    lines = own.unionByName(between)
    return lines.withColumn("miles", haversine_miles(F.col("lat_1"), F.col("lon_1"), F.col("lat_2"), F.col("lon_2")))


def map_view(points: DataFrame) -> DataFrame:
    """One row: the mean center and a zoom level that shows all points."""
    spread = F.greatest(F.max("latitude") - F.min("latitude"), F.max("longitude") - F.min("longitude"), F.lit(0.01))
    zoom = F.least(F.lit(12.0), F.greatest(F.lit(6.0), F.log2(F.lit(360.0) / spread) + 0.8))
    return points.agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), zoom.alias("zoom"))


def report(crosstab: DataFrame, summary: DataFrame) -> str:
    """A fixed-width text of an evaluation; both inputs are a few rows."""
    rows = [crosstab.columns] + [[str(v) for v in r] for r in crosstab.orderBy("column").collect()]
    width = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in rows]
    return "\n".join([*lines, *(f"{k}: {v}" for k, v in summary.first().asDict().items())])
