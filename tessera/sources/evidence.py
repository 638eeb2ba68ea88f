"""Saved project tables of several owners with the evidence of where their places are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geo import finite, valid_point
from ..operators.locations import first_per_role, weakest
from ..operators.projects import normalize_projects, prepare_projects, union_projects
from .tables import numbered, read_text_csv

#: What a project keeps of the evidence of each of its two places.
KEPT = ["confidence", "source", "osm_type", "osm_id", "reasons"]


def with_evidence(projects: DataFrame, evidence: DataFrame, source_file: str) -> DataFrame:
    """Projects (texts) with their first two places as found, under canonical names.

    evidence: utility, project_id, location_role, target_location, latitude,
    longitude, expected_voltages, project_type, number (the order of its rows) and
    KEPT. Of several rows of a role the first counts. A place without usable
    coordinates has low confidence; a project's is that of its weaker place, low
    without any. Voltages that a project lacks come from its first row of evidence,
    as does its type if its table has no such column.
    """
    key = ["utility", "project_id"]
    told = first_per_role(evidence.where(F.col("location_role").isin("location_1", "location_2")), "number")
    there = valid_point(finite(F.col("latitude")), finite(F.col("longitude")))
    told = told.withColumn("_grade", F.when(there, F.initcap("confidence")).otherwise("Low"))
    of = lambda n, c: F.max(F.when(F.col("location_role") == f"location_{n}", F.col(c)))
    listed = lambda value: F.transform(F.sort_array(F.collect_list(F.struct("location_role", value.alias("v")))), lambda x: x["v"])
    names = {"target_location": "", "latitude": "_lat", "longitude": "_lon"}
    wide = told.groupBy(*key).agg(
        *[of(n, c).alias(f"_location_{n}{suffix}") for n in (1, 2) for c, suffix in names.items()],
        *[of(n, c).alias(f"point_{n}_{c}") for n in (1, 2) for c in KEPT],
        weakest(F.col("_grade"), "Low").alias("confidence"),
        F.array_join(F.array_distinct(F.filter(listed(F.col("source")), lambda x: x != "")), "; ").alias("location_source"),
        F.array_join(listed(F.concat_ws(": ", "target_location", "reasons")), " | ").alias("verification_notes"),
    )
    first = evidence.groupBy(*key).agg(F.min_by(F.struct("project_type", F.split("expected_voltages", ";").alias("volts")), "number").alias("_first"))
    made = ("confidence", "location_source", "verification_notes", "center_method", "source_file", "source_pages", *(f"point_{n}_{c}" for n in (1, 2) for c in KEPT))
    rows = projects.drop(*made).join(wide, key, "left").join(first, key, "left")
    have = lambda c: F.col(c) if c in projects.columns else F.lit("")
    placed = {f"location_{n}{suffix}": F.coalesce(f"_location_{n}{suffix}", have(f"location_{n}{suffix}")) for n in (1, 2) for suffix in names.values()}
    volts = {f"voltage_{n}": F.when(~T.filled(have("voltage_1")) & F.col("_first").isNotNull(), F.coalesce(F.get("_first.volts", F.lit(n - 1)), F.lit(""))).otherwise(have(f"voltage_{n}")) for n in (1, 2)}
    pages = F.array_join(F.filter(F.array(*[have(c) for c in ("table_page", "detail_page")]), lambda x: x != ""), "; ")
    fresh = {**placed, **volts, "confidence": F.coalesce("confidence", F.lit("Low")), "center_method": F.lit("unavailable"), "source_file": F.lit(source_file), "source_pages": pages}
    if "project_type" not in projects.columns:
        fresh["project_type"] = F.coalesce("_first.project_type", F.lit(""))
    rows = rows.withColumns(fresh).drop("_first", *[f"_{c}" for c in placed])
    return normalize_projects(rows.na.fill(""), "", source_file)


def load_with_evidence(spark: SparkSession, sources: list[tuple[str, str, str, str]]) -> DataFrame:
    """One prepared table of (projects CSV, evidence CSV, owner, name of the source) of each owner; rows of other owners are left out."""
    found = []
    for projects, evidence, owner, source_file in sources:
        own = read_text_csv(spark, projects)
        found.append(with_evidence(own.where(F.col("utility") == owner), numbered(read_text_csv(spark, evidence)), source_file))
    return prepare_projects(union_projects(found))
