"""Project tables: forgiving column names, centers, warnings, keys, review edits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geo import finite, midpoint, valid_point


class ProjectTableError(ValueError):
    """A project table cannot be used as it is."""


# The canonical columns and the spellings that lead to them.
CANONICAL = [
    "project_id", "project_name", "utility", "project_type", "region", "start_date", "in_service_date", "voltage", "voltage_2",
    "latitude", "longitude", "point_1_name", "point_1_latitude", "point_1_longitude", "point_2_name", "point_2_latitude", "point_2_longitude",
    "match_status", "confidence", "location_status", "location_source", "verification_notes", "center_method", "source_pages", "description", "data_warnings",
]
ALIASES = {
    "project_id": ["project_id", "id"],
    "project_name": ["project_name", "name"],
    "utility": ["utility", "operator"],
    "project_type": ["project_type", "type"],
    "region": ["county_region", "county", "region", "state"],
    "in_service_date": ["in_service_date", "inservice_date"],
    "start_date": ["start_date"],
    "voltage": ["voltage_1"],
    "voltage_2": ["voltage_2"],
    "latitude": ["latitude", "lat", "lat_center", "centroid_latitude", "center_lat", "center_latitude"],
    "longitude": ["longitude", "lon", "lng", "lon_center", "centroid_longitude", "center_lon", "center_longitude"],
    "point_1_name": ["name_a", "location_1", "point_1_name"],
    "point_1_latitude": ["lat_a", "location_1_lat", "point_1_latitude"],
    "point_1_longitude": ["lon_a", "location_1_lon", "point_1_longitude"],
    "point_2_name": ["name_b", "location_2", "point_2_name"],
    "point_2_latitude": ["lat_b", "location_2_lat", "point_2_latitude"],
    "point_2_longitude": ["lon_b", "location_2_lon", "point_2_longitude"],
    "match_status": ["match_status"],
    "confidence": ["confidence", "overall_confidence"],
    "location_status": ["location_status"],
    "location_source": ["location_source"],
    "verification_notes": ["verification_notes"],
    "center_method": ["center_method"],
    "source_file": ["source_file"],
    "source_pages": ["source_pages"],
    "description": ["description"],
    "data_warnings": ["data_warnings"],
    "line_miles": ["line_miles"],
}
FROM_ENDPOINTS = ["endpoint_midpoint", "single_location", "one_of_two_endpoints"]
COORDINATES = ["latitude", "longitude", "point_1_latitude", "point_1_longitude", "point_2_latitude", "point_2_longitude"]


def header_key(header: str) -> str:
    return "_".join(re.split(r"\s+", re.sub("[/-]", " ", header).strip().lower()))


def canonical_columns(columns: list[str]) -> dict[str, str] | None:
    """Header to canonical name for a table's headers; None if no project name is among them.

    Of headers that read the same the last counts; of several that mean the
    same column, the one that stands first.
    """
    last = {header_key(c): c for c in columns}
    if not {"project_name", "name"} & set(last):
        return None
    means = {alias: name for name, aliases in ALIASES.items() for alias in aliases}
    found: dict[str, str] = {}
    for header in columns:
        key = header_key(header)
        if last[key] == header and key in means and means[key] not in found.values():
            found[header] = means[key]
    return found


def normalize_projects(table: DataFrame, owner: str, source: str) -> DataFrame | None:
    """A table under canonical names, with blank owners and sources filled; None if it holds no project names."""
    names = canonical_columns(table.columns)
    if names is None:
        return None
    extras = [c for c in table.columns if c not in names and c not in names.values()]
    quoted = lambda c: F.col(f"`{c}`")
    rows = table.select(*[F.coalesce(quoted(c).cast("string"), F.lit("")).alias(n) for c, n in names.items()], *[quoted(c) for c in extras])
    rows = rows.withColumn("project_name", T.blank(F.col("project_name"))).where("project_name <> ''")
    rows = rows.withColumns({c: F.lit("") for c in CANONICAL if c not in rows.columns})
    source_file = F.col("source_file") if "source_file" in rows.columns else F.lit("")
    return rows.withColumns({"utility": T.first_filled(F.col("utility"), F.lit(owner)), "source_file": F.coalesce(F.nullif(source_file, F.lit("")), F.lit(source)), **{c: finite(F.col(c)) for c in COORDINATES}})


def check_keys(projects: DataFrame) -> None:
    """Raises if an id or owner is blank or a key is there twice. One small aggregate."""
    blank = (T.blank(F.col("project_id")) == "") | (T.blank(F.col("utility")) == "")
    if projects.where(blank).limit(1).count():
        raise ProjectTableError("every project needs an id and an owner")
    if duplicate_keys(projects).limit(1).count():
        raise ProjectTableError("a (utility, project_id) is there twice")


def check_owners(projects: DataFrame, expected: set[str] | None = None) -> list[str]:
    """The owners in order of name; an error if they are fewer than two, or not the expected ones. At most a few names are gathered."""
    most = 1_000
    found = sorted(r[0] for r in projects.where(T.filled(F.col("utility"))).select("utility").distinct().limit(most).collect())
    if expected is not None and set(found) != expected:
        raise ProjectTableError(f"projects of {' and '.join(sorted(expected))} are needed, found: {', '.join(found) or 'none'}")
    if len(found) < 2:
        raise ProjectTableError("load projects from at least two distinct owners")
    return found


def duplicate_keys(projects: DataFrame, *keys: str) -> DataFrame:
    """Keys that more than one row has, and how many."""
    keys = keys or ("utility", "project_id")
    return projects.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def prepare_projects(projects: DataFrame) -> DataFrame:
    """Centers, center methods, statuses, confidence and data warnings from what the rows hold.

    A center comes from the usable endpoints; an endpoint with half its
    coordinates never lends one; a center beside named but unusable endpoints is
    cleared.
    """
    rows = projects.withColumns({c: F.lit("") for c in CANONICAL if c not in projects.columns})
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CANONICAL if c not in COORDINATES}
    raw = {c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in COORDINATES}
    rows = rows.withColumns({**text, "project_id": T.blank(F.col("project_id")), "utility": T.blank(F.col("utility")), **{c: finite(F.col(c)) for c in COORDINATES}, **{f"_raw_{c}": raw[c] for c in COORDINATES}})
    point = {n: valid_point(F.col(f"point_{n}_latitude"), F.col(f"point_{n}_longitude")) for n in (1, 2)}
    written = {n: (F.col(f"_raw_point_{n}_latitude") != "") | (F.col(f"_raw_point_{n}_longitude") != "") for n in (1, 2)}
    named = {n: (F.trim(f"point_{n}_name") != "") | written[n] for n in (1, 2)}
    ends = {c: midpoint(*(F.when(point[n], F.col(f"point_{n}_{c}")) for n in (1, 2))) for c in ("latitude", "longitude")}
    any_point, own = point[1] | point[2], valid_point(F.col("latitude"), F.col("longitude"))
    by_ends = named[1] | named[2] | F.col("center_method").isin(FROM_ENDPOINTS)
    method = (
        F.when(point[1] & point[2], "endpoint_midpoint")
        .when(any_point & named[1] & named[2], "one_of_two_endpoints")
        .when(any_point, "single_location")
        .when(by_ends, "unavailable")
        .when(own & ~F.col("center_method").isin("", "unavailable"), F.col("center_method"))
        .when(own, "provided_center")
        .otherwise("unavailable")
    )
    center = {c: F.when(any_point, ends[c]).when(~by_ends & own, F.col(c)) for c in ("latitude", "longitude")}
    located = any_point | (~by_ends & own)
    date = {c: T.any_date(F.col(c)) for c in ("start_date", "in_service_date")}
    invalid = lambda c, label: F.when(T.filled(F.col(c)) & date[c].isNull(), f"Invalid {label}")
    warnings = F.array_compact(
        F.array(
            *[F.when(~point[n] & written[n], f"Point {n} incomplete or outside coordinate bounds") for n in (1, 2)],
            F.when(~located, "No usable project center"),
            invalid("start_date", "Start Date"),
            invalid("in_service_date", "In-Service Date"),
            F.when(date["start_date"] > date["in_service_date"], "Start Date is after In-Service Date"),
        )
    )
    confidence = F.initcap(F.trim("confidence"))
    fresh = {
        **center,
        "center_method": method,
        "confidence": F.when(confidence.isin("High", "Medium", "Low"), confidence).otherwise("Low"),
        "location_status": F.when(F.col("location_status") != "", F.col("location_status")).when(located, "Candidate").otherwise("Missing"),
        "match_status": F.when(F.col("match_status") != "", F.col("match_status")).otherwise("Unmatched"),
        "data_warnings": F.array_join(warnings, "; "),
    }
    return rows.withColumns(fresh).drop(*[f"_raw_{c}" for c in COORDINATES])


def union_projects(tables: list[DataFrame]) -> DataFrame:
    """All tables by column name; a column that one lacks is null there."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def apply_location_review(before: DataFrame, edited: DataFrame, source: str = "Manual edit") -> DataFrame:
    """Edited centers: the first original is kept, the edit is low in confidence and a candidate again.

    An edit of a center that follows from endpoints is ignored and reported in
    review_note. Rows are matched by (utility, project_id).
    """
    new = edited.select("utility", "project_id", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"), F.lit(True).alias("_there"))
    rows = before.join(new, ["utility", "project_id"], "left")
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("original_latitude", "original_longitude") if c not in rows.columns})
    moved = F.coalesce(F.col("_there") & ~(F.col("_lat").eqNullSafe(F.col("latitude")) & F.col("_lon").eqNullSafe(F.col("longitude"))), F.lit(False))
    ends = F.col("center_method").isin(FROM_ENDPOINTS)
    takes = moved & ~ends
    note = F.concat(F.lit("Center edited; "), F.coalesce("verification_notes", F.lit("")))
    kept = F.col("original_latitude").isNotNull()
    rows = rows.withColumns({"_takes": takes, "review_note": F.when(moved & ends, "center follows from endpoints; edit ignored").otherwise("")})
    take = F.col("_takes")
    rows = rows.withColumns(
        {
            "original_latitude": F.when(take & ~kept, F.col("latitude")).otherwise(F.col("original_latitude")),
            "original_longitude": F.when(take & ~kept, F.col("longitude")).otherwise(F.col("original_longitude")),
            "location_source": F.when(take, source).otherwise(F.col("location_source")),
            "confidence": F.when(take, "Low").otherwise(F.col("confidence")),
            "location_status": F.when(take, "Candidate").otherwise(F.col("location_status")),
            "verification_notes": F.when(take, note).otherwise(F.col("verification_notes")),
        }
    )
    return rows.withColumns({"latitude": F.when(take, F.col("_lat")).otherwise(F.col("latitude")), "longitude": F.when(take, F.col("_lon")).otherwise(F.col("longitude"))}).drop("_lat", "_lon", "_there", "_takes")


def is_filled(column: str) -> Column:
    return T.filled(F.col(column))


def of_sponsors(rows: DataFrame, sponsors: list[str] | None) -> DataFrame:
    """Rows of the named sponsors; without any, all of them."""
    return rows.where(F.col("sponsor").isin(sponsors)) if sponsors else rows


def of_owner(rows: DataFrame, owner: str) -> DataFrame:
    return rows.where(F.col("utility") == owner)


def with_warnings(projects: DataFrame) -> DataFrame:
    """Projects that a person should look at."""
    return projects.where("data_warnings <> ''")
