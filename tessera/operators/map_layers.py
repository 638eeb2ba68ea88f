"""Layers of a map: projects with labels, their located endpoints, lines between them, and the view that shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geo import valid_point
from .overlaps import both_sides

METERS_PER_MILE = 1609.344
#: Zoom levels of a view, how much wider a degree of latitude is drawn, and the least spread.
WIDEST_ZOOM, CLOSEST_ZOOM, LATITUDE_STRETCH, LEAST_SPREAD = 6.0, 12.0, 1.25, 0.01
#: The view without any project.
EMPTY_VIEW = (33.0, -81.0)


def _located(n: int) -> Column:
    return valid_point(F.col(f"point_{n}_latitude"), F.col(f"point_{n}_longitude"))


def _shown(n: int) -> Column:
    name = F.col(f"point_{n}_name")
    return F.when(F.coalesce(name, F.lit("")) == "", f"Point {n}").otherwise(name)


def center_note(method: str = "center_method") -> Column:
    """How a project's center was made, by its method and its located endpoints."""
    one, two, how = _located(1), _located(2), F.col(method)
    first = F.when(one, _shown(1)).otherwise(_shown(2))
    named = F.filter(F.array(*[T.blank(F.col(f"point_{n}_name")) for n in (1, 2)]), lambda x: x != "")
    lost = F.coalesce(F.get(F.filter(named, lambda x: x != first), F.lit(0)), F.lit("the other substation"))
    return (
        F.when((how == "endpoint_midpoint") & one & two, F.concat(F.lit("Center: midpoint of "), _shown(1), F.lit(" and "), _shown(2)))
        .when((how == "one_of_two_endpoints") & (one | two), F.concat(F.lit("Center: "), first, F.lit(" only; "), lost, F.lit(" has no coordinates")))
        .when((how == "single_location") & (one | two), F.concat(F.lit("Center: "), first, F.lit(" (the project's one substation)")))
        .otherwise("Center: supplied coordinates")
    )


def project_points(projects: DataFrame, pairs: DataFrame, threshold: float | None = None) -> DataFrame:
    """A point a project with its label, whether it is only one of two endpoints (fallback) and has a pair; radius_meters of its circle, half the threshold, if it has one."""
    near = both_sides(pairs).distinct().withColumn("_near", F.lit(True))
    rows = projects.join(near, ["utility", "project_id"], "left").withColumn("has_pair", F.coalesce("_near", F.lit(False)))
    label = F.concat_ws(
        "\n", T.blank(F.col("project_name")), F.concat_ws(" · ", "utility", "project_id"), F.concat(F.lit("Confidence: "), F.coalesce("confidence", F.lit(""))), center_note(),
        F.when(F.col("has_pair"), "Has coordination candidates").otherwise("No qualifying pair"),
    )
    radius = F.when(F.col("has_pair"), F.lit(threshold / 2 * METERS_PER_MILE)) if threshold else F.lit(None).cast("double")
    return rows.select("utility", "project_id", "latitude", "longitude", label.alias("label"), (F.col("center_method") == "one_of_two_endpoints").alias("fallback"), "has_pair", radius.alias("radius_meters"))


def endpoint_points(projects: DataFrame) -> DataFrame:
    """A point for each located endpoint, with its label."""
    confidence = lambda n: F.coalesce(F.nullif(T.blank(F.col(f"point_{n}_confidence")), F.lit("")), F.lit("Unknown")) if f"point_{n}_confidence" in projects.columns else F.lit("Unknown")
    label = lambda n: F.concat_ws("\n", F.concat(_shown(n), F.lit(" substation ("), confidence(n), F.lit(")")), F.concat_ws(" · ", "utility", "project_id"), F.lit("An endpoint of the project, not its center"))
    ends = [F.when(_located(n), F.struct(F.lit(n).alias("endpoint"), F.col(f"point_{n}_latitude").cast("double").alias("latitude"), F.col(f"point_{n}_longitude").cast("double").alias("longitude"), label(n).alias("label"))) for n in (1, 2)]
    return projects.select("utility", "project_id", F.explode(F.array_compact(F.array(*ends))).alias("e")).select("utility", "project_id", "e.*")


def endpoint_lines(projects: DataFrame) -> DataFrame:
    """A line between the endpoints of each project that has both."""
    label = F.concat_ws("\n", F.concat(_shown(1), F.lit(" – "), _shown(2), F.lit(" ("), F.col("project_id"), F.lit(")")), F.lit("The project's center is the middle of this line"), F.lit("Straight line, not the transmission route"))
    at = [F.col(f"point_{n}_{c}").cast("double").alias(f"{c}_{n}") for n in (1, 2) for c in ("latitude", "longitude")]
    return projects.where(_located(1) & _located(2)).select("utility", "project_id", *at, label.alias("label"))


def fit_view(points: DataFrame) -> DataFrame:
    """One row: the middle of the points' box and the zoom at which it fills most of the map; of no points, the empty view."""
    middle = lambda c: (F.min(c) + F.max(c)) / F.lit(2.0)
    spread = F.greatest(F.max("longitude") - F.min("longitude"), (F.max("latitude") - F.min("latitude")) * F.lit(LATITUDE_STRETCH), F.lit(LEAST_SPREAD))
    zoom = F.least(F.greatest(F.log2(F.lit(360.0) / spread) + F.lit(0.8), F.lit(WIDEST_ZOOM)), F.lit(CLOSEST_ZOOM))
    return points.agg(F.coalesce(middle("latitude"), F.lit(EMPTY_VIEW[0])).alias("latitude"), F.coalesce(middle("longitude"), F.lit(EMPTY_VIEW[1])).alias("longitude"), F.when(F.count("*") > 0, zoom).otherwise(WIDEST_ZOOM).alias("zoom"))


def whole_view(projects: DataFrame) -> DataFrame:
    """One row: the mean center of all projects, seen from the widest zoom."""
    return projects.agg(F.coalesce(F.avg("latitude"), F.lit(EMPTY_VIEW[0])).alias("latitude"), F.coalesce(F.avg("longitude"), F.lit(EMPTY_VIEW[1])).alias("longitude"), F.lit(WIDEST_ZOOM).alias("zoom"))
