"""Labels, notes and views of a map; checks of owners; labels that must be there."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation, map_layers, projects


@pytest.fixture(scope="module")
def rows(spark):
    table = [
        ("1", "One", "Oak", "33", "-84", "Elm", "34", "-85", "High"), ("2", "Two", "Oak", "33", "-84", "Elm", "", "", "Low"), ("3", "Three", "", "", "", "Elm", "34", "-85", "Low"),
        ("4", "Four", "Ash", "", "", "", "35", "-86", "Low"), ("5", "Five", "", "", "", "", "", "", "Low"),
    ]
    names = ["project_id", "project_name", "point_1_name", "point_1_latitude", "point_1_longitude", "point_2_name", "point_2_latitude", "point_2_longitude", "confidence"]
    return projects.prepare_projects(spark.createDataFrame(table, names).withColumn("utility", F.lit("A")))


def test_notes_labels_and_layers(spark, rows):
    pairs = spark.createDataFrame([("A", "1", "B", "9")], "utility_a string, project_id_a string, utility_b string, project_id_b string")
    points = {r["project_id"]: r for r in map_layers.project_points(rows, pairs, 25.0).collect()}
    notes = {k: r["label"].split("\n")[3] for k, r in points.items()}
    assert notes == {
        "1": "Center: midpoint of Oak and Elm", "2": "Center: Oak only; Elm has no coordinates", "3": "Center: Elm (the project's one substation)",
        "4": "Center: Point 2 only; Ash has no coordinates", "5": "Center: supplied coordinates",
    }
    one = points["1"]
    assert one["label"] == "One\nA · 1\nConfidence: High\nCenter: midpoint of Oak and Elm\nHas coordination candidates"
    assert (one["has_pair"], one["fallback"], one["radius_meters"]) == (True, False, 12.5 * map_layers.METERS_PER_MILE)
    assert (points["2"]["has_pair"], points["2"]["fallback"], points["2"]["radius_meters"]) == (False, True, None)
    ends = sorted((r["project_id"], r["endpoint"], r["latitude"], r["label"].split("\n")[0]) for r in map_layers.endpoint_points(rows).collect())
    assert ends == [("1", 1, 33.0, "Oak substation (Unknown)"), ("1", 2, 34.0, "Elm substation (Unknown)"), ("2", 1, 33.0, "Oak substation (Unknown)"), ("3", 2, 34.0, "Elm substation (Unknown)"), ("4", 2, 35.0, "Point 2 substation (Unknown)")]
    lines = map_layers.endpoint_lines(rows).collect()
    assert [(r["project_id"], r["longitude_2"], r["label"].split("\n")[0]) for r in lines] == [("1", -85.0, "Oak – Elm (1)")]


def test_views(spark, rows):
    view = map_layers.fit_view(rows.where("latitude is not null")).first()
    lats, lons = [33.5, 33.0, 34.0, 35.0], [-84.5, -84.0, -85.0, -86.0]
    spread = max(max(lons) - min(lons), (max(lats) - min(lats)) * 1.25)
    assert tuple(view) == (34.0, -85.0, pytest.approx(math.log2(360 / spread) + 0.8))
    assert map_layers.fit_view(rows.where("project_id = '3'")).first()["zoom"] == 12.0
    assert tuple(map_layers.fit_view(rows.where("false")).first()) == (33.0, -81.0, 6.0) == tuple(map_layers.whole_view(rows.where("false")).first())
    assert map_layers.whole_view(rows).first()["latitude"] == pytest.approx(sum(lats) / 4)


def test_owners_are_checked(spark):
    table = spark.createDataFrame([("B",), ("A",), ("B",), (" ",), (None,)], "utility string")
    assert projects.check_owners(table) == projects.check_owners(table, {"A", "B"}) == ["A", "B"]
    with pytest.raises(projects.ProjectTableError, match="at least two"):
        projects.check_owners(table.where("utility = 'A'"))
    with pytest.raises(projects.ProjectTableError, match="A and C are needed, found: A, B"):
        projects.check_owners(table, {"A", "C"})


def test_labels_that_must_be_there(spark):
    frame = spark.createDataFrame([("First x\ny LAST",), ("none",)], "t string")
    assert [r[0] for r in frame.select(T.text_between(F.col("t"), "first", "last")).collect()] == ["x\ny", None]
    assert frame.where("t <> 'none'").select(T.text_between(F.col("t"), "first", "last", required=True)).first()[0] == "x\ny"
    with pytest.raises(Exception, match="no text between"):
        frame.select(T.text_between(F.col("t"), "first", "last", required=True)).collect()


def test_differences(spark):
    found = spark.createDataFrame([("U", "1", "Oak", "1"), ("U", "2", "", "2")], "utility string, project_id string, project_name string, line_miles string")
    reference = spark.createDataFrame([("U", "1", "oak", "2"), ("U", "2", "Elm", "2.0")], "utility string, project_id string, project_name string, line_miles string")
    rows = evaluation.differences(evaluation.compare_cells(found, reference))
    assert rows.columns == ["utility", "project_id", "column", "outcome", "ai", "reference"]
    assert sorted(map(tuple, rows.collect())) == [("U", "1", "line_miles", "differ", "1", "2"), ("U", "2", "project_name", "blank in AI", "", "Elm")]
