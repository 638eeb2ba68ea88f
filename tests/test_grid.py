"""Crowded cells joined in slices; pair tables of any column names; pairs as they are written."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import grid, overlaps


@pytest.mark.parametrize(("na", "nb"), [(150, 400), (400, 150), (1, 900)])
def test_half_of_all_points_in_one_cell(spark, monkeypatch, na, nb):
    most = 2_000
    monkeypatch.setattr(grid, "PAIRS_A_KEY", most)
    draw = random.Random(1)
    near = lambda: (33.0 + draw.random() / 50, -84.0 + draw.random() / 50)
    far = lambda: (draw.uniform(-90, 90), draw.uniform(-180, 180))
    points = {s: [(i, *(near() if i % 2 else far())) for i in range(n)] + [(n + i, 33.0, -84.0) for i in range(20)] for s, n in (("a", na), ("b", nb))}
    a, b = (spark.createDataFrame(points[s], f"id_{s} int, latitude_{s} double, longitude_{s} double").repartition(3) for s in "ab")
    pairs = overlaps.pairs_by_grid(a, b, 20.0)
    got = sorted((r["id_a"], r["id_b"]) for r in pairs.collect())
    every = a.crossJoin(b).where(geo.haversine_miles(*(F.col(c) for c in ("latitude_a", "longitude_a", "latitude_b", "longitude_b"))) <= 20.0)
    assert got == sorted((r["id_a"], r["id_b"]) for r in every.collect()) and len(got) > 100
    a = a.withColumn("_cell", geo.cell_of(F.col("latitude_a"), F.col("longitude_a"), 0.3))
    b = b.withColumn("_cell", geo.cell_of(F.col("latitude_b"), F.col("longitude_b"), 0.3))
    cut = grid.slices(a, b, most)
    sizes = {r["_cell"]: r["count"] for r in a.groupBy("_cell").count().collect()}, {r["_cell"]: r["count"] for r in b.groupBy("_cell").count().collect()}
    for r in cut.collect():
        work = math.ceil(sizes[0][r["_cell"]] / r["_sa"]) * math.ceil(sizes[1][r["_cell"]] / r["_sb"])
        assert work <= 1.2 * most + max(s[r["_cell"]] for s in sizes)


def test_atan2_is_the_same_distance(spark):
    draw = random.Random(2)
    rows = [(draw.uniform(-90, 90), draw.uniform(-180, 180), draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(50)] + [(1.0, 2.0, 1.0, 2.0)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    columns = [F.col(c) for c in "abcd"]
    worst = frame.select(F.max(F.abs(geo.haversine_miles(*columns) - geo.haversine_miles_by_atan2(*(c.cast("string") for c in columns))))).first()[0]
    assert worst < 1e-6
    assert frame.select(geo.haversine_miles_by_atan2(F.lit("x"), *columns[1:])).first()[0] is None


def test_a_pair_table_of_other_names(spark):
    rows = spark.createDataFrame(
        [("A", "1", "B", "9", "1,2.5", "", "17", "2025-01-01", "2025-06-01", "115 kV", "LINE"), ("A", "2", "B", "9", "far", "x", "", "2025-01-01", "2025-01-11", "", "")],
        "`Utility_A` string, `a project id` string, utility_b string, project_id_b string, `Distance Miles` string, days_apart string, ` time_gap ` string, `utility a date` string, `In-Service Date B` string, max_voltage_a string, type_b string",
    )
    projects = spark.createDataFrame([("B", "9", "115000", "SUBSTATION", 1), ("A", "1", "46000", "LINE", 2)], "utility string, project_id string, voltage string, project_type string, order int")
    got = {r["project_id_a"]: r for r in overlaps.rank_table(rows, projects).collect()}
    one, two = got["1"], got["2"]
    assert (one["distance_miles"], one["days_apart"], one["days_apart_score"], one["distance_score"]) == (12.5, 17, 3, 2)
    assert (one["voltage_a"], one["voltage_b"], one["project_type_a"]) == ("46000", "115000", "LINE")  # the project's own column counts before a table's other name
    assert (two["distance_miles"], two["days_apart"], two["distance_score"]) == (None, 10, 0)
    assert (one["rank"], two["rank"]) == (1, 2)


def test_pairs_are_as_written(spark):
    row = lambda u, i, s, e: (u, i, s, e, 33.0, -84.0, None, "High")
    projects = spark.createDataFrame([row("A", "1", "1/5/2025", "soon"), row("B", "2", None, " 2026-02-03 ")], "utility string, project_id string, start_date string, in_service_date string, latitude double, longitude double, region string, confidence string")
    projects = projects.withColumns({c: F.lit("") for c in ("location_status", "match_status")})
    r = overlaps.find_pairs(projects, "A", "B").first()
    assert [r[c] for c in ("start_date_a", "in_service_date_a", "start_date_b", "in_service_date_b", "region_a")] == ["2025-01-05", "soon", "", "2026-02-03", ""]
