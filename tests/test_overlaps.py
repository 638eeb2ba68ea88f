"""Goldens of the overlap analysis, and properties of its joins and ranks."""

import random
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.functions import text as T
from tessera.functions.geo import haversine_miles
from tessera.operators import overlaps as O

COLUMNS = "project_id string, utility string, latitude double, longitude double, start_date string, in_service_date string, voltage string, project_type string, line_miles string, region string, confidence string, match_status string, location_status string"
OPEN = S.OPEN_START_OWNER


def project(key, owner, lat, lon, **more):
    row = {"start_date": "2025-01-01", "in_service_date": "2026-01-01", "voltage": "115000", "project_type": "LINE", "line_miles": "3", "region": "", "confidence": "High", "match_status": "Matched", "location_status": ""} | more
    return (key, owner, lat, lon, *row.values())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_haversine_goldens(spark):
    assert value(spark, haversine_miles(*map(F.lit, (0.0, 0.0, 0.0, 180.0)))) == pytest.approx(math.pi * 3958.8)
    assert value(spark, haversine_miles(*map(F.lit, (33.1, -81.2, 33.1, -81.2)))) == 0


def test_grid_join_equals_nested_loop(spark):
    for lat0 in (0.0, 33.0, 71.0):
        a = spark.range(60).select(F.concat_ws("", F.lit("a"), "id").alias("id_a"), (F.lit(lat0) + (F.col("id") * 37 % 100) / 90.0).alias("latitude_a"), (F.lit(-85.0) + (F.col("id") * 71 % 100) / 45.0).alias("longitude_a"))
        b = spark.range(80).select(F.concat_ws("", F.lit("b"), "id").alias("id_b"), (F.lit(lat0) + (F.col("id") * 53 % 100) / 90.0).alias("latitude_b"), (F.lit(-85.0) + (F.col("id") * 29 % 100) / 45.0).alias("longitude_b"))
        got = sorted(tuple(r) for r in O.pairs_by_grid(a, b, 20.0).select("id_a", "id_b").collect())
        want = sorted(tuple(r) for r in a.join(b).where(haversine_miles(*map(F.col, ("latitude_a", "longitude_a", "latitude_b", "longitude_b"))) <= 20).select("id_a", "id_b").collect())
        assert got == want and len(got) == len(set(got)) > 0


@pytest.mark.parametrize("miles", [25.0, 300.0, 4000.0, 9000.0])
def test_grid_join_equals_nested_loop_on_the_whole_globe(spark, miles):
    r = random.Random(int(miles))
    poles = [(90.0, 0.0), (89.9, 10.0), (89.9, -170.0), (-90.0, 77.0), (-89.95, 180.0), (0.0, 180.0), (0.1, -180.0), (0.0, 179.95), (0.0, -179.95), (89.5, -179.9), (89.5, 179.9), (0.0, 0.0)]
    points = poles + [(math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for _ in range(150)] + [(r.uniform(88, 90), r.uniform(-180, 180)) for _ in range(40)]
    a, b = (spark.createDataFrame([(i, *p) for i, p in enumerate(points)], f"id_{s} int, latitude_{s} double, longitude_{s} double") for s in "ab")
    got = sorted(tuple(x) for x in O.pairs_by_grid(a, b, miles).select("id_a", "id_b").collect())
    want = sorted(tuple(x) for x in a.crossJoin(b).where(O._distance() <= miles).select("id_a", "id_b").collect())
    assert got == want


def test_threshold_is_tested_unrounded(spark):
    degrees = 25.004 / (3958.8 * math.pi / 180)
    rows = spark.createDataFrame([project("1", "A", 33.0, -81.0), project("2", "B", 33.0 + degrees, -81.0)], COLUMNS)
    assert O.find_pairs(rows, "A", "B", 25.0).count() == 0
    assert O.find_pairs(rows, "A", "B", 25.01).count() == 1


@pytest.mark.parametrize("bad", [("A", "A", 25.0), ("", "B", 25.0), ("A", "B", 0.0), ("A", "B", math.inf), ("A", "B", math.nan)])
def test_bad_parameters(spark, bad):
    with pytest.raises(ValueError):
        O.find_pairs(spark.createDataFrame([], COLUMNS), *bad)


def test_excluded_and_low_rows(spark):
    rows = spark.createDataFrame(
        [project("1", "A", 33.0, -81.0), project("2", "A", 33.0, -81.0, confidence="Low"), project("3", "A", 33.0, -81.0, match_status="EXCLUDED"), project("4", "A", 33.0, -81.0, location_status="Excluded"), project("5", "A", 95.0, 0.0), project("6", "A", float("nan"), 0.0), project("7", "A", None, None)],
        COLUMNS,
    )
    ids = lambda low: sorted(r["project_id"] for r in O.eligible_projects(rows, low).collect())
    assert ids(True) == ["1", "2"] and ids(False) == ["1"]


@pytest.mark.parametrize(
    ("a", "b", "state"),
    [
        ((OPEN, "", "2026-01-01"), ("B", "2025-01-01", "2025-06-01"), "overlap"),
        (("A", "", "2026-01-01"), ("B", "2025-01-01", "2025-06-01"), "unavailable"),
        (("A", "soon", "2026-01-01"), ("B", "", "2025-06-01"), "inconsistent"),
        (("A", "", "2026-01-01"), ("B", "soon", "2025-06-01"), "unavailable"),
        (("A", "2025-01-01", ""), ("B", "2025-01-01", "2025-06-01"), "unavailable"),
        (("A", "2027-01-01", "2026-01-01"), ("B", "2025-01-01", "2025-06-01"), "inconsistent"),
        (("A", "2025-06-01", "2026-01-01"), ("B", "2025-01-01", "2025-06-01"), "overlap"),
        (("A", "2025-06-02", "2026-01-01"), ("B", "2025-01-01", "2025-06-01"), "apart"),
    ],
)
def test_timeline_states(spark, a, b, state):
    date = lambda x: T.iso_date(F.lit(x))
    bad = [T.filled(F.lit(x[1])) & date(x[1]).isNull() for x in (a, b)]
    assert value(spark, S.timeline_state(F.lit(a[0]), date(a[1]), date(a[2]), F.lit(b[0]), date(b[1]), date(b[2]), *bad)) == state


def test_scores_at_their_edges(spark):
    for miles, points in ((5.0, 3), (5.01, 2), (15.0, 2), (25.0, 1), (25.01, 0), (None, 0)):
        assert value(spark, S.distance_score(F.lit(miles).cast("double"))) == points
    for days, points in ((30, 3), (31, 2), (180, 2), (365, 1), (366, 0), (None, 0)):
        assert value(spark, S.days_score(F.lit(days).cast("long"))) == points
    for a, b, points in (("115 kV", "115000", 3), ("115", "115000", 3), ("230000", "225 kV", 2), ("46000", "230000", 1), ("", "115000", 0), ("inf", "115000", 0)):
        assert value(spark, S.voltage_score(T.volts(F.lit(a)), T.volts(F.lit(b)))) == points
    for a, b, points in (("line", "MULTI LINE", 3), ("LINE", "MULTI_SITE", 2), ("LINE", "SUBSTATION", 0), ("", "LINE", 0)):
        assert value(spark, S.kind_score(T.project_kind(F.lit(a)), T.project_kind(F.lit(b)))) == points


def test_whole_analysis_and_both_modes(spark):
    rows = spark.createDataFrame(
        [
            project("A1", OPEN, 33.0, -81.0, start_date="", in_service_date="2026-01-01"),
            project("A2", OPEN, 33.5, -81.0, in_service_date="2026-01-01", voltage="46000", project_type="SUBSTATION"),
            project("B1", "Georgia Power", 33.1, -81.0, in_service_date="12/31/2025", line_miles="1", voltage="230 kV"),
            project("B2", "Georgia Power", 33.52, -81.0, start_date="2030-01-01", in_service_date="2031-01-01"),
        ],
        COLUMNS,
    )
    got = [r.asDict() for r in O.calculate_overlaps(rows, OPEN, "Georgia Power", 10.0).orderBy("rank").collect()]
    assert [r["overlap_id"] for r in got] == [f"{OPEN}:A1 | Georgia Power:B1", f"{OPEN}:A2 | Georgia Power:B2"]
    first = got[0]
    assert (first["total_score"], first["days_apart"], first["timeline_overlap"], first["rank"]) == (2 + 3 + 3 + 1 + 3, 1, "Yes", 1)
    assert first["ranking_reason"].endswith("miles; build windows overlap; 1 days apart; different known voltages; matching line type")
    assert (first["shared_miles"], first["row_width_feet"], first["land_value_per_acre"]) == (1.0, 100, 4925.0)
    assert first["land_saved_acres"] == pytest.approx(12.1212, abs=1e-4)
    assert first["impact_explanation"].startswith("If both lines shared one corridor for the shorter line's 1 miles, the narrower 100-foot easement")
    assert got[1]["impact_explanation"] == "No estimate: A2 is not line work."
    close = O.calculate_overlaps(rows, OPEN, "Georgia Power", 10.0, mode="distance_first").orderBy("rank").collect()
    assert [r["overlap_id"][-2:] for r in close] == ["B2", "B1"]
    assert O.calculate_overlaps(rows, OPEN, "Nobody").columns == list(got[0])


def test_ranks_are_a_permutation_and_best_pairs(spark):
    from tessera.plans.proxies import OWNER_A, OWNER_B, projects

    scored = O.score_pairs(O.find_pairs(projects(spark, "/root/testdata/sf0.001"), OWNER_A, OWNER_B, 60.0))
    for mode in O.MODES:
        ranks = sorted(r["rank"] for r in O.rank_pairs(scored, mode).select("rank").collect())
        assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 10
    assert O.find_pairs(projects(spark, "/root/testdata/sf0.001"), OWNER_A, OWNER_B, 30.0).count() <= len(ranks)


def test_enrichment_fills_only_missing_columns(spark):
    pairs = spark.createDataFrame([("A", "1", "B", "2", "")], "utility_a string, project_id_a string, utility_b string, project_id_b string, voltage_a string")
    more = spark.createDataFrame([("A", "1", "115", "old", 1), (" A", "1 ", "230", "new", 2), ("", "2", "500", "x", 3)], "utility string, project_id string, voltage string, note string, place int")
    row = O.enrich_pairs(pairs, more, "place").first()
    assert (row["voltage_a"], row["note_a"], row["voltage_b"], row["note_b"]) == ("", "new", None, None)


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"project_type": "SUBSTATION"}, "A1 is not line work"),
        ({"line_miles": ""}, "A1 has no single line length in its plan"),
        ({"line_miles": "0"}, "A1 has no single line length in its plan"),
        ({"voltage": "46000"}, "A1's voltage has no typical easement width"),
        ({"voltage": ""}, "A1's voltage has no typical easement width"),
        ({"utility": "Elsewhere"}, "A1 is in no state with a land value"),
    ],
)
def test_reasons_for_no_estimate(spark, change, reason):
    owner = change.pop("utility", OPEN)
    rows = spark.createDataFrame([project("A1", owner, 33.0, -81.0, **change), project("B1", "Georgia Power", 33.0, -81.0)], COLUMNS)
    assert O.calculate_overlaps(rows, owner, "Georgia Power").first()["impact_explanation"] == f"No estimate: {reason}."


def _many_at_few_points(spark):
    """60 projects of either owner at five points each, with dates, voltages and types of several kinds, some unusable."""
    rows = []
    for owner, step in ((OPEN, 0.0), ("Georgia Power", 0.05)):
        for k in range(60):
            more = {"start_date": ["", "1/5/2025", "soon", "2026-06-01"][k % 4], "in_service_date": ["2026-01-01", "", "2026-02-01"][k % 3], "voltage": ["115 kV", "46000", ""][k % 3 - 1], "project_type": ["LINE", "MULTI_SITE", "SUBSTATION"][k % 3], "match_status": "Excluded" if k % 11 == 0 else ""}
            rows.append(project(f"{owner[0]}{k}", owner, 33.0 + k % 5 / 4 + step, (-81.0, -0.0, 0.0)[k % 5 % 3], **more))
    return spark.createDataFrame(rows, COLUMNS)


def test_rows_of_shared_points_give_the_same_pairs(spark, monkeypatch):
    """Points are joined once and their rows after them; every column equals that of pairs found row by row and read pair by pair."""
    rows = _many_at_few_points(spark)
    got = O.estimate_land(O.score_pairs(O.find_pairs(rows, OPEN, "Georgia Power"))).drop("_n")
    met = O.near_points(*O._sides(O.eligible_projects(rows), OPEN, "Georgia Power"), 25.0)
    want = O.estimate_land(O.score_pairs(met.withColumn("days_apart", O.days_apart())))
    assert set(want.columns) == set(got.columns)
    listed = lambda x: sorted(map(str, x.select(*sorted(want.columns)).collect()))
    assert listed(got) == listed(want) and got.count() > 300


def test_distances_are_computed_for_points_not_rows(spark, monkeypatch):
    joined = []
    near = O.near_points
    monkeypatch.setattr(O, "near_points", lambda a, b, miles: joined.append((a.count(), b.count())) or near(a, b, miles))
    assert O.find_pairs(_many_at_few_points(spark), OPEN, "Georgia Power").count() > 300
    assert joined == [(5, 5)]


def test_figures_without_pairs_equal_those_of_pairs(spark):
    rows = _many_at_few_points(spark)
    pairs = O.score_pairs(O.find_pairs(rows, OPEN, "Georgia Power"))
    with_pairs = O.both_sides(pairs).distinct()
    assert sorted(map(tuple, O.projects_in_pairs(rows, OPEN, "Georgia Power").collect())) == sorted(map(tuple, with_pairs.collect()))
    got = O.overlap_kpis(rows, OPEN, "Georgia Power").first()
    assert tuple(got) == (120, O.eligible_projects(rows).count(), pairs.count(), pairs.where("timeline_overlap = 'Yes'").count(), with_pairs.count()) and 0 < got["overlapping_windows"] < got["pairs"]
    assert tuple(O.overlap_kpis(rows, OPEN, "Nobody").first())[2:] == (0, 0, 0)


def test_ranks_by_classes_equal_those_of_all_pairs_sorted(spark):
    rows = _many_at_few_points(spark).where("project_id rlike '[0-4]$'")
    rows = rows.union(rows.withColumn("project_id", F.concat("project_id", F.lit("x"))))
    found = O.score_classes(rows, OPEN, "Georgia Power")
    pairs = O.durable(O.score_pairs(O.find_pairs(rows, OPEN, "Georgia Power")))
    names = ["rank", "utility_a", "project_id_a", "utility_b", "project_id_b", "total_score"]
    listed = lambda x: sorted(map(tuple, x.select(*names).collect()))
    assert found.pairs.count() < pairs.count() / 3 > 100
    for mode in O.MODES:
        assert listed(O.ranked_pairs(found, mode, "total_score")) == listed(O.rank_pairs(pairs, mode))
    want = O.best_pairs(O.rank_pairs(pairs)).collect()
    assert sorted(map(tuple, O.best_of_classes(found).collect())) == sorted(map(tuple, want)) and len(want) > 50


def test_pairs_of_classes_are_scored_once(spark):
    """All columns of scored_pairs are those of pairs scored one by one, and a condition on sides is that on their pairs."""
    rows = _many_at_few_points(spark)
    want = O.durable(O.score_pairs(O.find_pairs(rows, OPEN, "Georgia Power")).drop("_n"))
    got = O.scored_pairs(rows, OPEN, "Georgia Power").drop("_class_a", "_class_b")
    assert set(got.columns) == set(want.columns)
    listed = lambda x: sorted(map(str, x.select(*sorted(want.columns)).collect()))
    assert listed(got) == listed(want)
    known = O.score_classes(rows, OPEN, "Georgia Power", keep=lambda s: F.col(f"_land_{s}.missing").isNull()).rows()
    priced = O.estimate_land(want).where("shared_miles is not null")
    assert sorted(r[0] for r in known.select("overlap_id").collect()) == sorted(r[0] for r in priced.select("overlap_id").collect()) and priced.count() > 0


def _written(monkeypatch):
    """The numbers of rows of all tables written from now on."""
    from tessera.operators import grid

    sizes, write = [], O.durable

    def counted(rows, *session):
        table = write(rows, *session)
        sizes.append(table.count())
        return table

    for module in (O, grid):
        monkeypatch.setattr(module, "durable", counted)
    return sizes


def _no_two_alike(spark, n=120):
    """n projects of either owner at four points, no two of which agree in their dates."""
    rows = [project(f"{owner[0]}{k * 37 % n}", owner, 33.0 + k % 4 / 10 + step, -81.0, in_service_date=f"20{26 + k // 28}-02-{k % 28 + 1:02}") for owner, step in ((OPEN, 0.0), ("Georgia Power", 0.05)) for k in range(n)]
    return spark.createDataFrame(rows, COLUMNS)


def test_no_table_of_pairs_is_written(spark, monkeypatch):
    """Nothing of the size of pairs is written, though each project is a class of its own; gathered in small pieces and dealt to slices on both sides, pairs are the same."""
    from tessera.operators import grid

    rows = _no_two_alike(spark)
    want = O.score_pairs(O.find_pairs(rows, OPEN, "Georgia Power")).select("overlap_id", "total_score", "ranking_reason").collect()
    monkeypatch.setattr(grid, "PAIRS_A_KEY", 100)
    monkeypatch.setattr(O, "GATHERED", 7, raising=False)
    written = _written(monkeypatch)
    got = O.score_classes(rows, OPEN, "Georgia Power").rows().select("overlap_id", "total_score", "ranking_reason").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10_000
    assert max(written) < 1_000


def test_ranks_write_no_table_of_pairs(spark, monkeypatch):
    """Ranks are counted in the tasks that hold a distance, a crowded one in slots by the order before names; nothing of the size of pairs is written."""
    from tessera.operators import grid

    rows = _no_two_alike(spark, 48)
    names = ["rank", "project_id_a", "project_id_b", "total_score"]
    want = O.rank_pairs(O.score_pairs(O.find_pairs(rows, OPEN, "Georgia Power"))).select(*names).collect()
    monkeypatch.setattr(grid, "PAIRS_A_KEY", 50)
    written = _written(monkeypatch)
    got = O.ranked_pairs(O.score_classes(rows, OPEN, "Georgia Power"), "score", "total_score").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 2_000
    assert max(written) < 700
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
