"""Project tables, texts, plan pages, locations, evaluation, cleaning, sources and sinks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.functions import text as T
from tessera.operators import cleaning, evaluation, locations, plan_text, projects
from tessera.sources import sinks, tables


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "volts"), [("230/115KV", [230000, 115000]), ("115-13.8 kV", [115000, 13800]), ("46 kV and 46kV", [46000]), ("none", []), ("230- 115KV", [230000, 115000])])
def test_voltages(spark, text, volts):
    assert value(spark, T.voltages_in(F.lit(text))) == volts


@pytest.mark.parametrize(("text", "miles"), [("5.45 miles", [5.45]), ("1 mile, (2.23mi)", [1.0, 2.23]), ("10mile ~15 - mile", [10.0, 15.0]), ("mixed", [])])
def test_miles(spark, text, miles):
    assert value(spark, T.miles_in(F.lit(text))) == miles


@pytest.mark.parametrize(("text", "date"), [("12/31/23", dt.date(2023, 12, 31)), ("1/2/2024", dt.date(2024, 1, 2)), ("2/30/2024", None), ("2024-05-06", dt.date(2024, 5, 6)), ("2024", None), ("soon", None)])
def test_dates(spark, text, date):
    assert value(spark, T.any_date(F.lit(text))) == date


def test_names(spark):
    assert value(spark, T.place_name(F.lit("St. George & Ft Johnson 115 Substation"))) == "saint george and fort johnson 115"
    assert value(spark, T.search_name(F.lit("Evans Primary"))) == "Evans" and value(spark, T.search_name(F.lit("Primary"))) == "Primary"
    for a, b, points in (("oak", "oak", 6), ("oak", "oak hill", 5), ("a b c", "a b d", 2), ("a b c d e", "a b c d f", 4 if 4 / 6 >= 0.67 else 2), ("", "x", 0), ("a", "b", 0)):
        assert value(spark, T.name_points(F.lit(a), F.lit(b))) == points
    assert value(spark, T.tidy(F.lit(" a – b\n c "))) == "a - b c"
    assert value(spark, T.same_text(F.lit("Oak  Hill"), F.lit("oakhill")))


def test_aliases_first_column_wins_and_last_spelling_counts():
    assert projects.canonical_columns(["Name", "Project Name", "id", "LAT", "county/region", "x"]) == {"Name": "project_name", "id": "project_id", "LAT": "latitude", "county/region": "region"}
    assert projects.canonical_columns(["id ", "name", "ID"]) == {"name": "project_name", "ID": "project_id"}
    assert projects.canonical_columns(["project_name_a", "distance"]) is None


def test_normalizing_fills_but_never_relabels(spark):
    table = spark.createDataFrame([("1", " One ", "", "33.5", "x"), ("2", "", "B", "", "y"), ("3", "Three", "B", "bad", "z")], "ID string, `Project-Name` string, operator string, lat string, extra string")
    rows = {r["project_id"]: r for r in projects.normalize_projects(table, "A", "f.csv").collect()}
    assert set(rows) == {"1", "3"} and rows["1"]["utility"] == "A" and rows["3"]["utility"] == "B"
    assert rows["1"]["latitude"] == 33.5 and rows["3"]["latitude"] is None and rows["1"]["source_file"] == "f.csv" and rows["1"]["extra"] == "x"


def test_centers(spark):
    kinds = "project_id string, utility string, point_1_name string, point_1_latitude string, point_1_longitude string, point_2_name string, point_2_latitude string, point_2_longitude string, latitude string, longitude string, start_date string, in_service_date string, confidence string"
    rows = [
        ("both", "A", "a", "30", "-80", "b", "32", "-82", "1", "1", "", "", "HIGH"),
        ("one", "A", "a", "30", "-80", "", "", "", "", "", "", "", "odd"),
        ("half", "A", "a", "30", "-80", "b", "31", "", "", "", "", "", ""),
        ("stale", "A", "a", "", "", "", "", "", "33", "-81", "x", "2024-01-01", ""),
        ("own", "A", "", "", "", "", "", "", "33", "-81", "2025-01-01", "2024-01-01", "low"),
        ("none", "A", "", "", "", "", "", "", "nan", "-81", "", "", ""),
    ]
    got = {r["project_id"]: r for r in projects.prepare_projects(spark.createDataFrame(rows, kinds)).collect()}
    place = {k: (r["latitude"], r["longitude"], r["center_method"]) for k, r in got.items()}
    assert place == {"both": (31.0, -81.0, "endpoint_midpoint"), "one": (30.0, -80.0, "single_location"), "half": (30.0, -80.0, "one_of_two_endpoints"), "stale": (None, None, "unavailable"), "own": (33.0, -81.0, "provided_center"), "none": (None, None, "unavailable")}
    assert got["half"]["data_warnings"] == "Point 2 incomplete or outside coordinate bounds"
    assert got["stale"]["data_warnings"] == "No usable project center; Invalid Start Date"
    assert got["own"]["data_warnings"] == "Start Date is after In-Service Date"
    assert (got["both"]["confidence"], got["one"]["confidence"], got["none"]["location_status"], got["own"]["location_status"]) == ("High", "Low", "Missing", "Candidate")


def test_keys(spark):
    same = spark.createDataFrame([("1", "A"), ("1", "B")], "project_id string, utility string")
    projects.check_keys(same)
    with pytest.raises(projects.ProjectTableError):
        projects.check_keys(same.union(same))
    with pytest.raises(projects.ProjectTableError):
        projects.check_keys(spark.createDataFrame([(" ", "A")], "project_id string, utility string"))


def test_review_keeps_the_first_original(spark):
    kinds = "project_id string, utility string, latitude double, longitude double, center_method string, location_source string, confidence string, location_status string, verification_notes string"
    before = spark.createDataFrame([("1", "A", 1.0, 2.0, "provided_center", "map", "High", "Confirmed", "n"), ("2", "A", 1.0, 2.0, "endpoint_midpoint", "map", "High", "Confirmed", "n")], kinds)
    edit = lambda lat: spark.createDataFrame([("1", "A", lat, 2.0), ("2", "A", lat, 2.0)], "project_id string, utility string, latitude double, longitude double")
    once = projects.apply_location_review(before, edit(5.0)).drop("review_note")
    twice = {r["project_id"]: r for r in projects.apply_location_review(once, edit(6.0)).collect()}
    assert (twice["1"]["latitude"], twice["1"]["original_latitude"], twice["1"]["confidence"], twice["1"]["location_status"]) == (6.0, 1.0, "Low", "Candidate")
    assert twice["2"]["latitude"] == 1.0 and twice["2"]["review_note"]


TITLES = [
    ("EVANS PRIMARY - THURMOND DAM (USA) #5 115KV REBUILD", ["EVANS PRIMARY", "THURMOND DAM"], "LINE", ["USA"]),
    ("ECHECONNEE-WELLSTON 115KV REBUILD", ["ECHECONNEE", "WELLSTON"], "LINE", []),
    ("GTC: GARRETT RD - V. RICA 230KV LINE RECONDUCTOR (CC NET IM)", ["GARRETT ROAD", "VILLA RICA"], "LINE", []),
    ("GORDON-N DUBLIN 115KV (GORDON-ENGL MCI J) REBUILD", ["GORDON", "NORTH DUBLIN"], "LINE", []),
    ("NEW CAVENDER DRIVE - TRIBUTARY 230KV LINE", ["NEW CAVENDER DRIVE", "TRIBUTARY"], "LINE", []),
    ("GTC: ROCKVILLE - TIGER CREEK -WARTHEN 500KV LINES", ["ROCKVILLE", "TIGER CREEK", "WARTHEN"], "MULTI_LINE", []),
    ("THOMASTON 230 NEW BUILD SUB", ["THOMASTON"], "SUBSTATION", []),
    ("SMART VALVES AT EAST VILLA RICA SWITCHING STATION", ["EAST VILLA RICA"], "SUBSTATION", []),
    ("SAV: CC - HYUNDAI MOTORS SAVANNAH AKA. PROJECT EA", ["HYUNDAI MOTORS SAVANNAH"], "SUBSTATION", []),
    ("THALMANN AND COLERAIN 23O KV LINE RELAY PANEL UPGRADES", ["THALMANN", "COLERAIN"], "MULTI_SITE", []),
    ("DOYLE - LG&E MONROE 230KV - JACKS CREEK LOOP IN", ["DOYLE", "LG&E MONROE"], "BOTH", []),
    ("SMART VALVE INSTALLATION", [], "UNKNOWN", []),
]


def test_titles(spark):
    rows = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TITLES)], "i int, project_name string")
    got = {r["i"]: (r["locations"], r["project_type"], r["owner_tags"]) for r in plan_text.parse_titles(rows).collect()}
    assert got == {i: (list(t[1]), t[2], t[3]) for i, t in enumerate(TITLES)}


def test_plan_rows_and_details(spark):
    pages = [
        ("d", 10, "PUBLIC DISCLOSURE\nTable 2 Georgia ITS 10 Year Plan Project List\n101 2025 12345 OAK - ELM\n115KV REBUILD 6/1/2027 GPC REDACTED 1\n"),
        ("d", 11, "102 2026 12346 PINE SUB 5/1/28 GTC REDACTED 2\nTotal REDACTED\n103 2026 99999 LATER 5/1/28 GTC REDACTED"),
        ("d", 12, "OAK - ELM\nTeams # 12345\nNeed Date 6/1/2027 Start Date 1/5/2025\nDescription\nRebuild 5.5 miles\nof line\nREDACTED\nNone\nNew\n"),
    ]
    joined = plan_text.clean_pages(spark.createDataFrame(pages, "document string, page int, text string"))
    rows = {r["project_id"]: r for r in plan_text.plan_projects(joined).collect()}
    assert set(rows) == {"12345", "12346"}
    one = rows["12345"]
    assert (one["project_name"], one["in_service_date"], one["start_date"], one["table_page"], one["detail_page"]) == ("OAK - ELM 115KV REBUILD", dt.date(2027, 6, 1), dt.date(2025, 1, 5), 10, 12)
    assert (one["description"], one["line_miles"], one["change_from_previous_plan"], one["location_2"], one["voltage_1"]) == ("Rebuild 5.5 miles of line", 5.5, "None", "ELM", 115000)
    assert rows["12346"]["table_page"] == 11
    assert [tuple(r)[1:] for r in plan_text.plan_inconsistencies(joined).collect()] == [("12346", "no detail page")]


def test_plan_rows_of_long_ids(spark):
    """An id of seven digits begins a row like any other, in the table, its counts and the comparison with the details."""
    pages = [
        ("d", 1, f"{plan_text.TABLE_CAPTION}\n101 2025 999999 OAK 6/1/2027 GPC REDACTED\n102 2025 1000000 ELM 6/1/2027 GTC REDACTED\n103 2025 123456789012 ASH\nTotal REDACTED"),
        ("d", 2, "OAK\nTeams # 1000000\nNeed Date 7/1/2027 Start Date 1/5/2025\nDescription\nRebuild\nREDACTED\nNone\nNew\n"),
    ]
    pages = spark.createDataFrame(pages, "document string, page int, text string")
    rows = [(r["project_id"], r["project_name"], r["problem"]) for r in plan_text.table_rows(pages).collect()]
    assert sorted(rows) == [("", "", "incomplete row"), ("1000000", "ELM", None), ("999999", "OAK", None)]
    assert [tuple(r)[1:4] for r in plan_text.table_counts(pages).collect()] == [(3, 2, 0)]
    assert ("1000000", "need dates differ") in [tuple(r)[1:] for r in plan_text.plan_inconsistencies(pages).collect()]


def test_page_projects(spark):
    page = "5 Year Budget Oak Line 2.5 miles Project ID 06367 A - C, H Project Description Rebuild Project Need x Planned In-Service Date 5/1/2027 and 6/1/2028 Estimated Project Cost $0 $0 $1,000 $0 $0 $0 $1,000"
    got = plan_text.page_projects(spark.createDataFrame([("d", 1, page), ("d", 2, "nothing")], "document string, page int, text string")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["project_id"], r["project_name"], r["in_service_date"], r["start_date"], r["line_miles"], r["cost_2025"], r["warning"]) == ("06367 A-C, H", "Oak Line 2.5 miles", dt.date(2028, 6, 1), dt.date(2025, 1, 1), 2.5, 1000, None)


def test_chunks_share_a_page(spark):
    pages = spark.createDataFrame([("d", i, "x" * n) for i, n in enumerate([50, 60, 10, 10, 100, 5], 1)], "document string, page int, text string")
    assert [r["pages"] for r in plan_text.chunk_pages(pages, 90).orderBy("chunk").collect()] == [[1, 2], [2, 3, 4], [4, 5], [5, 6]]


def test_locate_prefers_overrides(spark):
    where = spark.createDataFrame([("Georgia Power", "1", "location_1", "Oak Substation", ["115000"], "Georgia"), ("Georgia Power", "1", "location_2", "Elm", [], "Georgia"), ("Georgia Power", "2", "location_1", "Elm", [], "Georgia"), ("Georgia Power", "3", "location_1", "Lost", [], "Georgia")], "utility string, project_id string, location_role string, target_location string, expected_voltages array<string>, state string")
    over = spark.createDataFrame([("Georgia Power", "", "ELM", 31.0, -81.0, "any elm", "s", ""), ("Georgia Power", "2", "elm", None, None, "no elm", "s", "n")], "utility string, project_id string, target_location string, latitude double, longitude double, matched_name string, source string, note string")
    seeds = spark.createDataFrame([("Oak Substation", "Georgia", 33.0, -84.0)], "search_name string, state string, seed_latitude double, seed_longitude double")
    features = spark.createDataFrame([("node", 1, 33.01, -84.0, "Oak", "Georgia Power", "115000"), ("node", 2, 33.3, -84.0, "Oak", "", ""), ("way", 1, 33.0, -85.5, "Oak", "", "")] * 2, "type string, id long, latitude double, longitude double, name string, operator string, voltage string")
    got = {(r["project_id"], r["location_role"]): r for r in locations.locate(where, over, seeds, features).collect()}
    assert [got[k]["source"] for k in (("1", "location_1"), ("1", "location_2"), ("2", "location_1"), ("3", "location_1"))] == ["Map feature", "Manual override", "Manual override", "No match"]
    best = got["1", "location_1"]
    assert (best["latitude"], best["match_score"], best["confidence"]) == (33.01, 11.0, "HIGH")
    assert (got["1", "location_2"]["confidence"], got["2", "location_1"]["confidence"], got["2", "location_1"]["matched_name"]) == ("HIGH", "LOW", "no elm")
    assert locations.check_overrides(over.union(over)).count() == 2


def test_evaluation(spark):
    found = spark.createDataFrame([("U", "1", "Oak  Hill", "1.50", "1; 2", "VERIFIED"), ("U", "2", "", "x", "", "VERIFIED"), ("U", "9", "n", "1", "", "VERIFIED")], "utility string, project_id string, project_name string, line_miles string, miles_mentioned string, status string")
    reference = spark.createDataFrame([("U", "1", "oakhill", "1.5", "1.0;2.0"), ("U", "2", "Elm", "", ""), ("U", "3", "Ash", "", "")], "utility string, project_id string, project_name string, line_miles string, miles_mentioned string")
    cells = {(r["project_id"], r["column"]): r["outcome"] for r in evaluation.compare_cells(found, reference).collect()}
    assert cells == {("1", "project_name"): "same", ("1", "line_miles"): "same", ("1", "miles_mentioned"): "same", ("2", "project_name"): "blank in AI", ("2", "line_miles"): "only in AI", ("2", "miles_mentioned"): "same"}
    states = {r["project_id"]: r["state"] for r in evaluation.match_rows(found, reference).collect()}
    assert states == {"1": "matched", "2": "matched", "3": "missing", "9": "extra"}
    summary = evaluation.verified_summary(evaluation.compare_cells(found, reference)).first()
    assert tuple(summary) == (2, 1, 0)


def test_quotes(spark):
    pages = spark.createDataFrame([("d", i, f"page {i} Oak\nHill") for i in range(1, 7)] + [("d", 7, "nothing")], "document string, page int, text string")
    quotes = spark.createDataFrame([("d", 2, "oak hill"), ("d", 7, "OAK  HILL"), ("d", 1, "absent"), ("e", 1, "oak hill")], "document string, page int, quote string")
    got = [(r["found"], r["elsewhere"]) for r in evaluation.check_quotes(quotes, pages).collect()]
    assert sorted(got) == sorted([(True, []), (False, [1, 2, 3]), (False, []), (False, [])])


def test_quotes_are_whole_words(spark):
    cases = [("Lee", "Leesville line", False), ("Lee", "the lee-side", True), ("115", "1150 kV", False), ("115 kV", "a 115kV line", True), ("oakhill", "Oak\nHill", True), ("a.b", "axb", False), (".b", "a.b", True),
             ("Lee", "Leesville and Lee", True), (r"\\E(x", r"y \\E(x z", True), ("line 1", "baseline 1", False), ("a\u2013b", "a-b", True), ("", "x", False), (" ", "x", False), ("é", "né", False)]
    pages = spark.createDataFrame([(str(i), 1, t) for i, (_, t, _) in enumerate(cases)], "document string, page int, text string")
    quotes = spark.createDataFrame([(str(i), 1, q) for i, (q, _, _) in enumerate(cases)], "document string, page int, quote string")
    got = {int(r["document"]): r["found"] for r in evaluation.check_quotes(quotes, pages).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_dates_of_quotes(spark):
    rows = [("2025-12-31", "by December 31, 2025 or 6/1/27, not 2/30/2025"), ("2025-01-01", "on 2025-01-02"), (None, "summer"), ("soon", "1/2/2025"), ("2025-01-01", "none")]
    frame = spark.createDataFrame(rows, "iso string, quote string").select(dates.dates_in(F.col("quote")).alias("d"), dates.check_date(F.col("iso"), F.col("quote")).alias("c"))
    got = frame.collect()
    assert got[0]["d"] == [dt.date(2025, 12, 31), dt.date(2027, 6, 1)]
    assert [r["c"]["date"] for r in got] == [dt.date(2025, 12, 31), None, None, None, None]
    assert [r["c"]["reason"] for r in got][1:4] == ["2025-01-01 isn't a date in 'on 2025-01-02'", "'summer' gives no day, so it isn't turned into a date", "'soon' isn't a YYYY-MM-DD date"]


def test_descriptions_and_page_problems(spark):
    rows = [("d", "1", 1, 0, 0, "Build a", True), ("d", "1", 1, 0, 1, "line.", True), ("d", "1", 2, 0, 0, "build  A LINE. Long", True), ("d", "1", 3, 0, 0, "a line", True), ("d", "1", 4, 0, 0, "Other", True),
            ("d", "1", 5, 0, 0, "x", True), ("d", "1", 5, 0, 1, "y", False), ("d", "2", 1, 0, 0, "z", False)]
    got = evaluation.merge_descriptions(spark.createDataFrame(rows, "document string, project_id string, page int, place int, piece int, value string, accepted boolean")).collect()
    assert [tuple(r) for r in got] == [("d", "1", "build  A LINE. Long", 2, ["Other"])]
    pages = spark.createDataFrame([("d", i) for i in range(1, 5)], "document string, page int")
    labels = spark.createDataFrame([("d", 1, "project_list"), ("d", 2, "project_list"), ("d", 2, "other"), ("d", 3, "other")], "document string, page int, kind string")
    cited = spark.createDataFrame([("d", 1)], "document string, page int")
    assert sorted((r["page"], r["problem"]) for r in evaluation.page_problems(pages, labels, cited).collect()) == [(2, "labelled other and project_list, but no project was read from it"), (4, "the model didn't label this page")]


def test_ragged_rows(spark, tmp_path):
    header = cleaning.BASE_COLUMNS
    plain = {"project_id": "1", "project_type": "LINE", "voltage_1": "115000.0", "other_locations": "x", "owner_tags": "GTC", "in_service_date": "2025-01-01", "start_date": "2026-01-01"}
    cells = [plain.get(c, "") for c in header]
    two = list(cells)
    for c in ("other_locations", "owner_tags"):
        two.insert(two.index(plain[c]) + 1, "")
    lines = [",".join(header), ",".join(cells), ",".join(two), "", ",".join([*cells, "a", "b", "c"])]
    (tmp_path / "raw.csv").write_text("﻿" + "\n".join(lines) + "\n")
    rows = cleaning.clean_rows(cleaning.realign(tables.read_ragged_csv(spark, str(tmp_path / "raw.csv"), [",".join(header)]), header))
    got = [(r["owner_tags"], r["voltage_1"], r["problems"]) for r in rows.orderBy("line").collect()]
    assert got[:2] == [("GTC", "115000", [])] * 2 and got[2][2] == ["wrong number of values"]
    assert {r["problem"] for r in cleaning.data_problems(rows.where("size(problems) = 0")).collect()} == {"starts after it is in service", "appears 2 times for "}
    with pytest.raises(tables.ProjectTableError):
        tables.read_ragged_csv(spark, str(tmp_path / "raw.csv"), ["other"])


def test_files_and_snapshots_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,name,utility,lat,lon\n001,One,,33.0,-81.0\n002,Two,A,,\n")
    (tmp_path / "b.csv").write_text("Project ID,Project Name,Latitude,Longitude\n1,Uno,33.1,-81.0\n")
    loaded = tables.load_projects(spark, [str(tmp_path / "a.csv")], [str(tmp_path / "b.csv")], "A", "B")
    assert sorted((r["utility"], r["project_id"], r["center_method"]) for r in loaded.collect()) == [("A", "001", "provided_center"), ("A", "002", "unavailable"), ("B", "1", "provided_center")]
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    with pytest.raises(tables.ProjectTableError, match="c.csv.*\n.*PDF"):
        tables.load_projects(spark, [str(tmp_path / "c.csv")], ["plan.pdf"], "A", "B")
    from tessera.operators.overlaps import calculate_overlaps

    ranked = calculate_overlaps(loaded, "A", "B")
    settings = {"utility_a": "A", "utility_b": "B", "threshold_miles": 25, "include_low": True, "ranking_mode": "score"}
    again, told = tables.restore_snapshot(spark, sinks.snapshot(loaded, ranked, settings))
    assert told["threshold_miles"] == 25
    assert [tuple(r) for r in calculate_overlaps(again, "A", "B").select("overlap_id", "total_score").collect()] == [tuple(r) for r in ranked.select("overlap_id", "total_score").collect()]
    for wrong in ({"include_low": "yes"}, {"threshold_miles": 0}, {"ranking_mode": "x"}, {"utility_b": "C"}):
        with pytest.raises(ValueError):
            tables.restore_snapshot(spark, sinks.snapshot(loaded, ranked, settings | wrong))
    sinks.write_ranked(ranked, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == ranked.count()
    with pytest.raises(ValueError):
        sinks.write_ranked(ranked.where("false"), str(tmp_path / "none"))
    points = sinks.map_points(loaded, ranked, 25.0)
    assert sorted((r["project_id"], r["has_pair"]) for r in points.collect()) == [("001", True), ("1", True)]
    assert sinks.map_view(points).first()["zoom"] <= 12 and sinks.map_lines(loaded, ranked).count() == ranked.count()


def test_candidates_of_one_kind_are_scored_once(spark, monkeypatch):
    """60 seeds of 3 kinds and 90 features of 6 kinds are scored as kinds; pairs and the best equal those scored row by row."""
    seeds = spark.range(60).select(F.col("id").alias("seed"), F.lit("Georgia Power").alias("utility"), F.when(F.col("id") % 3 > 0, F.concat_ws(" ", F.lit("Oak"), F.col("id") % 3)).alias("target_location"), F.array(F.lit("115000")).alias("expected_voltages"), F.lit(33.0).alias("seed_latitude"), F.lit(-81.0).alias("seed_longitude"))
    k = F.col("id")
    features = spark.range(90).select(F.lit("node").alias("type"), k, (F.lit(33.0) + k % 2 / 10).alias("latitude"), F.lit(-81.0).alias("longitude"), F.when(k % 3 > 0, F.concat_ws(" ", F.lit("Oak"), k % 3)).alias("name"), F.lit(None).cast("string").alias("operator"), F.lit("115000").alias("voltage"))
    scored = locations.score_candidates(locations.candidates_near(seeds, features))
    columns = sorted(scored.columns)
    listed = lambda rows, *c: sorted(map(str, rows.select(*c).collect()))
    assert listed(locations.scored_near(seeds, features), *columns) == listed(scored, *columns) and scored.count() == 5400
    best = locations.best_near(seeds, features)
    assert listed(best, "seed", "_b.id", "_b.match_score", "_b.confidence", "_b.reasons") == listed(locations.best_candidates(scored, "seed"), "seed", "id", "match_score", "confidence", "reasons")
    assert locations.scored_kinds(seeds, features).count() == 18
