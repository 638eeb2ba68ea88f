"""Checked values: where quotes stand, what is wrong with projects, owners, rows and runs of pages."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import extraction as X
from tessera.operators import plan_text


def test_quotes_get_the_pages_own_spelling_or_a_reason(spark):
    pages = spark.createDataFrame([("d", 1, "A 115 kV line–Oak\nHill"), ("d", 2, "Oak Hill"), ("d", 3, "LEESVILLE, 15KV"), ("d", 4, "oakhill"), ("d", 5, "Oak Hill 15 kV")], "document string, page int, text string")
    cases = [
        (1, "oak hill", "Oak Hill", ""), (1, "Oak  HILL", "Oak Hill", ""), (1, "line-oak", "line-Oak", ""), (4, "Oak Hill", "oakhill", ""), (3, "15 kV", "15KV", ""),
        (1, "15 kV", None, "not on page 1, but on page 3, 5"), (3, "Lee", None, "not on page 3 or any other page"), (9, "Oak", None, "cites page 9, which wasn't in this run"), (1, " ", None, "empty text"),
    ]
    quotes = spark.createDataFrame([("d", p, q) for p, q, _, _ in cases], "document string, page int, quote string")
    got = {(r["page"], r["quote"]): (r["value"], r["reason"]) for r in X.locate_quotes(quotes, pages).collect()}
    assert got == {(p, q): (v, why) for p, q, v, why in cases}


def test_merging_keeps_the_first_value_and_tells_of_others(spark):
    rows = [
        ("d", "1", "sponsor", 2, 0, "GPC", "GPC", ""), ("d", "1", "sponsor", 1, 5, "GTC", "GTC", ""), ("d", "1", "sponsor", 3, 0, "g t c", "g t c", ""),
        ("d", "2", "sponsor", 1, 0, "x", None, "not on page 1 or any other page"), ("d", "2", "sponsor", 2, 0, "y", "Y", ""),
    ]
    fields, problems = X.merge_checked(spark.createDataFrame(rows, "document string, project_id string, field string, page int, place int, quote string, value string, reason string"))
    assert sorted((r["project_id"], r["value"], r["page"]) for r in fields.collect()) == [("1", "GTC", 1), ("2", "Y", 2)]
    assert sorted((r["project_id"], r["value"], r["reason"]) for r in problems.collect()) == [("1", "GPC", "page 1 says 'GTC' but page 2 says 'GPC'; keeping page 1"), ("2", "", "not on page 1 or any other page")]
    own, stray = X.stray_problems(problems, spark.createDataFrame([("d", "1")], "document string, project_id string"))
    assert (own.count(), stray.count()) == (1, 1)


def test_sanity_and_inventory(spark):
    rows = [
        ("d", "1", "", None, "", "", ["project_name"]), ("d", "2", "Line 12 miles", "1989-01-01", "2061-01-01", "x", []), ("d", "3", "A", "2030-01-01", "2030-01-01", "400 miles", None),
        ("d", "4", "B", "2030-01-01", "2031-01-01", "", []), ("d", "5", "C", "1990-05-05", "", "300 miles", []),
    ]
    got = X.sanity_problems(spark.createDataFrame(rows, "document string, project_id string, project_name string, in_service_date string, start_date string, description string, flagged array<string>")).collect()
    assert sorted((r["project_id"], r["field"], r["reason"]) for r in got) == [
        ("1", "in_service_date", "not found in the document"), ("2", "in_service_date", "year outside 1990-2060"), ("2", "start_date", "starts after its in-service date 1989-01-01"),
        ("2", "start_date", "year outside 1990-2060"), ("3", "miles_mentioned", "mentions more than 300 miles"), ("4", "start_date", "starts after its in-service date 2030-01-01"),
    ]
    projects = spark.createDataFrame([("d", "1"), ("d", "2")], "document string, project_id string")
    listed = spark.createDataFrame([("d", "2", 4), ("d", "3", 9), ("d", "3", 7)], "document string, project_id string, page int")
    got = X.inventory_problems(projects, listed).collect()
    assert sorted((r["project_id"], r["page"], r["reason"]) for r in got) == [("1", None, "the ID pass didn't list this project"), ("3", 7, "listed by the ID pass, but no project was read for it")]


def test_owners(spark):
    sponsors = ["GPC", "sav", "Meag  Power", "", "Acme", None]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sponsors)], "i int, s string")
    got = [tuple(r["o"]) for r in frame.select("i", X.owner_of(F.col("s"), "Georgia Power").alias("o")).orderBy("i").collect()]
    none = ("", "no sponsor found in a mixed-utility plan; utility left blank")
    assert got == [("Georgia Power", ""), ("Georgia Power", ""), ("MEAG Power", ""), none, ("Acme", "unknown Georgia sponsor; utility kept as printed sponsor pending review"), none]
    got = [tuple(r["o"]) for r in frame.select("i", X.owner_of(F.col("s"), "Other Power", "acme").alias("o")).orderBy("i").collect()]
    assert got[3:] == [("Other Power", "")] * 3 and got[0] == ("GPC", "unmapped sponsor differs from document utility; utility kept as printed sponsor pending review")


def test_project_and_review_rows(spark):
    fields = [("d", "1", "project_name", "Oak - Elm 115/230 kV, 12.5 miles", 3), ("d", "1", "sponsor", "GTC", 2), ("d", "1", "description", "Rebuild 4 miles.", 3), ("d", "2", "project_name", "Fir", 9)]
    places = [("d", "1", i, v, 4 + i) for i, v in enumerate(["Oak", "Elm", "OAK", "Ash", "Yew", "Box"])]
    problems = spark.createDataFrame([("d", "2", "start_date", "", "q", None, "why")], "document string, project_id string, field string, value string, quote string, page int, reason string")
    rows = X.project_rows(spark.createDataFrame(fields, "document string, project_id string, field string, value string, page int"), spark.createDataFrame(places, "document string, project_id string, place int, value string, page int"), problems, "Georgia Power", "Georgia")
    got = {r["project_id"]: r.asDict() for r in rows.collect()}
    one = got["1"]
    assert [one[c] for c in ("utility", "location_1", "location_2", "location_3", "other_locations", "voltage_1", "voltage_2")] == ["Georgia Transmission Corporation", "Oak", "Elm", "Ash", "Yew; Box", "230000", "115000"]
    assert [one[c] for c in ("line_miles", "miles_mentioned", "pages", "status")] == ["", "12.5; 4", "2; 3; 4; 5; 7; 8; 9", "VERIFIED"]
    assert (got["2"]["status"], got["2"]["voltage_1"], got["2"]["pages"], got["2"]["line_miles"]) == ("REVIEW", "", "9", "")
    assert [tuple(r) for r in X.review_rows(problems).collect()] == [("d", "2", "start_date", "", "q", "", "why")]


def test_runs_are_shifted_and_halved(spark):
    pages = spark.createDataFrame([(d, i, "x" * 10) for d, n in (("a", 9), ("b", 2)) for i in range(1, n + 1)], "document string, page int, text string")
    runs = plan_text.chunk_pages(pages, 40)
    plain = {(r["document"], r["chunk"]): r["pages"] for r in runs.collect()}
    assert [plain["a", i] for i in range(3)] == [[1, 2, 3, 4], [4, 5, 6, 7], [7, 8, 9]]
    got = {(r["document"], r["chunk"]): r["pages"] for r in X.shifted_chunks(pages, 40).collect()}
    assert got == {("a", 0): [1, 2, 3], ("a", 1): [3, 4, 5, 6], ("a", 2): [6, 7, 8, 9], ("b", 0): [1, 2]}
    half = {r["chunk"]: (r["h"]["first"], r["h"]["second"]) for r in runs.where("document = 'a'").select("chunk", X.halves(F.col("pages")).alias("h")).collect()}
    assert half == {0: ([1, 2, 3], [3, 4]), 1: ([4, 5, 6], [6, 7]), 2: ([7, 8], [8, 9])}
    assert tuple(runs.where("document = 'b'").select(X.halves(F.col("pages")).alias("h")).first()["h"]) == ([1], [2])
    with pytest.raises(Exception, match="single page"):
        spark.range(1).select(X.halves(F.array(F.lit(1)))).collect()


def test_replies_by_key_and_offline(spark):
    asked = spark.createDataFrame([("m", "a"), ("m", "b")], "model string, text string")
    keyed = asked.withColumn("key", X.reply_key({"model": F.col("model"), "text": F.col("text")}))
    keys = {r["text"]: r["key"] for r in keyed.collect()}
    assert len(set(keys.values())) == 2 and all(len(k) == 32 for k in keys.values())
    cache = spark.createDataFrame([(keys["a"], "said")], "key string, reply string")
    assert {r["text"]: r["reply"] for r in X.cached_replies(keyed, cache).collect()} == {"a": "said", "b": None}
    with pytest.raises(Exception, match="no cached reply"):
        X.cached_replies(keyed, cache, replay=True).collect()
    assert spark.range(1).select(X.token_estimate(F.lit(1001), 50, 4.0)).first()[0] == 301


def test_names_of_columns_and_dashed_ids(spark):
    frame = spark.createDataFrame([(" ", "2", "06367 A – C, H")], "` Date Gap Days ` string, time_gap string, id string")
    got = frame.select(T.named(frame, "days_apart", "date gap days", "TIME_GAP"), T.named(frame, "absent"), T.tidy_id(F.col("id"))).first()
    assert tuple(got) == ("2", "", "06367 A-C, H")


def test_two_digit_years(spark):
    frame = spark.createDataFrame([("1/2/68",), ("1/2/69",), ("12/31/99",), ("2/29/00",), ("2/30/01",), ("1/2/025",)], "t string")
    assert [str(r[0]) for r in frame.select(T.us_date(F.col("t"))).collect()] == ["2068-01-02", "1969-01-02", "1999-12-31", "2000-02-29", "None", "None"]


def test_overrides_are_checked(spark, tmp_path):
    from tessera.operators.projects import ProjectTableError
    from tessera.sources import tables

    head = ",".join(tables.OVERRIDE_COLUMNS)
    good = f"﻿{head}\nA,1, Oak ,1.5,-2,,,,me,\nA,,Oak,,,,,,me,x\n"
    bad = {
        "in that order": head.replace("utility,project_id", "project_id,utility") + "\n", "line 3: latitude": f"{head}\nA,1,Oak,1,2,,,,me,\nA,2,Oak,1,,,,,me,\n",
        "line 2: utility": f"{head}\nA,1,Oak,1,2,,,,,\n", "line 3: a second": f"{head}\nA,1,Oak,1,2,,,,me,\nA,1,OAK,3,4,,,,me,\n",
    }
    (tmp_path / "good.csv").write_text(good, encoding="utf-8")
    assert [(r["target_location"], r["latitude"]) for r in tables.read_overrides(spark, f"{tmp_path}/good.csv").collect()] == [("Oak", 1.5), ("Oak", None)]
    for i, (why, text) in enumerate(bad.items()):
        (tmp_path / f"{i}.csv").write_text(text, encoding="utf-8")
        with pytest.raises(ProjectTableError, match=why):
            tables.read_overrides(spark, f"{tmp_path}/{i}.csv")


def test_numbers_lists_and_digests(spark, tmp_path):
    from tessera.sources import tables

    assert sorted(tuple(r) for r in tables.numbered(spark.range(100, 150, numPartitions=7)).collect()) == [(i, i - 99) for i in range(100, 150)]
    (tmp_path / "p.csv").write_text("project_id,utility,state,project_name,project_type,voltage_1,voltage_2,location_1,location_2,location_3\n09,A,SC,n,LINE,115000,,Oak,,Elm\n", encoding="utf-8-sig")
    got = tables.read_locations_csv(spark, f"{tmp_path}/p.csv").first()
    assert (got["number"], got["project_id"], got["voltages"], got["locations"]) == (1, "09", ["115000"], ["Oak", "Elm"])
    files = spark.createDataFrame([(bytearray(b"x"),)], "content binary")
    none = spark.createDataFrame([], "sha256 string, name string")
    assert tables.known_source(files, none).first()["name"] is None
    with pytest.raises(Exception, match="unknown file"):
        tables.known_source(files, none, strict=True).collect()


def test_spellings_are_looked_for_once(spark, monkeypatch):
    kept = []
    durable = getattr(X, "durable", lambda rows: rows)
    monkeypatch.setattr(X, "durable", lambda rows: kept.append(rows.columns) or durable(rows), raising=False)
    pages = spark.createDataFrame([("d", 1, "a 15KV line"), ("d", 2, "a 115KV line")], "document string, page int, text string")
    quotes = spark.createDataFrame([("d", 1, "15 kv"), ("d", 2, "15 kv"), ("d", 3, "15 kv"), ("d", None, "15 kv")], "document string, page int, quote string")
    got = {r["page"]: (r["value"], r["reason"]) for r in X.locate_quotes(quotes, pages).collect()}
    assert got == {1: ("15KV", ""), 2: (None, "not on page 2, but on page 1"), 3: (None, "cites page 3, which wasn't in this run"), None: (None, "cites no page")}
    assert ["document", "page", "quote", "_here", "_own"] in kept
