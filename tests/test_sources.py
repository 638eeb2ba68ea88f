"""Ragged CSV over range borders, the look-up cache, work in steps, trimmed JSON."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import nested
from tessera.sources import ragged
from tessera.sources.lookup_cache import LookupCache
from tessera.streaming import progress


def _ragged_text(seed, n):
    draw = random.Random(seed)
    bits = ["a", "", " ", "b,c", 'say "x"', '"', "line\nbreak", "crlf\r\nin", '""', "é中", ",", "x" * 30, '\n"\n', 'mid"dle']
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    for _ in range(n):
        if draw.random() < 0.1:
            out.write(draw.choice(["\n", "plain,mid\"quote,z\n", '"a"tail,b\n', "end\r\n", '"q\nr"tail"s,2\n']))
        else:
            writer.writerow(draw.choices(bits, k=draw.randint(1, 6)))
    return out.getvalue()


@pytest.mark.parametrize("size", ["64b", "300b", "1m"])
def test_ragged_records_over_range_borders(spark, tmp_path, size):
    texts = {"one.csv": "﻿" + _ragged_text(1, 120), "two.csv": _ragged_text(2, 90).rstrip("\n"), "three.csv": 'a,b\n"never closed,\nx""y\n'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        got = {}
        for r in ragged.records(spark, str(tmp_path)).collect():
            got.setdefault(r["file"].rsplit("/", 1)[1], {})[r["line"]] = r["cells"]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, text in texts.items():
        want = [row or [""] for row in csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""))]
        if name == "three.csv":
            want[-1][-1] = want[-1][-1].removesuffix("\n")  # the line end behind a cell that is never closed is not told apart
        assert [got[name][k] for k in sorted(got[name])] == want and sorted(got[name]) == list(range(len(want)))


def test_a_cache_keeps_misses_and_drops_failures(spark, tmp_path):
    cache = LookupCache(spark, f"file://{tmp_path}/cache")
    asked = []

    def fetch(keys):
        names = sorted(r["key"] for r in keys.collect())
        asked.append(names)
        return spark.createDataFrame([(k, None if k == "miss" else k.upper(), k == "down") for k in names], "key string, value string, failed boolean")

    requests = spark.createDataFrame([("oak",), ("miss",), ("down",), ("oak",), (None,)], "key string")
    got = {r["key"]: (r["value"], r["found"]) for r in cache.look_up(requests, fetch).collect()}
    assert got == {"oak": ("OAK", True), "miss": (None, False), "down": (None, None)}
    cache.look_up(requests.unionByName(spark.createDataFrame([("elm",)], "key string")), fetch)
    assert asked == [["down", "miss", "oak"], ["down", "elm"]]
    cache.upsert(spark.createDataFrame([("oak", "new", False), ("oak", None, True)], "key string, value string, failed boolean"))
    assert {r["key"]: r["value"] for r in cache.read().collect()} == {"oak": "new", "miss": None, "elm": "ELM"}
    assert len(list((tmp_path / "cache" / "versions").iterdir())) == 2


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    cache = LookupCache(spark, f"file://{tmp_path}/cache")
    row = lambda k, v: spark.createDataFrame([(k, v, False)], "key string, value string, failed boolean")
    first = cache.upsert(row("a", "1"))
    with pytest.raises(Exception, match="boom"):  # dies while it writes
        cache.upsert(row("b", "2").withColumn("value", F.raise_error(F.lit("boom")).cast("string")))
    monkeypatch.setattr(LookupCache, "_point_to", lambda self, name: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # dies before it points to what it wrote
        cache.upsert(row("b", "2"))
    monkeypatch.undo()
    again = LookupCache(spark, f"file://{tmp_path}/cache")
    assert again.version() == first and [r["key"] for r in again.read().collect()] == ["a"]
    again.upsert(row("c", "3"))
    assert sorted(r["key"] for r in again.read().collect()) == ["a", "c"]
    (tmp_path / "cache" / "current").write_text("gone")
    (tmp_path / "cache" / ".current.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="no whole version"):
        again.upsert(row("d", "4"))
    (tmp_path / "cache" / "current").unlink()
    with pytest.raises(ValueError, match="no file current"):
        again.read()


def test_a_stopped_run_goes_on_without_doing_a_row_twice(spark, tmp_path):
    source, out, notes = (f"file://{tmp_path}/{x}" for x in ("source", "out", "notes"))
    spark.range(30).repartition(5).selectExpr("id", "id % 4 AS k").write.parquet(source)
    schema = "id long, k long"
    tally = spark.sparkContext.accumulator(0)
    state = {"steps": 0}

    def work(rows):
        state["steps"] += 1
        if state["steps"] == 3:
            raise RuntimeError("stopped")
        tally.add(rows.count())
        return rows.withColumn("twice", F.col("id") * 2)

    with pytest.raises(Exception, match="stopped"):
        progress.work_in_steps(spark, source, schema, work, out, notes)
    before = progress.finished(spark, out).count()
    assert 0 < before < 30
    assert progress.work_in_steps(spark, source, schema, work, out, notes) == 3
    assert sorted(r["id"] for r in progress.finished(spark, out).collect()) == list(range(30)) and tally.value == 30
    assert progress.work_in_steps(spark, source, schema, work, out, notes) == 0
    spark.range(30, 33).selectExpr("id", "id % 4 AS k").coalesce(1).write.mode("append").parquet(source)
    assert progress.work_in_steps(spark, source, schema, work, out, notes) == 1
    assert progress.finished(spark, out).count() == 33


def test_csv_with_a_mark(spark, tmp_path):
    progress.write_csv_with_mark(spark.createDataFrame([("x", 'a "b"')], "b string, a string").coalesce(1), f"{tmp_path}/o", ["a", "c", "b"])
    text = next((tmp_path / "o").glob("part-*.csv")).read_bytes()
    assert text == b'\xef\xbb\xbfa,c,b\n"a ""b""",,x\n'
    with pytest.raises(ValueError, match="no place"):
        progress.write_csv_with_mark(spark.createDataFrame([("x",)], "z string"), f"{tmp_path}/p", ["a"])


def test_features_are_trimmed(spark):
    whole = {"type": "way", "id": 9007199254740993, "center": {"lat": 1.5, "lon": -2}, "nodes": [1, 2], "tags": {"name": "Oak \"x\"", "voltage": "115000", "power": "substation"}}
    cases = {json.dumps(whole): {"type": "way", "id": 9007199254740993, "center": {"lat": 1.5, "lon": -2}, "tags": {"name": "Oak \"x\"", "voltage": "115000"}}, '{"id": null}': {"id": None, "tags": {}}, "{}": {"tags": {}}, "no json": None, "[1]": None}
    frame = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    got = {r["t"]: r["o"] for r in frame.select("t", nested.trim_feature(F.col("t")).alias("o")).collect()}
    assert {k: v and json.loads(v) for k, v in got.items()} == cases | {None: None}


def test_rows_are_numbered_in_the_order_of_their_files(spark, tmp_path):
    from tessera.sources import tables

    for name, n in (("a", 3), ("b", 400), ("c", 2)):  # Spark packs files by size
        (tmp_path / f"{name}.csv").write_text("v\n" + "".join(f"{name}{i}\n" for i in range(n)))
    rows = tables.numbered(tables.read_text_csv(spark, str(tmp_path))).collect()
    want = [f"{name}{i}" for name, n in (("a", 3), ("b", 400), ("c", 2)) for i in range(n)]
    assert [r["v"] for r in sorted(rows, key=lambda r: r["number"])] == want and sorted(r["number"] for r in rows) == list(range(1, 406))


def test_saved_tables_with_evidence(spark, tmp_path):
    from tessera.sources import evidence

    (tmp_path / "p.csv").write_text("utility,project_id,project_name,project_type,voltage_1,voltage_2,location_1,table_page,detail_page\nA,1,One,LINE,,,old,10,12\nA,2,Two,LINE,46000,,Elm,11,\nB,1,Other,LINE,,,,,\n")
    (tmp_path / "e.csv").write_text(
        "utility,project_id,location_role,target_location,latitude,longitude,expected_voltages,project_type,confidence,source,osm_type,osm_id,reasons\n"
        "A,1,location_1,Oak,33.0,-84.0,230000;115000,LINE,HIGH,Map feature,way,7,near\nA,1,location_2,Elm,34.0,-84.0,230000;115000,LINE,MEDIUM,Map feature,,,far\n"
        "A,1,location_1,Ash,1.0,1.0,,,LOW,x,,,\nA,1,location_3,Fir,1.0,1.0,,,LOW,x,,,\nA,2,location_1,Elm,,,46000,LINE,HIGH,No match,,,none\n"
    )
    got = {r["project_id"]: r for r in evidence.load_with_evidence(spark, [(f"{tmp_path}/p.csv", f"{tmp_path}/e.csv", "A", "plan.pdf")]).collect()}
    assert set(got) == {"1", "2"}
    one, two = got["1"], got["2"]
    assert (one["point_1_name"], one["point_2_name"], one["latitude"], one["center_method"], one["confidence"]) == ("Oak", "Elm", 33.5, "endpoint_midpoint", "Medium")
    assert (one["voltage"], one["voltage_2"], one["location_source"], one["verification_notes"], one["source_pages"], one["source_file"]) == ("230000", "115000", "Map feature", "Oak: near | Elm: far", "10; 12", "plan.pdf")
    assert (two["voltage"], two["latitude"], two["confidence"], two["location_status"], two["source_pages"]) == ("46000", None, "Low", "Missing", "11")


def test_documents_are_replayed_from_kept_replies(spark):
    from tessera.operators import extraction as X

    pages = spark.createDataFrame([("d", i, f"page {i} " + "x" * 20) for i in range(1, 8)] + [("e", 1, None)], "document string, page int, text string")
    asked = X.document_requests(pages, 60, {"model": F.lit("m")})
    rows = {(r["document"], r["chunk"]): r for r in asked.collect()}
    assert rows["d", 0]["pages"] == [1, 2] and rows["d", 1]["pages"] == [2, 3] and rows["e", 0]["text"] == "=== PAGE 1 ===\n"
    assert rows["d", 0]["text"] == "=== PAGE 1 ===\npage 1 " + "x" * 20 + "\n\n=== PAGE 2 ===\npage 2 " + "x" * 20
    cache = asked.select("key", F.concat(F.lit("r"), F.col("chunk").cast("string")).alias("reply"))
    assert {(r["document"], r["chunk"], r["reply"]) for r in X.replay_documents(pages, cache, 60, {"model": F.lit("m")}).collect()} == {(d, c, f"r{c}") for d, c in rows}
    with pytest.raises(Exception, match="no cached reply"):
        X.replay_documents(pages, cache, 60, {"model": F.lit("other")}).collect()
