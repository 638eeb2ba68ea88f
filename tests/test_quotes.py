"""Quotes through the gram index, dates as expressions, ranks over ranges: each against a plain version."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tessera.functions import dates
from tessera.functions import text as T
from tessera.operators import overlaps, quotes


def test_index_finds_what_a_comparison_of_all_pages_finds(spark):
    draw = random.Random(4)
    words = ["oak", "Elm", "big", "115", "kV", "line", "the", "süd", "中文", "rebuild", "a", "i", "eee", "oooo", "–"]
    pages = [(d, i, " ".join(draw.choices(words, k=draw.randint(0, 60)))) for d in "xy" for i in range(40)]
    pages += [("x", 90, None), ("x", 91, ""), ("y", 92, "Leesville"), ("y", 93, "at  LEE-side"), ("y", 92, "Leesville")]
    asked = [(draw.choice("xy"), " ".join(draw.choices(words, k=draw.randint(1, 9)))) for _ in range(60)]
    for d, _, t in pages[:20]:
        at = draw.randint(0, 30)
        asked.append((d, t[at : at + draw.randint(1, 60)]))
    asked += [("y", "lee"), ("x", "lee"), ("y", ""), ("y", None), ("x", " "), ("z", "oak"), ("x", "i")]
    page_rows = spark.createDataFrame(pages, "document string, page int, text string").repartition(3)
    quote_rows = spark.createDataFrame(asked, "document string, quote string")
    for whole in (True, False):
        holds = T.holds_words(F.col("text"), F.col("quote")) if whole else F.contains(T.squash(F.col("text")), T.squash(F.col("quote"))) & (T.squash(F.col("quote")) != "")
        wanted = page_rows.join(quote_rows, "document").where(holds).select("document", "quote", "page").distinct()
        got = quotes.pages_holding(quote_rows, page_rows, ["page"], ["document"], whole)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
        everywhere = page_rows.select(F.concat_ws("/", "document", "page").alias("at"), "text").crossJoin(quote_rows.select("quote").distinct()).where(holds).select("quote", "at").distinct()
        assert sorted(map(tuple, quotes.pages_holding(quote_rows, page_rows.select(F.concat_ws("/", "document", "page").alias("at"), "text"), ["at"], whole_words=whole).collect())) == sorted(map(tuple, everywhere.collect()))
    assert quotes.pages_holding(quote_rows.where("quote = ''"), page_rows, ["page"], ["document"]).collect() == []
    assert quotes.pages_holding(quote_rows, page_rows.where("false"), ["page"], ["document"]).collect() == []


def test_index_joins_by_equality_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BROADCAST_BYTES", 0)
    pages = spark.createDataFrame([(i, f"page {i} tells of big bridges") for i in range(30)], "page int, text string")
    found = quotes.pages_holding(spark.createDataFrame([("page 7 tells of BIG bridges",), ("page 1",)], "quote string"), pages, ["page"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(map(tuple, found.collect())) == [("page 1", 1), ("page 7 tells of BIG bridges", 7)]


def _plain_dates(text):
    """Each way scanned on its own, finds in order of their places."""
    text = " ".join(text.replace("–", "-").split())
    found = []
    for pattern, kind in ((r"\b\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})\b", "%m/%d/%Y"), (r"\b\d{4}-\d{1,2}-\d{1,2}\b", "%Y-%m-%d"), (r"\b[A-Za-z]{3,9}\.? \d{1,2},? \d{4}\b", "%b %d %Y")):
        for m in re.finditer(pattern, text):
            said, way = m[0], kind
            if way == "%m/%d/%Y" and len(said.rsplit("/", 1)[1]) == 2:
                way = "%m/%d/%y"
            if way.startswith("%b"):
                parts = re.findall(r"[A-Za-z]+|\d+", said)
                said = f"{parts[0][:3]} {parts[1]} {parts[2]}"
            try:
                found.append((m.start(), dt.datetime.strptime(said, way).date()))
            except ValueError:
                pass
    return [d for _, d in sorted(found)]


def test_dates_equal_separate_scans(spark):
    draw = random.Random(8)
    bits = ["May 5, 2024", "2024-1-2", "2/30/2025", "12/31/69", "1/2/68", "Sept. 3 2031", "Foo 3, 2031", "May 5, 2024-01-02", "by", "–", "7/8/19991", "11/12/2024", "Decem 24, 1999", "2025-13-01", "0000-01-01", ",", "x"]
    texts = [" ".join(draw.choices(bits, k=draw.randint(0, 8))) for _ in range(200)] + ["", "1/2/24"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["d"] for r in frame.select("i", dates.dates_in(F.col("t")).alias("d")).collect()}
    assert got == {i: _plain_dates(t) for i, t in enumerate(texts)}
    assert frame.select(dates.dates_in(F.lit(None).cast("string")).alias("d")).first()["d"] == []


def test_reasons_quote_texts_as_python_does(spark):
    texts = ["plain", "it's", 'say "x"', "it's \"x\"", "a\\b\n\tc\r", "", "é中"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(dates.in_quotes(F.col("t"))).collect()] == [repr(t) for t in texts]
    rows = [("2025-1-01", "1/1/2025"), ("2025-02-30", "1/1/2025"), ("2025-01-01", "1/1/25"), ("2025-01-01", None)]
    told = spark.createDataFrame(rows, "iso string, q string").select(dates.check_date(F.col("iso"), F.col("q")).alias("c")).collect()
    assert [tuple(r["c"]) for r in told] == [
        (None, "'2025-1-01' isn't a YYYY-MM-DD date"), (None, "'2025-02-30' isn't a YYYY-MM-DD date"), (dt.date(2025, 1, 1), ""),
        (None, "no date this program can read in None to check 2025-01-01 against"),
    ]


def test_ranks_of_a_crowded_value_are_spread(spark):
    n = 40_000
    rows = spark.range(n, numPartitions=5).select((F.col("id") % 3 == 0).cast("int").alias("score"), F.lit(1.5).alias("miles"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("key"))
    ranked = overlaps.rank_rows(rows, [F.desc("score"), F.asc("miles"), F.asc("key")], ranges=6)
    got = [tuple(r) for r in ranked.select("rank", "score", "key").orderBy("rank").collect()]
    assert [r[0] for r in got] == list(range(1, n + 1))
    assert [r[1:] for r in got] == sorted((r[1:] for r in got), key=lambda r: (-r[0], r[1]))
    most = overlaps._placed(rows, [F.desc("score"), F.asc("miles"), F.asc("key")], 6).groupBy("_range").count().agg(F.max("count")).first()[0]
    assert most < n / 3  # two thirds of the rows share one value of all but the key
    assert overlaps.rank_rows(rows.where("false"), [F.asc("key")]).collect() == []


def test_a_quote_without_a_page_has_a_reason(spark):
    from tessera.operators import extraction

    pages = spark.createDataFrame([("d", 1, "15 kV")], "document string, page int, text string")
    asked = spark.createDataFrame([("d", None, "15 kV")], "document string, page int, quote string")
    got = extraction.locate_quotes(asked, pages).first()
    assert (got["value"], got["reason"], got["elsewhere"]) == (None, "cites no page", [])
