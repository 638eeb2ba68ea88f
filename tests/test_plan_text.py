"""Sections over pages against the joined text cut in one piece; rows counted by their own pass."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import plan_text as P


@pytest.mark.parametrize("pattern", [P.ROW_START, P.DETAIL_HEADER, "X"])
def test_sections_equal_those_of_the_joined_text(spark, pattern):
    draw = random.Random(6)
    lines = ["101 2025 12345 OAK", "  more", "", "OAK - ELM", " Teams # 777 ", "Need Date 6/1/2027 Start Date 1/5/2025 x", "Xtra", "Teams # 1", "a 101 2025 12345 b"]
    block = ["OAK - ELM", "Teams # 42", "Need Date 6/1/2027 Start Date 1/5/2025"]
    pages = []
    for d in range(12):
        whole = [x for _ in range(draw.randint(0, 25)) for x in (block if draw.random() < 0.2 else [draw.choice(lines)])]
        at = sorted(draw.sample(range(len(whole) + 1), min(4, len(whole))))
        cut = [whole[i:j] for i, j in zip([0, *at], [*at, len(whole)])]
        pages += [(d, 3 * k, "\n".join(c)) for k, c in enumerate(cut)]
    frame = spark.createDataFrame(pages, "document int, page int, text string").repartition(3)
    got = {}
    for r in P.cut_pages(frame, pattern).collect():
        got.setdefault(r["document"], []).append((r["part"], r["page"], r["text"].rstrip("\n")))
    for d in range(12):
        own = [(p, t) for x, p, t in pages if x == d]
        text, starts, at = "\n".join(t for _, t in own), [], 0
        for p, t in own:
            starts.append((at, p))
            at += len(t) + 1
        heads = [m.start() for m in re.finditer(rf"(?m)(?=^{pattern})", text)]
        want = [(k + 1, max((s, p) for s, p in starts if s <= h)[1], text[h:e].rstrip("\n")) for k, (h, e) in enumerate(zip(heads, [*heads[1:], len(text)]))]
        if all(len(t.split("\n")) > 1 for _, t in own):  # a header of three lines lies on two pages
            assert sorted(got.get(d, [])) == want
        elif pattern != P.DETAIL_HEADER:
            assert sorted(got.get(d, [])) == want


def _pages(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "document string, page int, text string")


CAPTION, TOTAL = f"{P.TABLE_CAPTION}\n", "Total REDACTED\n"


def test_rows_are_counted_by_the_pass_that_parses_them(spark):
    good = _pages(spark, CAPTION + "101 2025 12345 OAK", "ELM 6/1/2027 GPC REDACTED\n102 2025 12346 PINE 6/1/2028 GTC REDACTED\n" + TOTAL + "103 2025 1 x")
    rows, check = P.reconciled_rows(good)
    assert sorted((r["project_id"], r["project_name"], r["page"]) for r in rows.collect()) == [("12345", "OAK ELM", 0), ("12346", "PINE", 1)]
    assert check() == {"starts": 2, "complete": 2, "swallowed": 0}
    for texts, why in (
        ([CAPTION + "101 2025 12345 OAK 6/1/2027 GPC REDACTED\n102 2025 12346 PINE 6/1/2028\n" + TOTAL], "2 row starts but 1 complete"),
        ([CAPTION + "101 2025 12345 OAK TEAMS ELM 6/1/2027 GPC REDACTED\n" + TOTAL], "swallowed"),
        ([CAPTION + TOTAL], "no rows"),
    ):
        rows, check = P.reconciled_rows(_pages(spark, *texts))
        rows.write.format("noop").mode("overwrite").save()
        with pytest.raises(P.PlanTableError, match=why):
            check()


def test_counts_of_each_documents_table(spark):
    row = "101 2025 {} OAK 6/1/2027 GPC REDACTED\n"
    texts = {
        "a": CAPTION + row.format(11111) + row.format(11112) + TOTAL, "b": CAPTION + row.format(11111) * 2 + TOTAL, "c": "nothing", "d": CAPTION + row.format(11111),
        "e": CAPTION + row.format(11111) + "102 2025 22222 y\n" + TOTAL, "f": CAPTION + TOTAL, "g": None,
    }
    frame = spark.createDataFrame([(d, 1, t) for d, t in texts.items()], "document string, page int, text string")
    got = {r["document"]: (r["starts"], r["complete"], r["duplicates"], r["problem"]) for r in P.table_counts(frame).collect()}
    none = (0, 0, 0, "table caption not found")
    assert got == {
        "a": (2, 2, 0, None), "b": (2, 2, 1, "project IDs are there twice"), "c": none, "d": (1, 1, 0, "end of the table not found"),
        "e": (2, 1, 0, "the table has 2 row starts but 1 complete rows; a row's layout changed"), "f": (0, 0, 0, "the table has no rows"), "g": none,
    }


def test_a_key_that_is_there_twice_is_a_data_problem(spark):
    from tessera.operators import cleaning

    columns = ["project_id", "utility", "start_date", "in_service_date", "project_type", "project_name", "location_2", "line_miles"]
    rows = spark.createDataFrame([("1", "A", "", "", "LINE", "n", "", ""), ("1", "A", "", "", "LINE", "n", "", ""), ("1", "B", "2025-02-01", "2025-01-01", "LINE", "n", "", "")], columns)
    assert sorted(map(tuple, cleaning.data_problems(rows).collect())) == [("1", "appears 2 times for A"), ("1", "starts after it is in service")]
    assert cleaning.data_problems(rows.where(F.lit(False))).collect() == []
