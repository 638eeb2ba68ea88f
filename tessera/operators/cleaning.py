"""Rows of a ragged project CSV realigned, checked by type, and their data problems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.geo import haversine_miles

# The layouts and value ranges that can be cleaned.
BASE_COLUMNS = [
    "project_id", "utility", "sponsor", "state", "project_name", "project_type",
    "location_1", "location_2", "location_3", "other_locations", "voltage_1", "voltage_2",
    "in_service_date", "start_date", "plan_year", "zone", "owner_tags", "line_miles",
    "miles_mentioned", "description", "change_from_previous_plan", "change_from_previous_irp",
    "detail_need_date", "table_page", "detail_page",
]
COORDINATE_COLUMNS = ["location_1_lat", "location_1_lon", "location_2_lat", "location_2_lon", "center_lat", "center_lon", "confidence_score"]
BLANK_MAY_FOLLOW = ["other_locations", "owner_tags", "location_2_lon"]
DATE_COLUMNS = ["in_service_date", "start_date", "detail_need_date"]
VOLTAGE_COLUMNS = ["voltage_1", "voltage_2"]
INTEGER_COLUMNS = ["plan_year", "table_page", "detail_page"]
PROJECT_TYPES = ["LINE", "SUBSTATION", "BOTH", "MULTI_LINE", "MULTI_SITE", "UNKNOWN"]
CONFIDENCES = ["HIGH", "MEDIUM", "LOW"]
LATITUDES, LONGITUDES = (24.0, 50.0), (-125.0, -66.0)
WORDS_OF_STATIONS = ["SUBSTATION", "SWITCHING STATION", "SWITCHYARD", "TRANSFORMER"]


def _without(places: list[int]) -> Column:
    return F.filter("cells", lambda _, i: ~i.isin(*places))


def realign(rows: DataFrame, header: list[str]) -> DataFrame:
    """(line, one column per header, layout_problem) from (line, cells): a row with n cells too many loses n stray blanks.

    The first n of the columns in BLANK_MAY_FOLLOW are each followed by one.
    """
    slots = [header.index(c) + 1 for c in BLANK_MAY_FOLLOW if c in header]
    extra = F.size("cells") - len(header)
    cells, problem = F.col("cells"), F.when((extra < 0) | (extra > len(slots)), "wrong number of values")
    for n in range(1, len(slots) + 1):
        drop = [s + k for k, s in enumerate(slots[:n])]
        stray = [F.trim(F.coalesce(F.get("cells", F.lit(d)), F.lit(""))) != "" for d in drop]
        problem = F.when((extra == n) & F.greatest(*stray, F.lit(False)), "a stray blank holds a value").otherwise(problem)
        cells = F.when(extra == n, _without(drop)).otherwise(cells)
    rows = rows.select("line", cells.alias("_c"), problem.alias("layout_problem"))
    return rows.select("line", *[F.coalesce(F.get("_c", F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(header)], "layout_problem")


def value_problems(rows: DataFrame) -> Column:
    """An array of what is wrong with a row's values by type."""
    col = F.col
    told = lambda ok, c, what: F.when((col(c) != "") & ~F.coalesce(ok, F.lit(False)), f"{c} is not {what}")
    volts = lambda c: (col(c).try_cast("double") >= 1000) & (col(c).try_cast("double") == F.floor(col(c).try_cast("double")))
    checks = [
        F.when(F.trim("project_id") == "", "blank project_id"),
        F.when(~col("project_type").isin(PROJECT_TYPES), "unknown project_type"),
        *[told(T.iso_date(col(c)).isNotNull(), c, "a date") for c in DATE_COLUMNS],
        *[told(volts(c), c, "whole volts") for c in VOLTAGE_COLUMNS],
        *[told(col(c).rlike(r"^\d+$"), c, "a whole number") for c in INTEGER_COLUMNS],
        told(T.number(col("line_miles")).isNotNull(), "line_miles", "a number"),
        told(F.forall(F.filter(F.split("miles_mentioned", "; "), lambda x: x != ""), lambda x: x.try_cast("double").isNotNull()), "miles_mentioned", "a list of numbers"),
    ]
    if "confidence_score" in rows.columns:
        for c in COORDINATE_COLUMNS[:-1]:
            low, high = LATITUDES if c.endswith("lat") else LONGITUDES
            checks.append(told(col(c).try_cast("double").between(low, high), c, f"between {low} and {high}"))
        checks.append(told(F.upper("confidence_score").isin(CONFIDENCES), "confidence_score", "a known confidence"))
    return F.array_compact(F.array(*checks))


def clean_rows(rows: DataFrame) -> DataFrame:
    """Rows with voltages as whole volts, and problems (array) of layout and values."""
    problems = F.when(F.col("layout_problem").isNotNull(), F.array("layout_problem")).otherwise(value_problems(rows))
    whole = {c: F.when(F.col(c) != "", F.col(c).try_cast("double").cast("long").cast("string")).otherwise("") for c in VOLTAGE_COLUMNS}
    return rows.withColumn("problems", problems).withColumns({c: F.when(F.size("problems") == 0, v).otherwise(F.col(c)) for c, v in whole.items()}).drop("layout_problem")


def data_problems(rows: DataFrame) -> DataFrame:
    """(project_id, problem): what clean rows say that can't all be true."""
    col = F.col
    number = lambda c: col(c).try_cast("double")
    station = F.greatest(*[F.contains(F.upper("project_name"), F.lit(w)) for w in WORDS_OF_STATIONS])
    checks = [
        F.when((col("start_date") != "") & (col("in_service_date") != "") & (col("start_date") > col("in_service_date")), "starts after it is in service"),
        F.when((col("project_type") == "LINE") & station, "a line named like a station"),
        F.when((col("project_type") == "SUBSTATION") & ((col("location_2") != "") | (col("line_miles") != "")), "a substation with a second place or a length"),
    ]
    if "confidence_score" in rows.columns:
        apart = haversine_miles(*[number(c) for c in COORDINATE_COLUMNS[:4]])
        off = haversine_miles(number("center_lat"), number("center_lon"), (number("location_1_lat") + number("location_2_lat")) / 2, (number("location_1_lon") + number("location_2_lon")) / 2)
        checks += [F.when(apart > 2 * number("line_miles"), "endpoints farther apart than twice the line's length"), F.when(off > 0.5, "center is not the midpoint")]
    twice = rows.groupBy("utility", "project_id").count().where("count > 1")
    told = F.concat(F.lit("appears "), F.col("count").cast("string"), F.lit(" times for "), F.col("utility"))
    return rows.select("project_id", F.explode(F.array_compact(F.array(*checks))).alias("problem")).unionByName(twice.select("project_id", told.alias("problem")))
