"""Dates that texts write in several ways, read and checked as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# The ways a text writes a date, and the names of months by their first letters.
US_WRITTEN = r"\b\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})\b"
ISO_WRITTEN = r"\b\d{4}-\d{1,2}-\d{1,2}\b"
NAMED_WRITTEN = r"\b[A-Za-z]{3,9}\.? \d{1,2},? \d{4}\b"
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def written_at(text: Column, pattern: str) -> Column:
    """array of (place, said): what a pattern finds in a text and how many characters stand before it.

    The pieces between finds and the finds themselves add up to the text, so their lengths give the places.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    length = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda total, x: total + F.length(x))
    return F.transform(found, lambda said, i: F.struct((length(between, i + 1) + length(found, i)).alias("place"), said.alias("said")))


def _numbered(said: Column) -> Column:
    return F.try_to_date(said, "yyyy-M-d")


def _named(said: Column) -> Column:
    month = F.array_position(F.array(*map(F.lit, MONTH_NAMES)), F.lower(F.substring(said, 1, 3)))
    parts = F.regexp_extract_all(said, F.lit(r"\d+"), F.lit(0))
    return _numbered(F.concat_ws("-", F.get(parts, F.lit(1)), month.cast("string"), F.get(parts, F.lit(0))))


def dates_in(text: Column) -> Column:
    """All dates that a text writes as m/d/y, yyyy-mm-dd or "Month d, yyyy", in order; those that don't exist are left out."""
    plain = T.tidy(text)
    days = lambda pattern, way: F.transform(written_at(plain, pattern), lambda x: F.struct(x["place"].alias("place"), way(x["said"]).alias("day")))
    read = F.concat(days(US_WRITTEN, T.us_date), days(ISO_WRITTEN, _numbered), days(NAMED_WRITTEN, _named))
    placed = F.array_sort(F.filter(read, lambda x: F.year(x["day"]) >= 1))  # there is no year 0
    return F.transform(placed, lambda x: x["day"])


def in_quotes(text: Column) -> Column:
    """A text in quotation marks: single ones, or double ones round a text that holds a single one only; None for null."""
    plain = text
    for sign, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(sign), F.lit(shown))
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    shown = F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.coalesce(shown, F.lit("None"))


def check_date(told: Column, quote: Column) -> Column:
    """struct(date, reason): the ISO date told if its quote writes that day, else null and why not."""
    value = F.when(told.rlike(r"\A(?!0000)\d{4}-\d{2}-\d{2}\z"), F.try_to_date(told, "yyyy-MM-dd"))
    printed, shown = dates_in(quote), in_quotes(quote)
    why = (
        F.when(told.isNull(), F.concat(shown, F.lit(" gives no day, so it isn't turned into a date")))
        .when(value.isNull(), F.concat(in_quotes(told), F.lit(" isn't a YYYY-MM-DD date")))
        .when(F.size(printed) == 0, F.concat(F.lit("no date this program can read in "), shown, F.lit(" to check "), told, F.lit(" against")))
        .when(~F.array_contains(printed, value), F.concat(told, F.lit(" isn't a date in "), shown))
        .otherwise("")
    )
    return F.struct(F.when(why == "", value).alias("date"), why.alias("reason"))
