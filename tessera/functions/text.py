"""Text, number and date parsing with fixed rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import finite

# Words and patterns that results depend on.
DASHES = "\u2012\u2013\u2014\u2212"
GENERIC_NAME_WORDS = ["sub", "substation", "transmission", "station", "switching", "distribution", "tap", "line"]
SEARCH_DROP_WORDS = ["primary"]
VOLTAGE_GROUP = r"(?i)(\d{1,3}(?:\.\d+)?(?:\s*[/-]\s*\d{1,3}(?:\.\d+)?)*)\s*kV\b"
MILES = r"(?i)(\d+(?:\.\d+)?)\s*-?\s*(?:miles?|mi)\b"


def blank(value: Column) -> Column:
    """A trimmed text; null becomes empty."""
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def filled(value: Column) -> Column:
    return blank(value) != ""


def first_filled(*values: Column) -> Column:
    """The first value that is not blank, trimmed; empty if all are."""
    return F.coalesce(*(F.nullif(blank(v), F.lit("")) for v in values), F.lit(""))


def number(value: Column) -> Column:
    """A finite number, thousands separators allowed; else null."""
    return finite(F.trim(F.replace(value.cast("string"), F.lit(","), F.lit(""))))


def iso_date(value: Column) -> Column:
    """A date of the form 2025-01-31; anything else is null."""
    text = blank(value)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def us_date(value: Column) -> Column:
    """Month/day/year with four or two digits of year (69 to 99: of 1900, else of 2000); else null."""
    text = blank(value)
    year = F.regexp_extract(text, r"/(\d{2})$", 1).try_cast("int")
    full = F.concat(F.regexp_extract(text, r"^(.*/)\d{2}$", 1), (year + F.when(year >= 69, 1900).otherwise(2000)).cast("string"))
    return F.coalesce(F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "M/d/yyyy")), F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), F.try_to_date(full, "M/d/yyyy")))


def any_date(value: Column) -> Column:
    return F.coalesce(iso_date(value), us_date(value))


def volts(value: Column) -> Column:
    """Volts from 230000, 230 or 230 kV; else null."""
    text = F.replace(F.lower(F.coalesce(value.cast("string"), F.lit(""))), F.lit(" "), F.lit(""))
    found = number(F.replace(text, F.lit("kv"), F.lit("")))
    return F.when(text.contains("kv") | (found < 1000), found * 1000.0).otherwise(found)


def project_kind(value: Column) -> Column:
    """LINE, SUBSTATION, BOTH or empty."""
    text = F.replace(F.upper(blank(value)), F.lit(" "), F.lit("_"))
    return F.when(text.isin("LINE", "MULTI_LINE", "TRANSMISSION_LINE"), "LINE").when(text.isin("SUBSTATION", "STATION"), "SUBSTATION").when(text.isin("BOTH", "MULTI_SITE"), "BOTH").otherwise("")


def tidy(value: Column) -> Column:
    """Typographic dashes to hyphens, white space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(value, F.lit("")), DASHES, "-" * len(DASHES)), r"(?U)\s+", " "))


def canon(value: Column) -> Column:
    return F.lower(tidy(value))


def squash(value: Column) -> Column:
    return F.replace(canon(value), F.lit(" "), F.lit(""))


def same_text(a: Column, b: Column) -> Column:
    return (canon(a) == canon(b)) | (squash(a) == squash(b))


def _whole_words(wanted: Column, spaces: str) -> Column:
    """A pattern of a text as whole words; spaces may stand between its characters."""
    letter = r"[\p{L}\p{N}]"
    before = F.when(wanted.rlike(rf"^{letter}"), rf"(?<!{letter})").otherwise("")
    after = F.when(wanted.rlike(rf"{letter}$"), rf"(?!{letter})").otherwise("")
    each = F.filter(F.split(wanted, ""), lambda c: c != "")
    return F.concat(before, F.array_join(F.transform(each, lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))), spaces), after)


def holds_words(text: Column, quote: Column) -> Column:
    """Does a text hold a quote as whole words ("Lee" is not in "Leesville")? Case, dashes and white space don't count."""
    wanted = squash(quote)
    return F.when(wanted == "", False).when(F.contains(squash(text), wanted), F.regexp_like(canon(text), _whole_words(wanted, " ?"))).otherwise(False)


def own_spelling(text: Column, quote: Column) -> Column:
    """The text's own spelling of a quote that it holds as whole words, with the quote's spacing if it has that; else null."""
    found = lambda pattern: F.nullif(F.regexp_substr(tidy(text), F.concat(F.lit("(?iu)"), pattern)), F.lit(""))
    return F.when(holds_words(text, quote), F.coalesce(found(_whole_words(canon(quote), "")), found(_whole_words(squash(quote), " ?"))))


def named(rows, *names: str) -> Column:
    """The first of the columns of these names, case and outer spaces ignored, that is filled; empty without one."""
    have = {c.strip().lower(): c for c in rows.columns}
    return first_filled(*[F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have], F.lit(""))


def tidy_id(value: Column) -> Column:
    """Dashes of any kind become hyphens and spaces around them go; spaces after commas stay."""
    return F.regexp_replace(tidy(value), r"\s*-\s*", "-")


def voltages_in(value: Column) -> Column:
    """All voltages that a text names, in volts, distinct, highest first."""
    groups = F.regexp_extract_all(value, F.lit(VOLTAGE_GROUP), F.lit(1))
    each = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[/-]\s*")))
    return F.sort_array(F.array_distinct(F.transform(each, lambda x: F.round(x.try_cast("double") * 1000.0).cast("int"))), asc=False)


def miles_in(value: Column) -> Column:
    """Every mileage of a text, in order."""
    return F.transform(F.regexp_extract_all(value, F.lit(MILES), F.lit(1)), lambda x: x.try_cast("double"))


def single(values: Column) -> Column:
    """The only element of an array, else null."""
    return F.when(F.size(values) == 1, F.get(values, F.lit(0)))


def text_between(text: Column, first: str, last: str, required: bool = False) -> Column:
    """What stands between two labels, over lines, trimmed; without the labels null, or an error if they are required."""
    found = F.regexp_extract(text, rf"(?is){first}\s+(.*?)\s+{last}", 1)
    lost = F.raise_error(F.lit(f"no text between {first!r} and {last!r}")).cast("string") if required else F.lit(None).cast("string")
    return F.when(text.rlike(rf"(?is){first}\s+(.*?)\s+{last}"), F.trim(found)).otherwise(lost)


def place_name(value: Column) -> Column:
    """A name for comparison: lower case, ft and st written out, no punctuation, no generic words."""
    text = F.replace(F.lower(F.coalesce(value, F.lit(""))), F.lit("&"), F.lit(" and "))
    text = F.regexp_replace(F.regexp_replace(text, r"\bft\b", "fort"), r"\bst\b", "saint")
    words = F.split(F.trim(F.regexp_replace(text, "[^a-z0-9]+", " ")), " +")
    return F.array_join(F.filter(words, lambda w: ~w.isin(GENERIC_NAME_WORDS) & (w != "")), " ")


def search_name(value: Column) -> Column:
    """A name for a gazetteer: some words dropped, unless nothing would remain."""
    kept = F.array_join(F.filter(F.split(F.trim(value), r"\s+"), lambda w: ~F.lower(w).isin(SEARCH_DROP_WORDS)), " ")
    return F.when(kept == "", value).otherwise(kept)


def name_points(target: Column, candidate: Column) -> Column:
    """6 for equal place names, 5 if one contains the other, 4 or 2 for shared words, else 0; both already `place_name`s."""
    a, b = F.array_distinct(F.split(target, " ")), F.array_distinct(F.split(candidate, " "))
    alike = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return (
        F.when((target == "") | (candidate == ""), 0)
        .when(target == candidate, 6)
        .when(F.contains(candidate, target) | F.contains(target, candidate), 5)
        .when(alike >= 0.67, 4)
        .when(alike >= 0.40, 2)
        .otherwise(0)
    )
