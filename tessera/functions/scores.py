"""The five scores of a project pair, and what a shared corridor could save, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import number, project_kind, volts

# The owner whose blank start dates mean an open start, and the tables of the land estimate.
OPEN_START_OWNER = "Dominion Energy South Carolina"
LAND_VALUE_PER_ACRE = {"Georgia": 4950, "South Carolina": 4900}
OWNER_STATES = {"Dominion Energy South Carolina": "South Carolina", "Georgia Power": "Georgia"}
EASEMENT_FEET = {115000: 100, 230000: 100, 500000: 150}
SQUARE_FEET_PER_ACRE = 43560.0
FEET_PER_MILE = 5280.0


def lookup(table: dict, key: Column) -> Column:
    """The value of a small constant table, null for other keys."""
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def distance_score(miles: Column) -> Column:
    return F.when(miles <= 5, 3).when(miles <= 15, 2).when(miles <= 25, 1).otherwise(0)


def days_score(days: Column) -> Column:
    return F.when(days <= 30, 3).when(days <= 180, 2).when(days <= 365, 1).otherwise(0)


def timeline_state(owner_a: Column, start_a: Column, end_a: Column, owner_b: Column, start_b: Column, end_b: Column, bad_a: Column | bool = False, bad_b: Column | bool = False) -> Column:
    """overlap, apart, unavailable or inconsistent; bad_a and bad_b say that a start is written but no date."""
    bad_a, bad_b = (F.lit(x) if isinstance(x, bool) else x for x in (bad_a, bad_b))
    shut_a = start_a.isNull() & (owner_a != OPEN_START_OWNER)
    shut_b = start_b.isNull() & (owner_b != OPEN_START_OWNER)
    dawn = F.lit("0001-01-01").cast("date")
    a, b = F.coalesce(start_a, dawn), F.coalesce(start_b, dawn)
    return (
        F.when(end_a.isNull() | end_b.isNull(), "unavailable")
        .when(bad_a, "inconsistent")
        .when(shut_a, "unavailable")
        .when(bad_b, "inconsistent")
        .when(shut_b, "unavailable")
        .when((a > end_a) | (b > end_b), "inconsistent")
        .when(F.greatest(a, b) <= F.least(end_a, end_b), "overlap")
        .otherwise("apart")
    )


TIMELINE_REASONS = {"overlap": "build windows overlap", "apart": "build windows do not overlap", "unavailable": "timeline overlap unavailable", "inconsistent": "timeline dates inconsistent"}


def timeline_score(state: Column) -> Column:
    return F.when(state == "overlap", 3).otherwise(0)


def timeline_flag(state: Column) -> Column:
    return F.when(state == "overlap", "Yes").when(state == "apart", "No").otherwise("Unknown")


def voltage_score(a: Column, b: Column) -> Column:
    """From volts."""
    gap = F.abs(a - b)
    return F.when(a.isNull() | b.isNull(), 0).when(gap == 0, 3).when(gap / F.greatest(a, b) <= 0.10, 2).otherwise(1)


VOLTAGE_REASONS = {0: "voltage unavailable", 1: "different known voltages", 2: "similar voltage", 3: "same voltage"}


def kind_score(a: Column, b: Column) -> Column:
    """From `project_kind`s."""
    return F.when((a == "") | (b == ""), 0).when(a == b, 3).when((a == "BOTH") | (b == "BOTH"), 2).otherwise(0)


def kind_reason(a: Column, b: Column) -> Column:
    return (
        F.when((a == "") | (b == ""), "project type unavailable")
        .when(a == b, lookup({kind: f"matching {kind.lower()} type" for kind in ("LINE", "SUBSTATION", "BOTH")}, a))
        .when((a == "BOTH") | (b == "BOTH"), "one project supports both line and substation work")
        .otherwise("different project types")
    )


def project_state(owner: Column, region: Column) -> Column:
    region = F.trim(F.coalesce(region, F.lit("")))
    return F.when(region.isin(*LAND_VALUE_PER_ACRE), region).otherwise(F.coalesce(lookup(OWNER_STATES, F.trim(owner)), F.lit("")))


def easement_feet(voltage: Column) -> Column:
    return lookup(EASEMENT_FEET, volts(voltage).cast("int"))


def missing_for_estimate(side: str, state: Column) -> Column:
    """Why no land can be estimated for one side (a or b) of a pair: an array of reasons."""
    who, miles = F.col(f"project_id_{side}"), number(F.col(f"line_miles_{side}"))
    line_work = project_kind(F.col(f"project_type_{side}")).isin("LINE", "BOTH")
    first = (
        F.when(~line_work, F.concat(who, F.lit(" is not line work")))
        .when(miles.isNull() | (miles <= 0), F.concat(who, F.lit(" has no single line length in its plan")))
        .when(easement_feet(F.col(f"voltage_{side}")).isNull(), F.concat(who, F.lit("'s voltage has no typical easement width")))
    )
    no_state = F.when(lookup(LAND_VALUE_PER_ACRE, state).isNull(), F.concat(who, F.lit(" is in no state with a land value")))
    return F.array_compact(F.array(first, no_state))
