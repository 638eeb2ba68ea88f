"""Distances, valid points, grid cells and the center of a project."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_MILES = 3958.8
#: Less than the true 69.09 miles of one degree of latitude, so a margin in degrees is never too small.
MILES_PER_DEGREE = 69.0


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / F.lit(2.0)), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2.0 * EARTH_RADIUS_MILES) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def haversine_miles_by_atan2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The same distance by atan2, unclamped: coordinates may be texts; one that is no number gives null."""
    lat1, lon1, lat2, lon2 = (F.radians(c.try_cast("double")) for c in (lat1, lon1, lat2, lon2))
    half = lambda x: F.pow(F.sin(x / F.lit(2.0)), F.lit(2.0))
    a = half(lat2 - lat1) + F.cos(lat1) * F.cos(lat2) * half(lon2 - lon1)
    return F.lit(EARTH_RADIUS_MILES) * F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def finite(value: Column) -> Column:
    """A text or number as a finite double, else null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def valid_point(lat: Column, lon: Column) -> Column:
    """True only for coordinates inside the bounds; never null."""
    return F.coalesce(lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), F.lit(False))


def point_key(lat: Column, lon: Column) -> Column:
    """A text that equal points share; -0.0 is 0.0."""
    return F.concat_ws(" ", (lat + F.lit(0.0)).cast("string"), (lon + F.lit(0.0)).cast("string"))


def cell(value: Column, size: Column | float) -> Column:
    return F.floor(value / size).cast("long")


def cells_round(size: float) -> int:
    """Grid cells around the globe, as wide as size in degrees at least."""
    return max(1, int(360 / size))


def cell_of(lat: Column, lon: Column, size: float) -> Column:
    """Struct (y, x) of the grid cell of a point; 180 and -180 degrees are one meridian."""
    round_ = cells_round(size)
    return F.struct(cell(lat, size).alias("y"), F.pmod(F.floor((lon + 180.0) * round_ / 360.0), F.lit(round_)).cast("long").alias("x"))


def cells_around(lat: Column, lon: Column, miles: float, size: float) -> Column:
    """Structs (y, x) of all grid cells that a circle may touch: over the meridian of 180 degrees, and all around where it holds a pole."""
    round_, north = cells_round(size), min(180.0, miles / MILES_PER_DEGREE)
    wide = F.sin(F.lit(math.radians(min(north, 90.0)))) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    whole = (F.abs(lat) + north >= 89.999) | (wide >= 1.0)
    east = F.when(whole, 180.0).otherwise(F.degrees(F.asin(F.least(wide, F.lit(1.0)))) + 1e-9)
    at = lambda x: F.floor((x + 180.0) * round_ / 360.0)
    columns = F.when(whole | (at(lon + east) - at(lon - east) >= round_), F.sequence(F.lit(0).cast("long"), F.lit(round_ - 1).cast("long"))).otherwise(F.sequence(at(lon - east), at(lon + east)))
    rows = F.sequence(cell(lat - north, size), cell(lat + north, size))
    return F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: F.struct(y.alias("y"), F.pmod(x, F.lit(round_)).cast("long").alias("x")))))


def midpoint(first: Column, second: Column) -> Column:
    """The arithmetic mean of the usable values; null if both are null."""
    return F.when(first.isNotNull() & second.isNotNull(), (first + second) / 2.0).otherwise(F.coalesce(first, second))
