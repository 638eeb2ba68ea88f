"""Nested JSON cut down to the fields that are read later."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What scoring reads of a map feature.
FEATURE_FIELDS = ["type", "id", "lat", "lon", "center"]
FEATURE_TAGS = ["name", "operator", "voltage"]


def trim_json(text: Column, keep: list[str], nested: dict[str, list[str]]) -> Column:
    """JSON with only the fields keep, and of each nested object only its own; fields that are missing stay missing, an object that is missing becomes empty.

    Text that is no JSON object gives null. Fields are read from a parsed VARIANT, so the text is parsed once.
    """
    parsed = F.try_parse_json(text)
    read = lambda *path: F.try_variant_get(parsed, "$" + "".join(f"['{p}']" for p in path), "variant")
    inner = [F.struct(*[read(o, f).alias(f) for f in fields]).alias(o) for o, fields in nested.items()]
    kept = F.to_json(F.struct(*[read(f).alias(f) for f in keep], *inner))
    return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), kept)


def trim_feature(text: Column) -> Column:
    return trim_json(text, FEATURE_FIELDS, {"tags": FEATURE_TAGS})
