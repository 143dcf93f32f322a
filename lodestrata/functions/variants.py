"""JSON texts by type: what a value is, not what it looks like."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(json_text: Column) -> Column:
    """A text as VARIANT; null where it is not JSON."""
    return F.try_parse_json(json_text)


def at(value: Column, path: str, kind: str = "variant") -> Column:
    """The value at a path (``$.a.b``), cast to ``kind``; null where there is none or the cast fails."""
    return F.try_variant_get(value, path, kind)


def kind_of(value: Column, path: str = "$") -> Column:
    """BOOLEAN, BIGINT, DECIMAL, DOUBLE, STRING, OBJECT, ARRAY or VOID; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(at(value, path)), r"^[A-Z]+", 0)


def is_text(value: Column, path: str, pattern: str) -> Column:
    """Whether the value is a string (no number that looks like one) that matches."""
    return (kind_of(value, path) == "STRING") & at(value, path, "string").rlike(pattern)


def same_json(left: Column, right: Column) -> Column:
    """Whether two VARIANT values are the same JSON; two missing values are the same."""
    return F.to_json(left).eqNullSafe(F.to_json(right))


def keys_are(json_text: Column, names: list[str]) -> Column:
    """Whether an object has these keys and no others."""
    keys = F.json_object_keys(json_text)
    return F.coalesce((F.size(keys) == len(names)) & (F.size(F.array_except(F.array(*map(F.lit, names)), keys)) == 0), F.lit(False))
