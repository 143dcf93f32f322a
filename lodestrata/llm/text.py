"""Text expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts whose other characters have no case take the faster ``lower``."""
    return F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
