"""Dates of mixed precision: a year stays a year, nothing is widened or guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions.scalars import stripped


# The written forms of dates, and the reasons why a date is unknown.
YEAR, COMPACT, SLASHED = r"^[1-9][0-9]{3}\z", r"^[0-9]{8}\z", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z"
MISSING, MALFORMED = "missing", "malformed_or_uninterpreted"


def parse_date(raw: Column) -> Column:
    """Struct (raw, precision, value, state, reason, year) of a year, yyyymmdd or m/d/yyyy; anything else is UNKNOWN.

    ``value`` is text; ``year`` is the integer of a date known to the year only.
    """
    text = stripped(F.coalesce(raw.cast("string"), F.lit("")))
    year = text.rlike(YEAR)
    compact = F.when(text.rlike(COMPACT), F.try_to_date(text, "yyyyMMdd"))
    slashed = F.when(text.rlike(SLASHED), F.try_to_date(text, "M/d/yyyy"))
    day = F.coalesce(compact, slashed)
    day = F.when(F.year(day) >= 1, day)  # there is no year 0
    known = year | day.isNotNull()
    reason = F.when(text == "", MISSING).when(~known, MALFORMED)
    return F.struct(
        raw.cast("string").alias("raw"),
        F.when(year, "year").when(day.isNotNull(), "day").alias("precision"),
        F.when(year, text).otherwise(F.date_format(day, "yyyy-MM-dd")).alias("value"),
        F.when(known, "DERIVED").otherwise("UNKNOWN").alias("state"),
        reason.alias("reason"),
        F.when(year, text.cast("int")).alias("year"),
    )


def from_epoch_millis(ms: Column) -> Column:
    """UTC timestamp of epoch milliseconds."""
    return F.timestamp_millis(ms.cast("long"))


def unpadded(day: Column) -> Column:
    """m/d/yyyy without leading zeros."""
    return F.date_format(day, "M/d/yyyy")
