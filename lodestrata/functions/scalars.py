"""Small column functions: blanks, normal forms, codes, bytes, clamps and JSON access."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: All white space of Unicode, as a character class.
WHITE = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"


def stripped(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, rf"^{WHITE}+|{WHITE}+\z", "")


def is_blank(x: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(x, F.lit("")).rlike(rf"^{WHITE}*\z")


def differs(a: Column, b: Column) -> Column:
    """Null-safe inequality."""
    return ~a.eqNullSafe(b)


def same_name(a: Column, b: Column) -> Column:
    """Equality of names without regard to case and outer blanks; nulls never match."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def squeezed(x: Column) -> Column:
    """Runs of white space become one blank, outer ones go."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def swap_prefix(code: Column, old: str, new: str) -> Column:
    """``old`` prefix to ``new``; other codes become null."""
    return F.when(code.startswith(old), F.concat(F.lit(new), F.substring(code, len(old) + 1, 1 << 30)))


def head_part(code: Column, sep: str = "_") -> Column:
    return F.substring_index(code, sep, 1)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def decrease(before: Column, after: Column, slack: float = 0.01) -> Column:
    """before - after, floored at 0; a growth beyond ``slack`` is an error."""
    gone = before - after
    return F.when(gone < -slack, F.raise_error(F.lit("a remainder grew"))).otherwise(F.greatest(F.lit(0.0), gone))


def little_endian_int(data: Column, start: int, size: int = 4) -> Column:
    """Unsigned integer of ``size`` bytes from the 1-based byte ``start``."""
    hexed = F.hex(F.substring(data, start, size))
    turned = F.concat(*[F.substring(hexed, 2 * k - 1, 2) for k in range(size, 0, -1)])
    return F.conv(turned, 16, 10).cast("long")


def field(json_text: Column, *path: str) -> Column:
    """A text field by path; names may hold dots."""
    return F.get_json_object(json_text, "$" + "".join(f"['{p}']" for p in path))


def has_all_keys(json_text: Column, *names: str) -> Column:
    """Whether an object has every key (an object with exactly these keys also has as many)."""
    keys = F.json_object_keys(json_text)
    return reduce(lambda a, b: a & b, [F.array_contains(keys, n) for n in names])


def json_kind(json_text: Column) -> Column:
    """object, array, string, number, boolean or null, by the first character; null if it does not parse."""
    text = F.trim(json_text)
    first = F.substring(text, 1, 1)
    parses = F.try_parse_json(text).isNotNull()
    kind = F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "n", "null").otherwise("number")
    return F.when(parses, kind)


def without_keys(m: Column, *names: str) -> Column:
    """A map without some keys, to compare payloads apart from bookkeeping."""
    return F.map_filter(m, lambda k, v: ~k.isin(*names))


def merged(base: Column, changes: Column) -> Column:
    """Map union in which ``changes`` wins."""
    kept = F.map_filter(base, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(changes), k), F.lit(False)))
    return F.when(changes.isNull(), base).otherwise(F.map_concat(kept, changes))


def sorted_map(m: Column) -> Column:
    """Entries of a map by key: maps compare by this."""
    return F.array_sort(F.map_entries(m))


def exactly_one(*conditions: Column) -> Column:
    """Whether one and only one of the conditions holds."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("int") for c in conditions]) == 1


def range_sanity(low: Column, typical: Column, high: Column) -> Column:
    """complete, incomplete (some part is missing) or inverted (low > typical or typical > high)."""
    missing = low.isNull() | typical.isNull() | high.isNull()
    inverted = F.coalesce(low > typical, F.lit(False)) | F.coalesce(typical > high, F.lit(False)) | F.coalesce(low > high, F.lit(False))
    return F.when(inverted, "inverted").when(missing, "incomplete").otherwise("complete")
