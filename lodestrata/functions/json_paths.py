"""JSON texts: resolving pointers and setting values by path."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pointer(json_text: Column, at: str) -> Column:
    """The value at a JSON pointer as text, null if there is none; a number in it is an index or a key.

    The empty pointer is the whole text, and "/" is the value of the empty key.
    """
    if at == "":
        return F.get_json_object(json_text, "$")
    if at == "/":
        return F.try_element_at(F.from_json(json_text, "map<string,string>"), F.lit(""))
    paths = ["$"]
    for part in at.strip("/").split("/"):
        name = part.replace("~1", "/").replace("~0", "~")
        ways = [f"['{name}']"] + ([f"[{name}]"] if name.isdecimal() else [])
        paths = [p + w for p in paths for w in ways]
    return F.coalesce(*[F.get_json_object(json_text, p) for p in paths])


def set_path(json_text: Column, path: list[str], value: Column) -> Column:
    """Canonical text of an object with the JSON text ``value`` at ``path``; only the last key may be new.

    In an array a number is an index, from the end if it is negative; one beyond either end adds the value there. A path that
    leads nowhere leaves the text as it is; what does not parse is null.
    """

    def step(at, name):
        if isinstance(at, list) and name.lstrip("-").isdecimal():
            k = int(name)
            return at[k] if -len(at) <= k < len(at) else None
        return at.get(name) if isinstance(at, dict) else None

    @F.pandas_udf(T.StringType())
    def run(texts, values):
        def one(text, new):
            if text is None or new is None:
                return None
            try:
                whole, fresh = json.loads(text), json.loads(new)
            except ValueError:
                return None
            at = whole
            for name in path[:-1]:
                at = step(at, name)
            last = path[-1]
            if isinstance(at, dict):
                at[last] = fresh
            elif isinstance(at, list) and last.lstrip("-").isdecimal():
                k = int(last)
                if -len(at) <= k < len(at):
                    at[k] = fresh
                else:
                    at.insert(len(at) if k >= 0 else 0, fresh)
            return json.dumps(whole, sort_keys=True, separators=(",", ":"))

        return texts.combine(values, one)

    return run(json_text, value)


def without_flag(flags: Column, flag: str) -> Column:
    """An array of flags without one of them."""
    return F.array_remove(flags, flag)
