"""Columns that an operator does not read, kept out of its way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Aside:
    """Renames the columns of a table that an operator does not read, so that no name can clash inside it.

    ``needed`` are the columns that it reads, ``added`` those that it returns besides; a column of ``df`` with
    an added name gives way to the added one. Names are compared as Spark does, without regard to case.
    """

    def __init__(self, df: DataFrame, needed: tuple[str, ...], added: tuple[str, ...] = ()):
        low = {n.lower() for n in needed}
        self.columns = [c for c in df.columns if c.lower() in low or c.lower() not in {a.lower() for a in added}]
        self.names = {c: c.lower() if c.lower() in low else f"_aside{k}" for k, c in enumerate(self.columns)}
        self.df = df.select(*[F.col(f"`{c}`").alias(self.names[c]) for c in self.columns])

    def back(self, out: DataFrame, added: dict[str, Column | str] | None = None) -> DataFrame:
        """The columns of the table under their own names, then ``added`` (name to expression or column).

        Expressions are computed first, in a select that gives private names only: next to an alias of the user's
        choice, a name inside a lambda would mean that alias instead of the column it was written for.
        """
        added = added or {}
        computed = [(F.col(e) if isinstance(e, str) else e).alias(f"_added{k}") for k, e in enumerate(added.values())]
        inner = out.select(*self.names.values(), *computed)
        return inner.select(*[F.col(self.names[c]).alias(c) for c in self.columns], *[F.col(f"_added{k}").alias(n) for k, n in enumerate(added)])
