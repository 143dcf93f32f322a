"""Grouped variants, guarded lookups, proposals with holds and lateral picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped_variants(rows: DataFrame, key: str, core: list[str], variant: list[str]) -> DataFrame:
    """One row per record: whether its core is the same in all rows, how many variants it has, and which variant fields differ.

    Equal rows of a record meet first; whether values differ is told by the smallest and the largest, so no row is repeated
    for a count of distinct values and no set of variants is held.
    """
    cores, shown = F.struct(*core), lambda v: F.coalesce(F.col(v).cast("string"), F.lit("~"))
    once = rows.groupBy(key, *variant).agg(F.count("*").alias("_n"), F.min(cores).alias("_first"), F.max(cores).alias("_last"))
    ends = [f(shown(v)).alias(f"_{k}_{v}") for v in variant for k, f in (("low", F.min), ("high", F.max))]
    sums = once.groupBy(key).agg(F.sum("_n").alias("n_rows"), F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.count("*").cast("int").alias("n_variants"), *ends)
    differing = F.array_compact(F.array(*[F.when(F.col(f"_low_{v}") != F.col(f"_high_{v}"), F.lit(v)) for v in variant]))
    return sums.select(key, "n_rows", F.col("_first").eqNullSafe(F.col("_last")).alias("core_consistent"), "n_variants", differing.alias("differing_fields"))


def exactly_one_lookup(rows: DataFrame, key: str, lookup: DataFrame, lookup_key: str, value: str) -> DataFrame:
    """Rows with the looked-up value if exactly one entry matches, else null with the number of matches."""
    counts = lookup.groupBy(F.col(lookup_key).alias("_k")).agg(F.count("*").alias("_n"), F.min(value).alias("_v"))
    joined = rows.join(counts, F.col(key) == F.col("_k"), "left")
    n = F.coalesce("_n", F.lit(0))
    return joined.select(*rows.columns, n.alias("n_matches"), F.when(n == 1, F.col("_v")).alias(value))


def proposals(links: DataFrame, subject: str, candidate: str, holds: dict[str, Column]) -> DataFrame:
    """One proposal per subject: its candidate if there is exactly one and nothing holds it, with the holds named.

    A candidate that several subjects propose holds all of them.
    """
    found = links.filter(F.col(candidate).isNotNull())
    shared = found.groupBy(candidate).agg(F.count_distinct(subject).alias("_s")).filter("_s > 1").select(candidate, F.lit(True).alias("_shared"))
    marked = links.join(shared, candidate, "left")
    own = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in holds.items()]))
    sums = marked.withColumn("_h", own).groupBy(subject).agg(F.count(candidate).alias("_n"), F.min(candidate).alias("_c"), F.bool_or(F.coalesce("_shared", F.lit(False))).alias("_sh"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_h")))).alias("_holds"))
    counted = F.array_compact(F.array(F.when(F.col("_n") == 0, "no_candidate"), F.when(F.col("_n") > 1, "multiple_candidates"), F.when(F.col("_sh"), "shared_candidate")))
    every = F.concat(counted, "_holds")
    return sums.select(subject, F.when(F.size(every) == 0, F.col("_c")).alias("proposed"), every.alias("holds"))


def first_per_row(left: DataFrame, right: DataFrame, on: Column, order: list[str], keep: list[str], key: list[str]) -> DataFrame:
    """Lateral pick: for each row of ``left`` the first of its matches in ``right`` by ``order`` (an aggregate, no window)."""
    met = left.join(right, on)
    return met.groupBy(*key).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_m")).select(*key, *[F.col(f"_m.{c}").alias(c) for c in keep])


def privilege_matrix(roles: DataFrame, tables: DataFrame, grants: DataFrame) -> DataFrame:
    """Every role and table (both small, named sets) with what is granted; nothing granted is a row, too."""
    every = roles.select("role").distinct().crossJoin(F.broadcast(tables.select("name").distinct()))
    held = grants.groupBy("role", "name").agg(F.array_sort(F.collect_set("privilege")).alias("privileges"))
    return every.join(held, ["role", "name"], "left").select("role", "name", F.coalesce("privileges", F.expr("cast(array() as array<string>)")).alias("privileges"))


def date_agreement(rows: DataFrame, dates: list[str]) -> DataFrame:
    """Add ``agreement``: same, differs or unknown of parsed dates (structs); unlike precision is never equal."""
    values = [F.col(f"{d}.value") for d in dates]
    known = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
    equal = reduce(lambda a, b: a & b, [values[0].eqNullSafe(v) for v in values[1:]])
    return rows.withColumn("agreement", F.when(~known, "unknown").when(equal, "same").otherwise("differs"))
