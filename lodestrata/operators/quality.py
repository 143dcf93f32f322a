"""Profiles and flags: nothing is repaired or dropped, rows only gain evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.scalars import is_blank


def key_profile(df: DataFrame, key: str, source: str) -> DataFrame:
    """One row: rows, present, missing, distinct and excess (present beyond one each) of a key."""
    text = F.col(key).cast("string")
    present = ~is_blank(text)
    counts = df.groupBy(F.when(present, text).alias("_k")).agg(F.count("*").alias("_n"))
    out = counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_k").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_present"),
        F.count("_k").alias("n_distinct"),
    )
    return out.select(F.lit(source).alias("source"), "n_rows", "n_present", (F.col("n_rows") - F.col("n_present")).alias("n_missing"), "n_distinct", (F.col("n_present") - F.col("n_distinct")).alias("n_excess"))


def join_patterns(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Keys and rows per pattern: unmatched sides, one_to_one, one_to_many, many_to_one, many_to_many.

    Both sides are counted by key before they meet, so a hot key is one row in the join.
    """
    a = left.filter(F.col(left_key).isNotNull()).groupBy(F.col(left_key).alias("_k")).agg(F.count("*").alias("_l"))
    b = right.filter(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("_k")).agg(F.count("*").alias("_r"))
    one, many = F.col("_l") == 1, F.col("_r") == 1
    pattern = (
        F.when(F.col("_r").isNull(), "unmatched_left").when(F.col("_l").isNull(), "unmatched_right")
        .when(one & many, "one_to_one").when(one, "one_to_many").when(many, "many_to_one").otherwise("many_to_many")
    )
    both = a.join(b, "_k", "full_outer").withColumn("pattern", pattern)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return both.groupBy("pattern").agg(F.count("*").alias("n_keys"), zero("_l").alias("left_rows"), zero("_r").alias("right_rows"))


def candidate_links(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` with candidate_count and match_state (zero, one, multiple). Blank keys never match."""
    usable = right.filter(~is_blank(F.col(right_key).cast("string"))).groupBy(F.col(right_key).alias("_k")).agg(F.count("*").alias("_n"))
    joined = left.join(usable, F.col(left_key) == F.col("_k"), "left")
    n = F.coalesce("_n", F.lit(0))
    return joined.select(*left.columns, n.alias("candidate_count"), F.when(n == 0, "zero").when(n == 1, "one").otherwise("multiple").alias("match_state"))


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``repeated``: whether another row has the same keys. Counted, then joined: no group is gathered."""
    counts = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_n")).filter("_n > 1")
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return df.join(counts, match, "left").select(*df.columns, F.col("_n").isNotNull().alias("repeated"))


def null_profile(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(kind, field, n_rows, n_null, n_blank) by one pass over the columns."""
    counted = df.agg(
        F.count("*").alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{k}") for k, c in enumerate(columns)],
        *[F.count_if(F.col(c).isNotNull() & is_blank(F.col(c).cast("string"))).alias(f"_blank_{k}") for k, c in enumerate(columns)],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_null_{k}").alias("n_null"), F.col(f"_blank_{k}").alias("n_blank")) for k, c in enumerate(columns)])
    return counted.select("_n", F.explode(rows).alias("r")).select(F.lit(kind).alias("kind"), "r.field", F.col("_n").alias("n_rows"), "r.n_null", "r.n_blank")


def state_profile(df: DataFrame, parsed: Column) -> DataFrame:
    """Rows per (state, precision, reason) of a parsed value."""
    return df.select(parsed.alias("p")).groupBy(F.col("p.state").alias("state"), F.coalesce("p.precision", F.lit("none")).alias("precision"), F.coalesce("p.reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


def presence_matrix(base: DataFrame, group: str, sources: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """Per group of ``base``: keys that each source holds, and how many hold all, any or none of them."""
    marked = base.select(key, group)
    for name, (df, own) in sources.items():
        held = df.select(F.col(own).alias(f"_{name}")).distinct()
        marked = marked.join(held, F.col(key) == F.col(f"_{name}"), "left").withColumn(name, F.col(f"_{name}").isNotNull()).drop(f"_{name}")
    flags = [F.col(n) for n in sources]
    every, some = reduce(lambda a, b: a & b, flags), reduce(lambda a, b: a | b, flags)
    return marked.groupBy(group).agg(*[F.count_if(f).alias(f"in_{n}") for n, f in zip(sources, flags, strict=True)], F.count_if(every).alias("in_all"), F.count_if(some).alias("in_any"), F.count_if(~some).alias("in_none"))


def flagged(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``quality_flags``: the names of the rules that hold, in the order given."""
    return df.withColumn("quality_flags", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))


def flag_histogram(df: DataFrame, flags: str = "quality_flags") -> DataFrame:
    """Rows per flag."""
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def violations(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) for each row and each rule that does not hold; an unknown outcome is a violation."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return df.select(*key, F.explode(broken).alias("rule"))


def key_counts_over(df: DataFrame, keys: list[str], name: str = "key_rows") -> DataFrame:
    """Window form of the repetition count, for keys that are known to be even."""
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys)))


def candidate_buckets(links: DataFrame, group: str, parent: str, candidate: str) -> DataFrame:
    """Per group: parents with zero, one and several candidates, and candidates that several parents share."""
    per_parent = links.groupBy(group, parent).agg(F.count(candidate).alias("_n"))
    shared = links.filter(F.col(candidate).isNotNull()).groupBy(group, candidate).agg(F.count_distinct(parent).alias("_p")).groupBy(group).agg(F.count_if(F.col("_p") > 1).alias("shared_candidates"))
    buckets = per_parent.groupBy(group).agg(F.count_if(F.col("_n") == 0).alias("zero"), F.count_if(F.col("_n") == 1).alias("one"), F.count_if(F.col("_n") > 1).alias("multiple"))
    return buckets.join(shared, group, "left").select(group, "zero", "one", "multiple", F.coalesce("shared_candidates", F.lit(0)).alias("shared_candidates"))
