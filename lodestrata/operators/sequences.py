"""Sets, ranks, neighbours in order, interval unions and exact statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.stages import Stages

TASK_ROWS = 1 << 20  # rows that one task is dealt
PLACES = 16  # places in which equal rows are counted before they meet


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Multiset symmetric difference with the ``side`` each row is from; empty means equal multisets."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def union_of_keys(*keys: DataFrame) -> DataFrame:
    """Distinct union of single-column key tables."""
    out = keys[0]
    for k in keys[1:]:
        out = out.union(k)
    return out.distinct()


def adjacent_pairs(df: DataFrame, group: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each row with the next row's ``columns`` as next_*; the last of a group has nulls."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])


def adjacency_class(end: Column, next_start: Column) -> Column:
    """gap, touch, overlap or last, from an end and the following start."""
    return F.when(next_start.isNull(), "last").when(next_start > end, "gap").when(next_start < end, "overlap").otherwise("touch")


def segment_multiset(pairs: DataFrame, a: str, b: str, directed: bool = False) -> DataFrame:
    """(a, b, n): how often each segment occurs; undirected segments are put in order."""
    p = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    x, y = (F.col(a), F.col(b)) if directed else (F.least(a, b), F.greatest(a, b))
    return p.groupBy(x.alias("a"), y.alias("b")).agg(F.count("*").alias("n"))


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 1..n within each group in the given order, with no task that holds a group.

    Rows are dealt by ranges of group and order and written with the number of their range; a range numbers its own rows,
    and starts after what the ranges before it hold of the same group. ``order`` should tell rows apart.
    """
    keys = [F.col(g).asc() for g in group] + order
    stages = Stages(df.sparkSession, "numbered")
    dealt = stages.keep(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "dealt")
    held = dealt.groupBy("_range", *group).agg(F.count("*").alias("_held"))
    before = F.sum("_held").over(Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = held.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order))
    same = [F.col("_range") == F.col("_r"), *[F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)]]
    met = dealt.withColumn("_own", own).join(starts, same)
    return met.select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))


def ranked(df: DataFrame, measure: str, tie: str, name: str, group: list[str] | None = None) -> DataFrame:
    """Rank 1..n by descending measure, ties by id; without groups one rank over everything, found range by range."""
    return numbered(df, group or [], [F.col(measure).desc(), F.col(tie).asc()], name).withColumn(name, F.col(name).cast("int"))


def top_n(df: DataFrame, n: int, measure: Column, tie: str) -> DataFrame:
    """The n largest by ``measure``, ties by id (a bounded heap a task, then one merge)."""
    return df.orderBy(measure.desc(), F.col(tie).asc()).limit(n)


def top_curve(df: DataFrame, measure: str, tie: str, sizes: list[int]) -> DataFrame:
    """(top_n, total): the summed measure of the n largest, for each n, and of all (0)."""
    best = top_n(df, max(sizes), F.col(measure), tie)
    w = Window.orderBy(F.col(measure).desc(), F.col(tie).asc())
    ranks = best.select(measure, F.row_number().over(w).alias("_rank"))
    sums = ranks.agg(*[F.sum(F.when(F.col("_rank") <= n, F.col(measure))).alias(f"s{n}") for n in sizes])
    rows = F.array(*[F.struct(F.lit(n).alias("top_n"), F.col(f"s{n}").alias("total")) for n in sizes])
    whole = df.agg(F.sum(measure).alias("total")).select(F.lit(0).alias("top_n"), "total")
    return sums.select(F.explode(rows).alias("r")).select("r.top_n", "r.total").unionByName(whole)


def _percentiles(values: DataFrame, group: list[str], shares: dict[str, float]) -> DataFrame:
    """Interpolated percentiles of ``_v`` by group: only the two values next to each are looked at once rows are numbered."""
    rows = numbered(values, group, [F.col("_v").asc()], "_no")
    sizes = values.groupBy(*[F.col(g).alias(f"_s{k}") for k, g in enumerate(group)]).agg(F.count("*").alias("_n"))
    met = rows.join(sizes, [F.col(g).eqNullSafe(F.col(f"_s{k}")) for k, g in enumerate(group)]) if group else rows.crossJoin(F.broadcast(sizes))  # one row
    out = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_n") - 1) + 1
        low, part = F.floor(at), at - F.floor(at)
        weight = F.when(F.col("_no") == low, 1 - part).when(F.col("_no") == low + 1, part)
        out.append(F.sum(F.when(weight > 0, F.col("_v") * weight)).alias(name))
    near = None
    for share in shares.values():
        at = F.floor(F.lit(share) * (F.col("_n") - 1) + 1)
        hit = (F.col("_no") == at) | (F.col("_no") == at + 1)
        near = hit if near is None else near | hit
    return met.filter(near).groupBy(*group).agg(*out)


def describe_exact(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """Mean, median, RMS, p05, p95, absolute p95 and largest absolute value of finite values; percentiles interpolate.

    Percentiles are exact and read off a numbering by ranges, so no group is one task's. A group without a finite value has
    0 and nulls.
    """
    v = F.when(F.col(x).isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.col(x).cast("double"))
    sums = df.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("max_abs"))
    values = df.select(*group, v.alias("_v")).filter("_v is not null")
    own = _percentiles(values, group, {"median": 0.5, "p05": 0.05, "p95": 0.95})
    size = _percentiles(values.withColumn("_v", F.abs("_v")), group, {"abs_p95": 0.95})
    for k, more in enumerate((own, size)):
        renamed = more.withColumnsRenamed({g: f"_p{k}_{g}" for g in group})
        sums = sums.join(renamed, [F.col(g).eqNullSafe(F.col(f"_p{k}_{g}")) for g in group], "left") if group else sums.crossJoin(F.broadcast(renamed))  # one row
    return sums.select(*group, "n", "mean", "median", "rms", "p05", "p95", "abs_p95", "max_abs")


def tasks(df: DataFrame) -> int:
    """Tasks for the rows of ``df``, each about ``TASK_ROWS``: the setting of partitions does not follow the rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))


def dealt(df: DataFrame, group: list[str], n: int | None = None) -> DataFrame:
    """Rows dealt by group to ``n`` tasks, else to ``tasks(df)``."""
    return df.repartition(n or tasks(df), *group)


def interval_islands(df: DataFrame, group: list[str], low: str, high: str) -> DataFrame:
    """Disjoint unions (group, low, high) of closed intervals; those that touch are one."""
    w = Window.partitionBy(*group).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col(low) > reach), 1).otherwise(0)
    marked = dealt(df, group).filter(F.col(low) <= F.col(high)).withColumn("_new", begins)
    # Intervals that repeat are of one island, whichever of them was seen first.
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*group, "_island").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("_island")


def union_length(df: DataFrame, group: list[str], low: str, high: str, name: str) -> DataFrame:
    """Length that the intervals of a group cover; overlaps count once."""
    return union_lengths(dealt(df, group), group, low, high, {name: None})


def union_lengths(df: DataFrame, group: list[str], low: str, high: str, names: dict[str, Column | None]) -> DataFrame:
    """For each name the length that the intervals that fit its rule cover (None: all), from one sort of dealt intervals.

    Where an island begins, the one before it is closed and adds its end less its start, so no table of islands is held. A
    length without intervals is null.
    """
    w = Window.partitionBy(*group).orderBy(low, high).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.filter(F.col(low) <= F.col(high))
    for n, rule in names.items():
        own = F.lit(True) if rule is None else F.coalesce(rule, F.lit(False))
        rows = rows.withColumns({f"_own_{n}": own, f"_reach_{n}": F.max(F.when(own, F.col(high))).over(w)})
        begins = F.col(f"_own_{n}") & (F.col(f"_reach_{n}").isNull() | (F.col(low) > F.col(f"_reach_{n}")))
        rows = rows.withColumn(f"_start_{n}", F.when(begins, F.col(low))).withColumn(f"_last_{n}", F.max(f"_start_{n}").over(w))
    closed = lambda n: F.sum(F.when(F.col(f"_start_{n}").isNotNull(), F.col(f"_reach_{n}") - F.col(f"_last_{n}")))
    open_ = lambda n: F.max(F.when(F.col(f"_own_{n}"), F.col(high))) - F.max(f"_start_{n}")
    return rows.groupBy(*group).agg(*[(F.coalesce(closed(n), F.lit(0)) + open_(n)).alias(n) for n in names])


def mixture_state(parts: DataFrame, group: list[str], percent: str, tolerance: int = 0) -> DataFrame:
    """Exact percent sums per unit: total, missing, largest, ties for largest, state.

    ``percent`` is decimal. A unit with a missing percent is unknown; else the sum says under, sums or over.
    """
    # Equal percents are counted before they meet, in some places each, so a unit with very many parts is a few rows. Rows are
    # dealt out first: tables of counts hold what a task is dealt, not what it reads.
    p, n = F.col(percent), tasks(parts)
    spread = dealt(parts.select(*group, percent, F.pmod(F.monotonically_increasing_id(), PLACES).alias("_place")), [*group, percent, "_place"], n)
    placed = spread.groupBy(*group, percent, "_place").agg(F.count("*").alias("_n"))
    counts = dealt(placed.drop("_place"), group, n).groupBy(*group, percent).agg(F.sum("_n").alias("_n"))
    sums = counts.groupBy(*group).agg(
        F.sum("_n").alias("n_parts"), F.sum(p * F.col("_n")).alias("total"), F.coalesce(F.sum(F.when(p.isNull(), F.col("_n"))), F.lit(0)).alias("n_missing"),
        F.max(p).alias("largest"), F.coalesce(F.max_by("_n", percent), F.lit(0)).cast("int").alias("_most"),
    )
    state = F.when(F.col("n_missing") > 0, "unknown").when(F.col("total") < 100 - tolerance, "under_100").when(F.col("total") > 100 + tolerance, "over_100").otherwise("sums_to_100")
    ties = F.when(F.col("largest").isNull(), 0).otherwise(F.col("_most"))
    return sums.select(*group, "n_parts", "total", "n_missing", "largest", ties.alias("n_largest"), state.alias("state"))
