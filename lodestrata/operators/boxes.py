"""Axis-parallel boxes: grid-bucketed joins, overlap areas, scope relations and coverage states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("xmin", "ymin", "xmax", "ymax")
CHUNK = 256  # members of a class that travel in one row


def cells(xmin: Column, ymin: Column, xmax: Column, ymax: Column, size: float) -> Column:
    """The grid cells that a box touches."""
    lo = lambda v: F.floor(v / size).cast("long")
    xs, ys = F.sequence(lo(xmin), lo(xmax)), F.sequence(lo(ymin), lo(ymax))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def box_pairs(a: DataFrame, b: DataFrame, a_id: str, b_id: str, size: float, pad: float = 0.0) -> DataFrame:
    """Pairs of boxes that meet (within ``pad``), each once.

    Both sides are dealt to grid cells and joined by cell, so no side is broadcast or crossed; a pair is
    kept only in the cell of its intersection's lower left corner, which needs no distinct.
    """
    own = lambda df, i, s, p: df.select(
        F.col(i).alias(f"{s}_id"), *[(F.col(c) + (-p if k < 2 else p)).alias(f"{s}_{c}") for k, c in enumerate(BOX)]
    )
    left, right = own(a, a_id, "a", pad), own(b, b_id, "b", 0.0)
    spread = lambda df, s: df.withColumn("_cell", F.explode(cells(*[F.col(f"{s}_{c}") for c in BOX], size)))
    met = spread(left, "a").join(spread(right, "b"), "_cell")
    meets = (F.col("a_xmin") <= F.col("b_xmax")) & (F.col("b_xmin") <= F.col("a_xmax")) & (F.col("a_ymin") <= F.col("b_ymax")) & (F.col("b_ymin") <= F.col("a_ymax"))
    corner = F.struct(F.floor(F.greatest("a_xmin", "b_xmin") / size).cast("long").alias("cx"), F.floor(F.greatest("a_ymin", "b_ymin") / size).cast("long").alias("cy"))
    return met.filter(meets & (F.col("_cell") == corner)).drop("_cell")


def expanded(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_id, b_id, ...) of all members of pairs of classes (a_class, b_class, ...).

    ``a`` and ``b`` have the members (id, class). The members of a class of ``b`` travel in chunks of a bounded number, and
    each chunk meets the pairs by itself, so a large class is dealt to many tasks.
    """
    held = b.groupBy(F.col("class").alias("_of")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_chunks"))
    places = b.join(held, F.col("class") == F.col("_of")).select("_of", "id", F.pmod(F.xxhash64("id"), F.col("_chunks")).cast("int").alias("_chunk"))
    lists = places.groupBy("_of", "_chunk").agg(F.collect_list("id").alias("_ids"))
    counted = pairs.join(held, F.col("b_class") == F.col("_of")).drop("_of")
    rows = counted.join(a.select(F.col("id").alias("a_id"), F.col("class").alias("_own")), F.col("a_class") == F.col("_own")).drop("_own")
    rows = rows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    met = rows.join(lists.hint("shuffle_hash"), (F.col("b_class") == F.col("_of")) & (F.col("_part") == F.col("_chunk")))
    rest = [c for c in pairs.columns if c not in ("a_class", "b_class")]
    return met.select("a_id", F.explode("_ids").alias("b_id"), *rest)


def pairs_of_members(a: DataFrame, b: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """``box_pairs`` of (id, box): equal boxes are a class, and only classes meet before their members are named."""
    own = lambda df: df.select("id", F.struct(*BOX).alias("class"))
    distinct = lambda df: own(df).select("class").distinct().select("class", "class.*")
    met = box_pairs(distinct(a), distinct(b), "class", "class", size, pad).withColumnsRenamed({"a_id": "a_class", "b_id": "b_class"})
    return expanded(met, own(a), own(b))


def overlap_area() -> Column:
    """Area that the two boxes of a pair share; boxes that only touch share 0."""
    wide = F.least("a_xmax", "b_xmax") - F.greatest("a_xmin", "b_xmin")
    high = F.least("a_ymax", "b_ymax") - F.greatest("a_ymin", "b_ymin")
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def scope_relation(box: dict[str, Column], study: dict[str, float], held: Column) -> Column:
    """interior, touch, outside or held of a box against a study box."""
    apart = (box["xmin"] > study["xmax"]) | (box["xmax"] < study["xmin"]) | (box["ymin"] > study["ymax"]) | (box["ymax"] < study["ymin"])
    shares = (box["xmin"] < study["xmax"]) & (box["xmax"] > study["xmin"]) & (box["ymin"] < study["ymax"]) & (box["ymax"] > study["ymin"])
    return F.when(held, "held").when(apart, "outside").when(shares, "interior").otherwise("touch")


def coverage_state(aois: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """State of each area (key, low, high) under sources (key, low, high): full, partial or unknown.

    One source that covers the area makes it full at once; only the rest is settled by the union. A gap of
    any size is partial: the fraction is reported, never used to decide. No source at all is unknown, not 0.
    """
    from lodestrata.operators.sequences import union_length

    clipped = sources.select(F.col(key).alias("_k"), F.col("low").alias("_lo"), F.col("high").alias("_hi"))
    met = aois.join(clipped, (F.col(key) == F.col("_k")) & (F.col("_lo") < F.col("high")) & (F.col("_hi") > F.col("low")), "left")
    parts = met.select(key, "low", "high", "_lo", F.greatest("_lo", "low").alias("_a"), F.least("_hi", "high").alias("_b"), ((F.col("_lo") <= F.col("low")) & (F.col("_hi") >= F.col("high"))).alias("_covers"))
    shortcut = parts.groupBy(key, "low", "high").agg(F.coalesce(F.bool_or("_covers"), F.lit(False)).alias("covered"), F.count("_lo").alias("n_sources"))
    length = union_length(parts.filter("_lo is not null and not _covers"), [key], "_a", "_b", "_len")
    both = shortcut.join(length, key, "left")
    gap = F.when(F.col("covered"), 0).otherwise((F.col("high") - F.col("low")) - F.coalesce("_len", F.lit(0)))
    state = F.when(F.col("n_sources") == 0, "unknown").when(F.col("covered") | (gap == 0), "full").otherwise("partial")
    fraction = F.when(F.col("n_sources") > 0, 1 - gap / (F.col("high") - F.col("low")))
    return both.select(key, "n_sources", state.alias("state"), fraction.alias("covered_fraction"))


def held_extent(df: DataFrame, group: list[str], x: str, y: str, valid: Column) -> DataFrame:
    """Extent of a group's vertices, null unless every vertex is valid (conservative, all or nothing)."""
    sums = df.groupBy(*group).agg(F.bool_and(F.coalesce(valid, F.lit(False))).alias("all_valid"), F.count("*").alias("n_vertices"), F.min(x).alias("_x0"), F.min(y).alias("_y0"), F.max(x).alias("_x1"), F.max(y).alias("_y1"))
    keep = lambda c, n: F.when(F.col("all_valid"), F.col(c).cast("double")).alias(n)
    return sums.select(*group, "n_vertices", "all_valid", keep("_x0", "xmin"), keep("_y0", "ymin"), keep("_x1", "xmax"), keep("_y1", "ymax"))


def tile_of(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float, n: int = 4) -> Column:
    """Tile number of a point in an n by n tiling of an extent; the upper edges belong to the last tiles."""
    place = lambda v, lo, hi: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - lo) * n / (hi - lo)))).cast("int")
    return place(y, y0, y1) * n + place(x, x0, x1)
