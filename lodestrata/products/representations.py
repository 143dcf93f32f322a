"""Two representations of the same features compared: attributes by value, shapes by the multiset of their segments.

A shape is not compared as an array, for rings may begin elsewhere, turn the other way or come in another order. Its
undirected segments are counted on both sides, feature by feature and segment by segment; a shape is the same if no
count differs. The work is dealt by segment, so one feature with very many vertices is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_rows(features: DataFrame, key: list[str], rings: str) -> DataFrame:
    """(*key, x0, y0, x1, y1): a row for each undirected segment of the rings, the lesser end first; null rings have none."""
    ring = features.select(*key, F.explode(rings).alias("_ring")).filter(F.size("_ring") > 1)
    ends = ring.select(*key, F.explode(F.arrays_zip(F.expr("slice(_ring, 1, size(_ring) - 1)").alias("a"), F.expr("slice(_ring, 2, size(_ring) - 1)").alias("b"))).alias("s"))
    point = lambda side: F.struct((F.get(F.col(f"s.{side}"), F.lit(0)) + 0.0).alias("x"), (F.get(F.col(f"s.{side}"), F.lit(1)) + 0.0).alias("y"))
    pair = ends.select(*key, F.least(point("a"), point("b")).alias("p"), F.greatest(point("a"), point("b")).alias("q"))
    return pair.select(*key, F.col("p.x").alias("x0"), F.col("p.y").alias("y0"), F.col("q.x").alias("x1"), F.col("q.y").alias("y1"))


def shape_differences(left: DataFrame, right: DataFrame, key: list[str], rings: str) -> DataFrame:
    """(*key, n_left_only, n_right_only): segments that one side has more often; features without a difference have no row."""
    sides = segment_rows(left, key, rings).withColumn("_d", F.lit(1)).unionByName(segment_rows(right, key, rings).withColumn("_d", F.lit(-1)))
    net = sides.groupBy(*key, "x0", "y0", "x1", "y1").agg(F.sum("_d").alias("_net")).filter("_net <> 0")
    return net.groupBy(*key).agg(F.sum(F.greatest("_net", F.lit(0))).alias("n_left_only"), F.sum(F.greatest(-F.col("_net"), F.lit(0))).alias("n_right_only"))


def compared(left: DataFrame, right: DataFrame, key: list[str], attributes: list[str], rings: str) -> DataFrame:
    """One row a key of either side: state, the attributes that differ, and how many segments each side has alone.

    state: missing_left, missing_right, repeated (a key that one side has more than once, which is not compared), equal,
    attributes_differ, shape_differs or both_differ. Null attributes equal one another; null rings are a shape without segments.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        counted = df.groupBy(*[F.col(k).alias(f"_{name}_{k}") for k in key]).agg(F.count("*").alias(f"_n_{name}"), F.first(F.struct(*attributes)).alias(f"_{name}"))
        return counted

    same = lambda a, b: [F.col(f"_{a}_{k}").eqNullSafe(F.col(f"_{b}_{k}")) for k in key]
    both = side(left, "l").join(side(right, "r"), same("l", "r"), "full_outer")
    named = both.select(*[F.coalesce(f"_l_{k}", f"_r_{k}").alias(k) for k in key], "_n_l", "_n_r", "_l", "_r")
    shapes = shape_differences(left, right, key, rings).withColumnsRenamed({k: f"_s_{k}" for k in key})
    met = named.join(shapes, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in key], "left")
    differ = F.array_compact(F.array(*[F.when(~F.col("_l")[a].eqNullSafe(F.col("_r")[a]), F.lit(a)) for a in attributes]))
    paired = (F.col("_n_l") == 1) & (F.col("_n_r") == 1)
    shape = F.col(f"_s_{key[0]}").isNotNull() | F.col("n_left_only").isNotNull()
    state = (
        F.when(F.col("_n_l").isNull(), "missing_left").when(F.col("_n_r").isNull(), "missing_right").when(~paired, "repeated")
        .when((F.size(differ) > 0) & shape, "both_differ").when(F.size(differ) > 0, "attributes_differ").when(shape, "shape_differs").otherwise("equal")
    )
    zero = lambda c: F.when(paired, F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return met.select(*key, state.alias("state"), F.when(paired, differ).alias("attributes"), zero("n_left_only"), zero("n_right_only"))
