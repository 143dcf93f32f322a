"""Nearest sites and gated matches by grid cells that grow until nothing outside can be nearer.

Places that share their coordinates are one, so a crowded place is one row of a join. A round looks at the nine cells around
a place: whatever lies within one cell size is in them, so a place whose best match is no further is settled. The
others go on with cells twice as large; dense regions are settled in small cells, sparse ones in large cells, and no side
is sent everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.stages import Stages


def _distinct_places(df: DataFrame, prefix: str) -> DataFrame:
    """(x, y, least id, how many) of the places of (id, x, y); places that are not finite are left out."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    rows = df.filter(finite("x") & finite("y")).select("id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))
    return rows.groupBy("x", "y").agg(F.min("id").alias(f"{prefix}id"), F.count("*").alias(f"{prefix}n")).withColumnsRenamed({"x": f"{prefix}x", "y": f"{prefix}y"})


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def _around(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """A row for each of the nine cells around a place."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = df.withColumn("_s", F.explode(steps))
    return near.withColumns({"_cx": _cell(F.col(x), size) + F.col("_s.a"), "_cy": _cell(F.col(y), size) + F.col("_s.b")}).drop("_s")


def nearest_sites(points: DataFrame, sites: DataFrame, size: float, stages: Stages, rounds: int = 40) -> DataFrame:
    """Add to ``points`` (id, x, y) the nearest of ``sites`` (id, x, y): site_id (least of ties), distance and n_ties.

    ``size``: the cells of the first round, about as wide as the densest sites lie apart. A point without finite
    coordinates, and every point if there is no site, has nulls; sites without finite coordinates do not count.
    """
    left = stages.keep(_distinct_places(points, "p_"), "points")
    right = stages.keep(_distinct_places(sites, "s_"), "sites")
    extent = left.select(F.col("p_x").alias("x"), F.col("p_y").alias("y")).union(right.select("s_x", "s_y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    wide = max(extent[0] or 0.0, extent[1] or 0.0)
    todo, done, turn = left.select("p_x", "p_y"), None, 0
    some = right.limit(1).count() > 0
    while some and turn < rounds:
        cells = _around(todo, "p_x", "p_y", size).join(right.withColumns({"_cx": _cell(F.col("s_x"), size), "_cy": _cell(F.col("s_y"), size)}), ["_cx", "_cy"])
        far = F.hypot(F.col("p_x") - F.col("s_x"), F.col("p_y") - F.col("s_y"))
        best = cells.select("p_x", "p_y", far.alias("distance"), "s_id", "s_n").groupBy("p_x", "p_y", "distance").agg(F.min("s_id").alias("site_id"), F.sum("s_n").alias("n_ties"))
        best = best.groupBy("p_x", "p_y").agg(F.min(F.struct("distance", "site_id", "n_ties")).alias("m")).select("p_x", "p_y", "m.*")
        last = size >= wide  # the nine cells hold everything
        settled = stages.keep(best if last else best.filter(F.col("distance") <= size), f"settled-{turn}")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        todo = stages.keep(todo.join(settled, ["p_x", "p_y"], "left_anti"), f"open-{turn}")
        if not todo.limit(1).count():
            break
        turn, size = turn + 1, size * 2
    if done is None:
        return points.select("*", F.lit(None).cast(points.schema["id"].dataType).alias("site_id"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("long").alias("n_ties"))
    return points.join(done, (F.col("x") + 0.0 == F.col("p_x")) & (F.col("y") + 0.0 == F.col("p_y")), "left").drop("p_x", "p_y")


def gated_matches(left: DataFrame, right: DataFrame, gates: list[float]) -> DataFrame:
    """(id, gate, n, match_id, match_class) of ``left`` (id, x, y) against ``right`` (id, x, y) for each distance gate.

    n: right ones within the gate; match_class: none, multiple, single, or conflict where the single one is also the single
    one of another left one. ``match_id`` is given for single and conflict. Only cells of the widest gate meet.
    """
    wide = float(max(gates))
    l = _distinct_places(left, "p_")
    r = _distinct_places(right, "s_").withColumns({"_cx": _cell(F.col("s_x"), wide), "_cy": _cell(F.col("s_y"), wide)})
    far = F.hypot(F.col("p_x") - F.col("s_x"), F.col("p_y") - F.col("s_y"))
    met = _around(l.select("p_x", "p_y"), "p_x", "p_y", wide).join(r, ["_cx", "_cy"]).withColumn("_far", far).filter(F.col("_far") <= wide)
    gate = F.explode(F.array(*[F.lit(float(g)) for g in gates]))
    # Counts by place first: the left ones of a place share their answer.
    counts = met.select("p_x", "p_y", "_far", "s_id", "s_n", gate.alias("gate")).filter("_far <= gate").groupBy("p_x", "p_y", "gate").agg(F.sum("s_n").alias("n"), F.min("s_id").alias("match_id"))
    every = left.select("id", (F.col("x") + 0.0).alias("_x"), (F.col("y") + 0.0).alias("_y"), gate.alias("gate"))
    c = counts.withColumnRenamed("gate", "_gate")
    rows = every.join(c, (F.col("_x") == F.col("p_x")) & (F.col("_y") == F.col("p_y")) & (F.col("gate") == F.col("_gate")), "left").select("id", "gate", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("match_id")).alias("match_id"))
    claims = rows.filter("match_id is not null").groupBy(F.col("gate").alias("_g"), F.col("match_id").alias("_m")).agg(F.count("*").alias("_claims"))
    judged = rows.join(claims, (F.col("gate") == F.col("_g")) & (F.col("match_id") == F.col("_m")), "left")
    kind = F.when(F.col("n") == 0, "none").when(F.col("n") > 1, "multiple").when(F.col("_claims") > 1, "conflict").otherwise("single")
    return judged.select("id", "gate", "n", "match_id", kind.alias("match_class"))


def reverse_scope(pairs: DataFrame, left: DataFrame, right: DataFrame, scope: str) -> DataFrame:
    """Matched ``pairs`` (left_id, right_id) whose two sides have the same scope, seen from both sides (id, scope).

    A pair is qualified only if each side's scope value is there and equal, and no other pair names either side.
    """
    l = left.select(F.col("id").alias("left_id"), F.col(scope).alias("_ls"))
    r = right.select(F.col("id").alias("right_id"), F.col(scope).alias("_rs"))
    both = pairs.join(l, "left_id").join(r, "right_id").filter(F.col("_ls") == F.col("_rs")).select("left_id", "right_id")
    once = lambda side: pairs.groupBy(side).agg(F.count("*").alias("_n")).filter("_n = 1").select(side)
    return both.join(once("left_id"), "left_id").join(once("right_id"), "right_id")
