"""Queries of unions, faces and ring contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.stages import Stages
from lodestrata.geometry import dissolve, frames
from lodestrata.plans.tables import Registry, Tables

R = Registry()
CELL = 64.0

# Parts as boxes (x, y, wide, high), with a hole one unit inside where there is room. A shear keeps areas, so the
# slanted polygons (x + 2 y, y) have the areas of the boxes, and a vertical unit edge is sqrt(5) long.
_BOXES = """
SELECT p_partkey AS id, p_partkey % 25 AS subject, p_partkey * 37 % 1000 AS x, p_partkey * 91 % 1000 AS y,
  p_size AS wide, p_size % 7 + 1 AS high, p_size >= 3 AND p_size % 7 >= 2 AS holed
FROM part
"""


def _boxes(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        k.alias("id"), (k % 25).alias("subject"), (k * 37 % 1000).alias("x"), (k * 91 % 1000).alias("y"),
        size.alias("wide"), (size % 7 + 1).alias("high"), ((size >= 3) & (size % 7 >= 2)).alias("holed"),
    )


def _ring(*points: tuple[Column, Column]) -> Column:
    """A closed ring."""
    return F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in (*points, points[0])])


def _sheared(inset: int) -> Column:
    x0, y0 = F.col("x") + inset, F.col("y") + inset
    x1, y1 = F.col("x") + F.col("wide") - inset, F.col("y") + F.col("high") - inset
    return _ring(*[(x + 2 * y, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


@R.add(f"""
WITH b AS ({_BOXES}), cells AS (
  SELECT DISTINCT subject, x + i % wide AS cx, y + i // wide AS cy
  FROM (SELECT *, unnest(range(0, wide * high)) AS i FROM b)
  WHERE NOT (holed AND i % wide BETWEEN 1 AND wide - 2 AND i // wide BETWEEN 1 AND high - 2)
), sides AS (
  SELECT c.subject, count(*) AS area,
    sum(CASE WHEN e.cx IS NULL THEN 1 ELSE 0 END + CASE WHEN w.cx IS NULL THEN 1 ELSE 0 END) AS upright,
    sum(CASE WHEN n.cx IS NULL THEN 1 ELSE 0 END + CASE WHEN s.cx IS NULL THEN 1 ELSE 0 END) AS level
  FROM cells c
    LEFT JOIN cells e ON e.subject = c.subject AND e.cx = c.cx + 1 AND e.cy = c.cy
    LEFT JOIN cells w ON w.subject = c.subject AND w.cx = c.cx - 1 AND w.cy = c.cy
    LEFT JOIN cells n ON n.subject = c.subject AND n.cx = c.cx AND n.cy = c.cy + 1
    LEFT JOIN cells s ON s.subject = c.subject AND s.cx = c.cx AND s.cy = c.cy - 1
  GROUP BY c.subject
)
SELECT subject, round(area::DOUBLE, 4) AS area, round(level + upright * sqrt(5.0::DOUBLE), 4) AS length FROM sides
""")
def dissolved_unions(t: Tables) -> DataFrame:
    """Area and length of the boundary of the union of slanted, holed polygons of each subject."""
    shapes = _boxes(t).select("subject", F.array(F.when(F.col("holed"), F.array(_sheared(0), _sheared(1))).otherwise(F.array(_sheared(0)))).alias("region"))
    rings = dissolve.dissolved(shapes, ["subject"], "region", CELL, Stages(t.spark, "dissolved"))
    return rings.groupBy("subject").agg(F.round(F.sum("area"), 4).alias("area"), F.round(F.sum("length"), 4).alias("length"))


@R.add(f"""
WITH b AS ({_BOXES}), f AS (
  SELECT id, CASE WHEN id % 3 = 0 THEN [(1, 'shell', wide * high / 4.0), (-1, 'reversed', wide * high / 4.0)]
    WHEN wide < 3 OR high < 3 THEN [(1, 'shell', wide * high)]
    WHEN id % 3 = 1 THEN [(1, 'shell', wide * high), (1, 'hole', -(wide - 2) * (high - 2)), (2, 'overlap', (wide - 2) * (high - 2))]
    ELSE [(1, 'shell', wide * high), (1, 'hole', -(wide - 2) * (high - 2))] END AS faces
  FROM b
)
SELECT id, x[1]::BIGINT AS label, x[2] AS role, round(x[3]::DOUBLE, 6) AS area FROM (SELECT id, unnest(faces) AS x FROM f)
""")
def face_reviews(t: Tables) -> DataFrame:
    """A row for each boundary of a face of crossing and nested rings: winding number, role and area."""
    b = _boxes(t)
    x0, y0, x1, y1 = F.col("x"), F.col("y"), F.col("x") + F.col("wide"), F.col("y") + F.col("high")
    eight = _ring((x0, y0), (x1, y1), (x1, y0), (x0, y1))
    outer = _ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    inner = _ring((x0 + 1, y0 + 1), (x1 - 1, y0 + 1), (x1 - 1, y1 - 1), (x0 + 1, y1 - 1))
    room = (F.col("wide") >= 3) & (F.col("high") >= 3)
    rings = F.when(F.col("id") % 3 == 0, F.array(eight)).when(~room, F.array(outer)).when(F.col("id") % 3 == 1, F.array(outer, inner)).otherwise(F.array(outer, F.reverse(inner)))
    named = b.select("id", F.transform(rings, lambda r: F.array(r)).alias("region")).withColumn("shape", frames.shape_id())
    # Subjects of equal rings share their faces.
    found = dissolve.faces(frames.shapes(named), ["shape"], "region", CELL, Stages(t.spark, "faces"))
    found = dissolve.roles(found, 0.0).select("shape", "label", "role", F.round("area", 6).alias("area"))
    return named.select("id", "shape").join(found, "shape").select("id", "label", "role", "area")


# A ring that comes back to its lower left corner: once out along a square, and again along a smaller one (inside it or
# beside it, turning the same way or the other); or twice more; or along two smaller ones at two corners.
_CONTACTS = """
SELECT id, CASE id % 5
    WHEN 0 THEN [[0, 0], [0, a], [a, a], [a, 0], [0, 0]]
    WHEN 1 THEN [[0, 0], [0, a], [a, a], [a, 0], [0, 0], [b, 1], [b, b], [0, 0]]
    WHEN 2 THEN [[0, 0], [a, 0], [a, a], [0, 0], [-b, 0], [-b, -b], [0, 0]]
    WHEN 3 THEN [[0, 0], [0, a], [a, a], [a - b, a - 1], [a - 1, a - b], [a, a], [a, 0], [0, 0], [b, 1], [b, b], [0, 0]]
    ELSE [[0, 0], [a, 0], [a, a], [0, 0], [-b, 0], [-b, -b], [0, 0], [0, b], [-b, b], [0, 0]] END AS ring
FROM (SELECT p_partkey AS id, p_size + 20 AS a, p_size % 7 + 2 AS b FROM part)
"""


@R.add(f"""
WITH r AS ({_CONTACTS}), v AS (
  SELECT id, p, count(*) AS n, min(i) AS i, max(i) AS j FROM (SELECT id, unnest(ring[: len(ring) - 1]) AS p, unnest(range(1, len(ring))) AS i FROM r) GROUP BY id, p
), c AS (
  SELECT id, count(*) FILTER (n > 1) AS contacts, max(n) AS most, max(i) FILTER (n > 1) AS i, max(j) FILTER (n > 1) AS j FROM v GROUP BY id
), e AS (
  SELECT r.id, t.i AS spot, c.i AS lo, c.j AS hi, (ring[t.i][1] * ring[t.i + 1][2] - ring[t.i + 1][1] * ring[t.i][2]) / 2.0 AS part
  FROM r JOIN c USING (id), range(1, 20) t(i) WHERE t.i < len(ring)
), s AS (SELECT id, sum(part) AS whole, sum(part) FILTER (spot >= lo AND spot < hi) AS loop FROM e GROUP BY id)
SELECT id, CASE WHEN most > 2 THEN 'vertex visited more than twice' END AS hold,
  CASE WHEN most <= 2 THEN contacts + 1 END::INT AS n_loops, CASE WHEN most <= 2 THEN round(whole::DOUBLE, 6) END AS area,
  CASE WHEN most > 2 THEN NULL WHEN contacts = 0 THEN 'simple' WHEN contacts = 2 THEN 'two_contacts'
    WHEN loop > 0 AND whole - loop > 0 THEN 'touching_holes' WHEN (loop > 0) <> (whole - loop > 0) THEN 'single_touch' END AS pattern
FROM c JOIN s USING (id)
""")
def ring_contacts(t: Tables) -> DataFrame:
    """Rings cut at the vertices that they visit twice: pattern, loops and signed area, or the reason to hold them."""
    a, b, k, zero = F.col("p_size") + 20, F.col("p_size") % 7 + 2, F.col("p_partkey"), F.lit(0)
    path = lambda *ps: F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in ps])
    o, one = (zero, zero), F.lit(1)
    square, inside, beside = (zero, a), (a, a), (a, zero)
    small = ((b, one), (b, b))
    rings = (
        F.when(k % 5 == 0, path(o, square, inside, beside, o))
        .when(k % 5 == 1, path(o, square, inside, beside, o, *small, o))
        .when(k % 5 == 2, path(o, beside, inside, o, (-b, zero), (-b, -b), o))
        .when(k % 5 == 3, path(o, square, inside, (a - b, a - 1), (a - 1, a - b), inside, beside, o, *small, o))
        .otherwise(path(o, beside, inside, o, (-b, zero), (-b, -b), o, (zero, b), (-b, b), o))
    )
    named = t.part.select(k.alias("id"), rings.alias("region")).withColumn("shape", frames.shape_id())
    # Rings that are equal are cut once.
    found = frames.shapes(named).select("shape", frames.ring_contacts("region").alias("c"))
    found = found.select("shape", "c.hold", F.size("c.loops").alias("n"), F.round("c.area", 6).alias("area"), "c.pattern")
    return named.select("id", "shape").join(found, "shape").select("id", "hold", F.when(F.col("n") > 0, F.col("n")).alias("n_loops"), "area", "pattern")
