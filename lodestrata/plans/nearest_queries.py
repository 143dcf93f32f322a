"""Queries of nearest sites, gated matches, compared representations and tiled rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.stages import Stages
from lodestrata.operators import nearest, tiles
from lodestrata.plans.spatial_queries import GRID_SQL, _grid
from lodestrata.plans.tables import Registry, Tables
from lodestrata.products import representations

R = Registry()
TILE = 16

_PLACES = """
p AS (SELECT c_custkey AS id, (c_custkey * 7919 % 10007)::DOUBLE / 10 AS x, (c_custkey * 104729 % 9973)::DOUBLE / 10 AS y, c_nationkey % 3 AS nation FROM customer),
s AS (SELECT s_suppkey AS id, (s_suppkey * 6007 % 10007)::DOUBLE / 10 AS x, (s_suppkey * 3001 % 9973)::DOUBLE / 10 AS y, s_nationkey % 3 AS nation FROM supplier)
"""


def _places(t: Tables) -> tuple[DataFrame, DataFrame]:
    at = lambda k, a, b: (F.col(k) * a % b).cast("double") / 10
    p = t.customer.select(F.col("c_custkey").alias("id"), at("c_custkey", 7919, 10007).alias("x"), at("c_custkey", 104729, 9973).alias("y"), (F.col("c_nationkey") % 3).alias("nation"))
    s = t.supplier.select(F.col("s_suppkey").alias("id"), at("s_suppkey", 6007, 10007).alias("x"), at("s_suppkey", 3001, 9973).alias("y"), (F.col("s_nationkey") % 3).alias("nation"))
    return p, s


@R.add(f"""
WITH {_PLACES}, d AS (SELECT p.id, s.id AS site, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) AS far FROM p, s)
SELECT id, arg_min(site, (far, site)) AS site_id, round(min(far), 6) AS distance FROM d GROUP BY id
""")
def nearest_sites(t: Tables) -> DataFrame:
    """The supplier that is nearest to each customer."""
    p, s = _places(t)
    found = nearest.nearest_sites(p.select("id", "x", "y"), s, 8.0, Stages(t.spark, "nearest"))
    return found.select("id", "site_id", F.round("distance", 6).alias("distance"))


@R.add(f"""
WITH {_PLACES}, g AS (SELECT unnest([1.0, 2.0, 5.0, 10.0]::DOUBLE[]) AS gate),
m AS (SELECT p.id, s.id AS site, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) AS far FROM p JOIN s ON s.x BETWEEN p.x - 11 AND p.x + 11 AND s.y BETWEEN p.y - 11 AND p.y + 11),
n AS (SELECT p.id, gate, count(m.site) AS n, min(m.site) AS site FROM p CROSS JOIN g LEFT JOIN m ON m.id = p.id AND m.far <= gate GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN n = 1 THEN count(*) FILTER (n = 1) OVER (PARTITION BY gate, CASE WHEN n = 1 THEN site END) END AS claims FROM n)
SELECT id, gate, n, CASE WHEN n = 1 THEN site END AS match_id, CASE WHEN n = 0 THEN 'none' WHEN n > 1 THEN 'multiple' WHEN claims > 1 THEN 'conflict' ELSE 'single' END AS match_class FROM c
""")
def gate_matches(t: Tables) -> DataFrame:
    """Customers against suppliers within four distances: none, single, conflict or multiple."""
    p, s = _places(t)
    return nearest.gated_matches(p.select("id", "x", "y"), s, [1.0, 2.0, 5.0, 10.0])


@R.add(f"""
WITH {_PLACES}, m AS (SELECT p.id AS l, s.id AS r, p.nation AS ln, s.nation AS rn FROM p JOIN s ON s.x BETWEEN p.x - 9 AND p.x + 9 AND s.y BETWEEN p.y - 9 AND p.y + 9 AND sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2) <= 9),
one AS (SELECT l FROM m GROUP BY l HAVING count(*) = 1), w AS (SELECT m.* FROM m JOIN one USING (l))
SELECT l AS left_id, r AS right_id FROM w WHERE ln = rn AND r IN (SELECT r FROM w GROUP BY r HAVING count(*) = 1)
""")
def scoped_matches(t: Tables) -> DataFrame:
    """Single matches within nine that share their group of nations, seen from both sides."""
    p, s = _places(t)
    single = nearest.gated_matches(p.select("id", "x", "y"), s, [9.0]).filter("match_class = 'single' or match_class = 'conflict'")
    return nearest.reverse_scope(single.select(F.col("id").alias("left_id"), F.col("match_id").alias("right_id")), p, s, "nation")


@R.add("""
WITH k AS (SELECT p_partkey AS id, p_name, p_brand, p_size FROM part)
SELECT id, CASE WHEN id % 13 = 5 THEN 'missing_left' WHEN id % 11 = 4 THEN 'missing_right' WHEN id % 17 = 2 THEN 'repeated'
    WHEN id % 7 = 1 AND id % 5 = 3 THEN 'both_differ' WHEN id % 7 = 1 THEN 'attributes_differ' WHEN id % 5 = 3 THEN 'shape_differs' ELSE 'equal' END AS state,
  CASE WHEN id % 13 = 5 OR id % 11 = 4 OR id % 17 = 2 THEN NULL WHEN id % 7 = 1 THEN 'p_brand' ELSE '' END AS attributes,
  CASE WHEN id % 13 = 5 OR id % 11 = 4 OR id % 17 = 2 THEN NULL WHEN id % 5 = 3 THEN 2 ELSE 0 END::BIGINT AS n_left_only,
  CASE WHEN id % 13 = 5 OR id % 11 = 4 OR id % 17 = 2 THEN NULL WHEN id % 5 = 3 THEN 2 ELSE 0 END::BIGINT AS n_right_only
FROM k WHERE NOT (id % 13 = 5 AND id % 11 = 4)
""")
def representation_comparison(t: Tables) -> DataFrame:
    """A service's features and a package's: rings begin elsewhere and turn the other way, some moved, changed, missing or doubled."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("double")
    ring = lambda *ps: F.array(F.array(*[F.array(x + 0.0, y + 0.0) for x, y in ps]))
    x, zero = k.cast("double"), F.lit(0.0)
    top = F.when(k % 5 == 3, size + 1).otherwise(size)
    rows = t.part.select(k.alias("id"), "p_name", "p_brand", "p_size", "p_partkey")
    left = rows.filter(k % 13 != 5).select("id", "p_name", "p_brand", ring((x, zero), (x, size), (x + size, size), (x + size, zero), (x, zero)).alias("rings"))
    brand = F.when(k % 7 == 1, F.concat("p_brand", F.lit("!"))).otherwise(F.col("p_brand"))
    right = rows.filter(k % 11 != 4).select("id", "p_name", brand.alias("p_brand"), ring((x + size, zero), (x + size, size), (x, top), (x, zero), (x + size, zero)).alias("rings"))
    found = representations.compared(left, right.unionByName(right.filter("id % 17 = 2")), ["id"], ["p_name", "p_brand"], "rings")
    return found.select("id", "state", F.array_join("attributes", ",").alias("attributes"), "n_left_only", "n_right_only")


@R.add(f"""
WITH g AS ({GRID_SQL}), n AS (SELECT a.row, a.col, b.row - a.row AS dr, b.col - a.col AS dc, b.value FROM g b JOIN g a ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 WHERE b.valid),
s AS (SELECT row, col, count(*) AS n, sum(value * dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END) / 8 AS x, sum(value * dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END) / 8 AS y FROM n GROUP BY ALL)
SELECT row, col, round(degrees(atan(sqrt(x * x + y * y))), 6) AS slope FROM s WHERE n = 9
""")
def tiled_slope(t: Tables) -> DataFrame:
    """Slopes of a raster held in tiles, across the borders of tiles."""
    held = tiles.from_cells(_grid(t), [], TILE)
    slopes = tiles.to_cells(tiles.tile_slopes(held, [], TILE), [], TILE, "slope", "slope")
    return slopes.select("row", "col", F.round("slope", 6).alias("slope"))


@R.add(f"""
WITH g AS (SELECT row, col FROM ({GRID_SQL}) WHERE valid),
s AS (
  SELECT (SELECT count(*) FROM g n WHERE n.row = g.row AND n.col = g.col + 1) + (SELECT count(*) FROM g n WHERE n.row = g.row AND n.col = g.col - 1)
    + (SELECT count(*) FROM g n WHERE n.col = g.col AND n.row = g.row + 1) + (SELECT count(*) FROM g n WHERE n.col = g.col AND n.row = g.row - 1) AS near
  FROM g
)
SELECT count(*)::DOUBLE AS area, sum(4 - near)::DOUBLE AS length FROM s
""")
def valid_footprints(t: Tables) -> DataFrame:
    """Area and boundary length of the footprint of a raster's valid cells."""
    rings = tiles.valid_footprint(tiles.from_cells(_grid(t), [], TILE).withColumn("raster", F.lit(1)), ["raster"], TILE, Stages(t.spark, "footprint"))
    return rings.agg(F.round(F.sum("area"), 6).alias("area"), F.round(F.sum("length"), 6).alias("length"))
