"""Queries of boxes, intervals, tiles, distance gates and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import boxes, raster, sequences, vectors
from lodestrata.plans.tables import Registry, Tables

R = Registry()

PARTS_SQL = "SELECT p_partkey AS id, (p_partkey * 37 % 1000)::DOUBLE AS xmin, (p_partkey * 91 % 1000)::DOUBLE AS ymin, (p_partkey * 37 % 1000 + p_size)::DOUBLE AS xmax, (p_partkey * 91 % 1000 + p_size % 7 + 1)::DOUBLE AS ymax FROM part"
ZONES_SQL = "SELECT s_suppkey AS id, (s_suppkey * 53 % 900)::DOUBLE AS xmin, (s_suppkey * 29 % 900)::DOUBLE AS ymin, (s_suppkey * 53 % 900 + 60)::DOUBLE AS xmax, (s_suppkey * 29 % 900 + 40)::DOUBLE AS ymax FROM supplier"


def _parts(t: Tables) -> DataFrame:
    k, d = F.col("p_partkey"), lambda c: c.cast("double")
    return t.part.select(k.alias("id"), d(k * 37 % 1000).alias("xmin"), d(k * 91 % 1000).alias("ymin"), d(k * 37 % 1000 + F.col("p_size")).alias("xmax"), d(k * 91 % 1000 + F.col("p_size") % 7 + 1).alias("ymax"))


def _zones(t: Tables) -> DataFrame:
    k, d = F.col("s_suppkey"), lambda c: c.cast("double")
    return t.supplier.select(k.alias("id"), d(k * 53 % 900).alias("xmin"), d(k * 29 % 900).alias("ymin"), d(k * 53 % 900 + 60).alias("xmax"), d(k * 29 % 900 + 40).alias("ymax"))


@R.add(f"""
WITH a AS ({PARTS_SQL}), b AS ({ZONES_SQL})
SELECT a.id AS a_id, b.id AS b_id, (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS area FROM a JOIN b ON a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax
""")
def box_overlap(t: Tables) -> DataFrame:
    """Parts and zones that share an area, and the area."""
    pairs = boxes.pairs_of_members(_parts(t), _zones(t), 64.0)
    return pairs.select("a_id", "b_id", boxes.overlap_area().alias("area")).filter("area > 0")


@R.add(f"""
WITH a AS ({PARTS_SQL}), b AS ({ZONES_SQL})
SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.xmin - 2 <= b.xmax AND b.xmin <= a.xmax + 2 AND a.ymin - 2 <= b.ymax AND b.ymin <= a.ymax + 2
""")
def box_band_join(t: Tables) -> DataFrame:
    """Parts and zones within a band of two of one another."""
    return boxes.pairs_of_members(_parts(t), _zones(t), 64.0, 2.0).select("a_id", "b_id")


@R.add(f"""
WITH a AS ({PARTS_SQL})
SELECT CASE WHEN id % 17 = 0 THEN 'held' WHEN xmin > 600 OR xmax < 100 OR ymin > 700 OR ymax < 200 THEN 'outside' WHEN xmin < 600 AND xmax > 100 AND ymin < 700 AND ymax > 200 THEN 'interior' ELSE 'touch' END AS relation, count(*) AS n FROM a GROUP BY 1
""")
def box_touch(t: Tables) -> DataFrame:
    """Parts by their relation to a study box."""
    box = {c: F.col(c) for c in boxes.BOX}
    relation = boxes.scope_relation(box, {"xmin": 100, "ymin": 200, "xmax": 600, "ymax": 700}, F.col("id") % 17 == 0)
    return _parts(t).select(relation.alias("relation")).groupBy("relation").agg(F.count("*").alias("n"))


SPANS_SQL = "SELECT l_orderkey AS k, (l_partkey % 90)::BIGINT AS low, (l_partkey % 90 + l_quantity::BIGINT)::BIGINT AS high FROM lineitem"
ISLANDS_SQL = """
, o AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b RANGE UNBOUNDED PRECEDING) AS isl FROM o),
u AS (SELECT k, sum(hi - lo)::BIGINT AS len FROM (SELECT k, isl, min(a) AS lo, max(b) AS hi FROM g GROUP BY ALL) GROUP BY k)
"""


def _spans(t: Tables) -> DataFrame:
    low = F.col("l_partkey") % 90
    return t.lineitem.select(F.col("l_orderkey").alias("k"), low.alias("low"), (low + F.col("l_quantity").cast("long")).alias("high"))


@R.add(f"""
WITH s AS ({SPANS_SQL}), aoi AS (SELECT o_orderkey AS k, 20::BIGINT AS low, 70::BIGINT AS high FROM orders),
m AS (SELECT aoi.k, s.low <= 20 AND s.high >= 70 AS cov, greatest(s.low, 20) AS a, least(s.high, 70) AS b, s.k IS NOT NULL AS hit FROM aoi LEFT JOIN s ON s.k = aoi.k AND s.low < 70 AND s.high > 20),
f AS (SELECT k, coalesce(bool_or(cov), false) AS covered, count(*) FILTER (hit) AS n_sources FROM m GROUP BY 1), c AS (SELECT k, a, b FROM m WHERE hit AND NOT cov) {ISLANDS_SQL}
SELECT f.k, n_sources, CASE WHEN n_sources = 0 THEN 'unknown' WHEN covered OR 50 - coalesce(len, 0) = 0 THEN 'full' ELSE 'partial' END AS state, CASE WHEN n_sources > 0 THEN 1 - CASE WHEN covered THEN 0 ELSE 50 - coalesce(len, 0) END / 50.0 END::DOUBLE AS covered_fraction FROM f LEFT JOIN u USING (k)
""")
def coverage_state(t: Tables) -> DataFrame:
    """Coverage of an area per order: one covering source first, else the union; never the fraction."""
    aois = t.orders.select(F.col("o_orderkey").alias("k"), F.lit(20).cast("long").alias("low"), F.lit(70).cast("long").alias("high"))
    c = boxes.coverage_state(aois, _spans(t), "k")
    return c.withColumn("covered_fraction", F.col("covered_fraction").cast("double"))


@R.add(f"""
WITH s AS ({SPANS_SQL}), c AS (SELECT k, low AS a, high AS b FROM s) {ISLANDS_SQL}
SELECT k, len AS covered FROM u
""")
def interval_union(t: Tables) -> DataFrame:
    """Length that the spans of each order cover, overlaps once."""
    return sequences.union_length(_spans(t), ["k"], "low", "high", "covered")


@R.add(f"""
WITH s AS ({SPANS_SQL}), p AS (SELECT s.k, range AS x, bool_or(low % 3 = 0) AS base FROM s, range(0, 200) AS r(range) WHERE range >= low AND range < high GROUP BY ALL)
SELECT k, count(*) FILTER (NOT base)::BIGINT AS newly_covered FROM p GROUP BY 1
""")
def newly_covered(t: Tables) -> DataFrame:
    """Length that proposals add to what accepted spans cover."""
    spans = sequences.dealt(_spans(t), ["k"])
    lengths = sequences.union_lengths(spans, ["k"], "low", "high", {"whole": None, "base": F.col("low") % 3 == 0})
    return lengths.select("k", (F.col("whole") - F.coalesce("base", F.lit(0))).alias("newly_covered"))


@R.add("""
WITH v AS (SELECT l_suppkey, bool_and(l_quantity < 50) AS all_valid, count(*) AS n_vertices, min(l_partkey) AS x0, min(l_linenumber) AS y0, max(l_partkey) AS x1, max(l_linenumber) AS y1 FROM lineitem GROUP BY 1)
SELECT l_suppkey, n_vertices, all_valid, CASE WHEN all_valid THEN x0::DOUBLE END AS xmin, CASE WHEN all_valid THEN y0::DOUBLE END AS ymin, CASE WHEN all_valid THEN x1::DOUBLE END AS xmax, CASE WHEN all_valid THEN y1::DOUBLE END AS ymax FROM v
""")
def held_envelope(t: Tables) -> DataFrame:
    """Extents of groups, given only if every vertex is valid."""
    return boxes.held_extent(t.lineitem, ["l_suppkey"], "l_partkey", "l_linenumber", F.col("l_quantity") < 50)


@R.add("""
WITH e AS (SELECT min(l_partkey) AS x0, max(l_partkey) AS x1, min(l_suppkey) AS y0, max(l_suppkey) AS y1 FROM lineitem), d AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT (greatest(0, least(3, floor((l_suppkey - y0) * 4 / (y1 - y0)))) * 4 + greatest(0, least(3, floor((l_partkey - x0) * 4 / (x1 - x0)))))::INT AS tile, count(*) AS n FROM d, e GROUP BY 1
""")
def grid_tiles(t: Tables) -> DataFrame:
    """Distinct points per tile of a four by four tiling of their extent."""
    e = t.lineitem.agg(F.min("l_partkey").alias("x0"), F.max("l_partkey").alias("x1"), F.min("l_suppkey").alias("y0"), F.max("l_suppkey").alias("y1"))
    points = t.lineitem.select("l_partkey", "l_suppkey").distinct().crossJoin(F.broadcast(e))  # one row of parameters
    place = lambda v, lo, hi: F.greatest(F.lit(0), F.least(F.lit(3), F.floor((F.col(v) - F.col(lo)) * 4 / (F.col(hi) - F.col(lo))))).cast("int")
    tile = place("l_suppkey", "y0", "y1") * 4 + place("l_partkey", "x0", "x1")
    return points.select(tile.alias("tile")).groupBy("tile").agg(F.count("*").alias("n"))


@R.add("""
WITH q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT q.vec_id AS id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS dist, q.label = e.label AS same FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
SELECT id, n, CASE WHEN n = 0 THEN 'none' WHEN n > 1 THEN 'multiple' WHEN ok = 1 THEN 'single_agree' ELSE 'single_conflict' END AS match_class FROM (SELECT id, count(*) FILTER (dist <= 9.2) AS n, count(*) FILTER (dist <= 9.2 AND same) AS ok FROM d GROUP BY 1)
""")
def distance_gate(t: Tables) -> DataFrame:
    """Match class of every twentieth vector against all vectors within a gate.

    The query vectors are a stated set; they meet the table in blocks and tiles of bounded size.
    """
    all_vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    m = vectors.matches_within(all_vectors.filter("id % 20 = 0"), all_vectors, 9.2)
    kind = F.when(F.col("n") == 0, "none").when(F.col("n") > 1, "multiple").when(F.col("n_same") == 1, "single_agree").otherwise("single_conflict")
    return m.select("id", "n", kind.alias("match_class"))


GRID_SQL = "SELECT (l_partkey % 60)::INT AS row, (l_suppkey % 40)::INT AS col, sum(l_quantity) / 10 AS value, count(*) % 9 <> 0 AS valid FROM lineitem GROUP BY 1, 2"


def _grid(t: Tables) -> DataFrame:
    rows = t.lineitem.select((F.col("l_partkey") % 60).cast("int").alias("row"), (F.col("l_suppkey") % 40).cast("int").alias("col"), "l_quantity")
    return rows.groupBy("row", "col").agg((F.sum("l_quantity") / 10).alias("value"), (F.count("*") % 9 != 0).alias("valid"))


@R.add(f"""
WITH g AS ({GRID_SQL}), n AS (SELECT a.row, a.col, b.row - a.row AS dr, b.col - a.col AS dc, b.value FROM g b JOIN (SELECT row, col FROM g UNION SELECT row + r, col + c FROM g, (VALUES (-1), (0), (1)) AS x(r), (VALUES (-1), (0), (1)) AS y(c)) a ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 WHERE b.valid),
s AS (SELECT row, col, count(*) AS n, sum(value * dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END) / 8 AS x, sum(value * dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END) / 8 AS y FROM n GROUP BY ALL)
SELECT row, col, round(degrees(atan(sqrt(x * x + y * y))), 6) AS slope FROM s WHERE n = 9
""")
def grid_slope(t: Tables) -> DataFrame:
    """Slope of a grid where all nine cells are valid."""
    return raster.horn_slope(_grid(t)).select("row", "col", F.round("slope", 6).alias("slope"))


@R.add(f"""
WITH g AS ({GRID_SQL}), q AS (SELECT DISTINCT (l_orderkey % 58)::DOUBLE + 0.25 AS y, (l_linenumber * 5)::DOUBLE + 0.75 AS x FROM lineitem),
s AS (SELECT y, x, count(value) AS n, sum(value * CASE WHEN row = floor(y) THEN 0.75 ELSE 0.25 END * CASE WHEN col = floor(x) THEN 0.25 ELSE 0.75 END) AS v FROM q LEFT JOIN g ON valid AND row BETWEEN floor(y) AND floor(y) + 1 AND col BETWEEN floor(x) AND floor(x) + 1 GROUP BY ALL)
SELECT y, x, CASE WHEN n = 4 THEN round(v, 6) END AS sample FROM s
""")
def grid_bilinear(t: Tables) -> DataFrame:
    """Bilinear samples; each needs four valid cells."""
    targets = t.lineitem.select(((F.col("l_orderkey") % 58).cast("double") + 0.25).alias("y"), ((F.col("l_linenumber") * 5).cast("double") + 0.75).alias("x")).distinct()
    return raster.bilinear(_grid(t), targets).select("y", "x", F.round("sample", 6).alias("sample"))


@R.add(f"""
WITH g AS ({GRID_SQL})
SELECT a.row, a.col, 'right' AS direction, a.valid AS valid_here FROM g a JOIN g b ON b.row = a.row AND b.col = a.col + 1 WHERE a.valid <> b.valid
UNION ALL SELECT a.row, a.col, 'down', a.valid FROM g a JOIN g b ON b.row = a.row + 1 AND b.col = a.col WHERE a.valid <> b.valid
""")
def seam_edges(t: Tables) -> DataFrame:
    """Edges between valid cells and NoData."""
    return raster.seam_edges(_grid(t))


@R.add(f"""
WITH g AS (SELECT row, col, (value > 40)::VARCHAR AS label FROM ({GRID_SQL}))
SELECT a.row, a.col FROM (SELECT DISTINCT row + r AS row, col + c AS col FROM g, (VALUES (-1), (0), (1)) AS x(r), (VALUES (-1), (0), (1)) AS y(c)) a JOIN g b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY a.row, a.col HAVING count(*) = 9 AND count(DISTINCT label) > 1
""")
def boundary_hold(t: Tables) -> DataFrame:
    """Cells whose nine labels do not agree."""
    return raster.boundary_cells(_grid(t).select("row", "col", (F.col("value") > 40).alias("label")))


@R.add(f"""
WITH g AS (SELECT row < 30 AS upper, col < 20 AS lefter, CASE WHEN valid THEN value ELSE -9999 END AS value FROM ({GRID_SQL}))
SELECT upper, lefter, count(*) AS n_cells, count(*) FILTER (value = -9999) AS n_nodata, 0::BIGINT AS n_nonfinite, count(*) FILTER (value <> -9999) AS n_valid FROM g GROUP BY ALL
""")
def quadrant_validity(t: Tables) -> DataFrame:
    """Valid, NoData and non-finite cells per quadrant."""
    g = _grid(t).select((F.col("row") < 30).alias("upper"), (F.col("col") < 20).alias("lefter"), F.when(F.col("valid"), F.col("value")).otherwise(-9999.0).alias("value"))
    return raster.validity(g, ["upper", "lefter"], -9999.0)


@R.add(f"""
WITH g AS (SELECT row // 10 AS patch, col::DOUBLE AS x, row::DOUBLE AS y, value AS z FROM ({GRID_SQL}))
SELECT patch::INT AS patch, n, round(a, 6) AS a, round(b, 6) AS b, round(c, 5) AS c, round(rms, 5) AS rms FROM (
SELECT patch, count(*) AS n, any_value(m.a) AS a, any_value(m.b) AS b, any_value(m.c) AS c, sqrt(avg((z - m.a * x - m.b * y - m.c) ** 2)) AS rms FROM g JOIN (
SELECT patch, (cxz * vy - cyz * cxy) / (vx * vy - cxy * cxy) AS a, (cyz * vx - cxz * cxy) / (vx * vy - cxy * cxy) AS b, mz - (cxz * vy - cyz * cxy) / (vx * vy - cxy * cxy) * mx - (cyz * vx - cxz * cxy) / (vx * vy - cxy * cxy) * my AS c FROM (SELECT patch, covar_pop(x, z) AS cxz, covar_pop(y, z) AS cyz, covar_pop(x, y) AS cxy, var_pop(x) AS vx, var_pop(y) AS vy, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM g GROUP BY 1)) m USING (patch) GROUP BY patch)
""")
def plane_fit(t: Tables) -> DataFrame:
    """Least-squares planes of ten-row patches and their residuals."""
    g = _grid(t).select(F.floor(F.col("row") / 10).cast("int").alias("patch"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), F.col("value").alias("z"))
    p = raster.plane_fit(g, ["patch"])
    return p.select("patch", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("c", 5).alias("c"), F.round("rms", 5).alias("rms"))


@R.add("""
WITH g AS (SELECT l_returnflag AS s, (l_partkey % 60)::INT AS row, (l_suppkey % 40)::INT AS col, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT a.s AS a, b.s AS b, count(*) AS n, round(avg(a.v - b.v), 6) AS mean, max(abs(a.v - b.v)) AS max_abs FROM g a JOIN g b ON a.row = b.row AND a.col = b.col AND a.s < b.s GROUP BY ALL
""")
def raster_pairs(t: Tables) -> DataFrame:
    """Differences of each pair of grids on the cells that both hold."""
    rows = t.lineitem.select(F.col("l_returnflag").alias("source"), (F.col("l_partkey") % 60).cast("int").alias("row"), (F.col("l_suppkey") % 40).cast("int").alias("col"), "l_quantity")
    grids = rows.groupBy("source", "row", "col").agg(F.sum("l_quantity").alias("value")).withColumn("valid", F.lit(True))
    return raster.pair_differences(grids).groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg("difference"), 6).alias("mean"), F.max(F.abs("difference")).alias("max_abs"))
