"""Queries of whole packets, text geometries and colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.stages import Stages
from lodestrata.geometry.frames import box_region
from lodestrata.operators.boxes import BOX
from lodestrata.plans.spatial_queries import PARTS_SQL, ZONES_SQL, _parts, _zones
from lodestrata.plans.tables import Registry, Tables
from lodestrata.products import packet
from lodestrata.sources import text_geometry

R = Registry()
CELL = 64.0

_STANDING = ",".join(packet.SOIL_STANDING)


@R.add(f"""
WITH a AS (SELECT *, id % 4 <> 0 AS current, id % 5 <> 2 AS soils_current, id % 9 <> 1 AS asked, id % 7 <> 3 AS within_scope, id % 2 = 0 AS buys FROM ({ZONES_SQL})),
p AS (SELECT *, id % 40 AS mukey, id % 13 = 0 AS held FROM ({PARTS_SQL})),
units AS (SELECT m AS mukey, m % 7 AS lkey FROM range(0, 40) t(m) WHERE m <> 11 AND m IN (SELECT p_partkey % 40 FROM part)),
comps AS (SELECT s_suppkey AS cokey, s_suppkey % 40 AS mukey, CASE WHEN s_suppkey % 10 = 9 THEN NULL WHEN s_suppkey % 3 = 0 THEN 100 ELSE 50 END AS percent, s_nationkey % 2 = 0 AS has_horizons FROM supplier),
mix AS (SELECT mukey, count(*) = count(percent) AND sum(percent) = 100 AS full_sum, bool_or(NOT has_horizons) AS bare FROM comps GROUP BY 1),
m AS (SELECT a.id, p.id AS pid, p.mukey, p.held, least(a.xmax, p.xmax) > greatest(a.xmin, p.xmin) AND least(a.ymax, p.ymax) > greatest(a.ymin, p.ymin) AS inside,
  greatest(p.xmin, a.xmin) AS x0, least(p.xmax, a.xmax) AS x1, greatest(p.ymin, a.ymin) AS y0, least(p.ymax, a.ymax) AS y1, a.xmin AS ax, a.ymin AS ay
  FROM a JOIN p ON a.xmin <= p.xmax AND p.xmin <= a.xmax AND a.ymin <= p.ymax AND p.ymin <= a.ymax),
c AS (SELECT id, count(DISTINCT i) AS cells FROM m, range(0, 2400) r(i) WHERE NOT held AND inside AND x0 <= ax + i % 60 AND x1 >= ax + i % 60 + 1 AND y0 <= ay + i // 60 AND y1 >= ay + i // 60 + 1 GROUP BY 1),
n AS (SELECT id, count(*) FILTER (held) AS n_held, count(*) FILTER (NOT held) AS n_records FROM m GROUP BY 1),
u AS (
  SELECT k.id, bool_or(units.mukey IS NULL OR units.lkey = 3 OR mix.mukey IS NULL) AS missing_links, bool_or(units.mukey IS NOT NULL AND coalesce(NOT full_sum, true)) AS odd_sums, bool_or(units.mukey IS NOT NULL AND coalesce(bare, false)) AS bare
  FROM (SELECT DISTINCT id, mukey FROM m WHERE NOT held AND inside) k LEFT JOIN units USING (mukey) LEFT JOIN mix USING (mukey) GROUP BY 1
),
b AS (SELECT a.*, coalesce(n_held, 0) AS n_held, coalesce(n_records, 0) AS n_records, coalesce(cells, 0) AS cells, missing_links, odd_sums, bare,
  concat_ws(',', CASE WHEN NOT soils_current THEN 'soil_geometry_snapshot_stale' END, CASE WHEN NOT current THEN 'county_geometry_snapshot_stale' END, CASE WHEN NOT within_scope THEN 'aoi_outside_qualified_scope' END,
    CASE WHEN n_held > 0 THEN 'soil_geometry_holds_require_review' END, CASE WHEN missing_links THEN 'missing_required_soil_links' END, CASE WHEN coalesce(cells, 0) < 2400 THEN 'incomplete_soil_geometric_coverage' END) AS blocking
  FROM a LEFT JOIN n USING (id) LEFT JOIN c USING (id) LEFT JOIN u USING (id)),
t AS (SELECT a.id, count(r.r_regionkey) AS n FROM a LEFT JOIN region r ON r.r_regionkey <> 1 AND a.xmin <= r.r_regionkey * 200 + 150 AND a.xmax >= r.r_regionkey * 200 AND a.ymin <= 500 AND a.ymax >= 100 GROUP BY 1)
SELECT id AS aoi_id, 'soils' AS topic, CASE WHEN NOT asked THEN 'missing' WHEN NOT soils_current THEN 'stale' WHEN n_records + n_held > 0 THEN 'review_required' ELSE 'missing' END AS status,
  asked AND blocking = '' AND missing_links IS NOT NULL AS usable,
  CASE WHEN NOT asked THEN 'soil_source_versions_not_requested' ELSE concat_ws(',', CASE WHEN blocking <> '' THEN blocking END, '{_STANDING}', CASE WHEN odd_sums THEN 'component_percentages_not_complete_distribution' END, CASE WHEN bare THEN 'some_components_have_no_horizons' END) END AS reasons FROM b
UNION ALL SELECT id, 'terrain', CASE WHEN n > 0 THEN 'review_required' ELSE 'missing' END, false, '{",".join(packet.TERRAIN_STANDING)}' FROM t
UNION ALL SELECT id, 'flood', CASE WHEN id % 6 = 1 THEN 'review_required' ELSE 'missing' END, false, '{",".join(packet.FLOOD_STANDING)}' FROM a
UNION ALL SELECT id, topic, CASE WHEN buys THEN 'review_required' ELSE 'not_requested' END, false, CASE WHEN topic = 'access_title' THEN 'rights_not_established_by_mapped_access' WHEN buys THEN 'purchase_candidate_site_investigation_required' ELSE 'purchase_investigation_not_requested' END
  FROM a, (VALUES ('septic_suitability'), ('buildability'), ('access_title')) s(topic)
""")
def whole_packets(t: Tables) -> DataFrame:
    """Soils, terrain, flood and site topics of every area, with reasons."""
    box = box_region(*[F.col(c) for c in BOX])
    k = F.col("id")
    areas = _zones(t).select(
        k.alias("aoi_id"), box.alias("region"), (k % 4 != 0).alias("snapshot_current"), (k % 5 != 2).alias("soils_current"), (k % 9 != 1).alias("soils_requested"),
        (k % 7 != 3).alias("within_scope"), (k % 2 == 0).alias("purchase_candidate"),
    )
    polygons = _parts(t).select(k.alias("polygon_id"), (k % 40).alias("mukey"), F.array(box[0]).alias("region"), F.when(k % 13 == 0, "held").alias("hold"))
    units = t.part.select((F.col("p_partkey") % 40).alias("mukey")).distinct().filter("mukey <> 11").withColumn("lkey", F.col("mukey") % 7)
    legends = t.spark.range(0, 7).select(F.col("id").alias("lkey")).filter("lkey <> 3")
    s = F.col("s_suppkey")
    percent = F.when(s % 10 == 9, " ").when(s % 3 == 0, "100").otherwise("50")
    components = t.supplier.select(s.alias("cokey"), (s % 40).alias("mukey"), percent.alias("percent"), F.lit("Series").alias("compkind"))
    horizons = t.supplier.filter("s_nationkey % 2 = 0").select(s.alias("cokey"))
    r = F.col("r_regionkey").cast("double")
    products = t.region.filter("r_regionkey <> 1").select(F.col("r_regionkey").alias("source_id"), (r * 200).alias("xmin"), F.lit(100.0).alias("ymin"), (r * 200 + 150).alias("xmax"), F.lit(500.0).alias("ymax"))
    rows = packet.whole(
        packet.soil_topic(areas, polygons, units, legends, components, horizons, CELL, Stages(t.spark, "soils")), packet.terrain_topic(areas, products, CELL),
        packet.flood_topic(areas, areas.filter("aoi_id % 6 = 1").select("aoi_id")), packet.site_topics(areas),
    )
    return rows.withColumn("reasons", F.array_join("reasons", ","))


@R.add("""
WITH p AS (SELECT p_partkey AS id, p_size AS w, p_size % 7 + 3 AS h FROM part)
SELECT id, CASE WHEN id % 5 = 4 THEN NULL WHEN id % 5 = 1 AND w >= 3 THEN (w * h - (w - 2) * (h - 2))::DOUBLE WHEN id % 5 = 2 THEN (w * h + 1)::DOUBLE ELSE (w * h)::DOUBLE END AS wkt_area,
  CASE WHEN id % 5 IN (3, 4) THEN NULL WHEN id % 5 = 1 AND w >= 3 THEN (w * h - (w - 2) * (h - 2))::DOUBLE WHEN id % 5 = 2 THEN (w * h + 1)::DOUBLE ELSE (w * h)::DOUBLE END AS geojson_area FROM p
""")
def text_geometries(t: Tables) -> DataFrame:
    """Areas of polygons that come as WKT and as GeoJSON: with holes, in several parts, and in texts that are neither."""
    k, w, h = F.col("p_partkey"), F.col("p_size"), F.col("p_size") % 7 + 3
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    corners = lambda inset: ((k + inset, F.lit(inset)), (k + w - inset, F.lit(inset)), (k + w - inset, h - inset), (k + inset, h - inset), (k + inset, F.lit(inset)))
    unit = ((-k - 2, F.lit(0)), (-k - 1, F.lit(0)), (-k - 1, F.lit(1)), (-k - 2, F.lit(1)), (-k - 2, F.lit(0)))

    def ring(points, begin, between, end, sep):
        return text(begin, *[v for n, (x, y) in enumerate(points) for v in ((sep if n else ""), x, between, y)], end)

    wkt = lambda points: ring(points, "(", " ", ")", ", ")
    js = lambda points: ring(points, "[[", ",", "]]", "],[")
    holed, parts = (k % 5 == 1) & (w >= 3), k % 5 == 2
    as_wkt = F.when(k % 5 == 4, text("LINESTRING ", wkt(corners(0)))).when(holed, text("POLYGON (", wkt(corners(0)), ", ", wkt(corners(1)), ")")).when(
        parts, text("MULTIPOLYGON ((", wkt(corners(0)), "), (", wkt(unit), "))")).otherwise(text("polygon(", wkt(corners(0)), ")"))
    as_json = F.when(k % 5 == 4, '{"type":"Polygon","coordinates":[[["0","0"],[1,0],[1,1],[0,0]]]}').when(k % 5 == 3, text('{"type":"LineString","coordinates":', js(corners(0)), "}")).when(
        holed, text('{"type":"Polygon","coordinates":[', js(corners(0)), ",", js(corners(1)), "]}")).when(
        parts, text('{"type":"MultiPolygon","coordinates":[[', js(corners(0)), "],[", js(unit), "]]}")).otherwise(text('{"type":"Polygon","coordinates":[', js(corners(0)), "]}"))
    rows = t.part.select(k.alias("id"), text_geometry.wkt_region(as_wkt).alias("a"), text_geometry.geojson_region(as_json).alias("b"))
    return rows.select("id", text_geometry.region_area(F.col("a")).alias("wkt_area"), text_geometry.region_area(F.col("b")).alias("geojson_area"))


@R.add("""
SELECT l_suppkey % 5 AS image, l_quantity::INT % 4 * 80 AS r, l_linenumber * 30 AS g, (l_discount * 100)::INT AS b, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 255 END AS a, count(*) AS n FROM lineitem GROUP BY ALL
""")
def colour_histogram(t: Tables) -> DataFrame:
    """How often each colour occurs in each image."""
    pixels = t.lineitem.select(
        (F.col("l_suppkey") % 5).alias("image"), (F.col("l_quantity").cast("int") % 4 * 80).alias("r"), (F.col("l_linenumber") * 30).alias("g"),
        F.round(F.col("l_discount") * 100).cast("int").alias("b"), F.when(F.col("l_returnflag") == "N", 0).otherwise(255).alias("a"),
    )
    return pixels.groupBy("image", "r", "g", "b", "a").agg(F.count("*").alias("n"))
