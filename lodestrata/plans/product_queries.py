"""Queries of polygon kernels and end products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.geometry import frames
from lodestrata.operators.boxes import BOX
from lodestrata.plans.spatial_queries import PARTS_SQL, ZONES_SQL, _parts, _zones
from lodestrata.plans.tables import Registry, Tables
from lodestrata.products import qualification, ranking, soils
from lodestrata.sources import binary_formats

R = Registry()


def _ring(xmin, ymin, xmax, ymax):
    p = lambda x, y: F.array(x, y)
    return F.array(p(xmin, ymin), p(xmin, ymax), p(xmax, ymax), p(xmax, ymin), p(xmin, ymin))


def _as_region(df: DataFrame) -> DataFrame:
    """Boxes as regions of one polygon, through the ring decoder; equal boxes are decoded once."""
    rings = df.select(*BOX).distinct().withColumn("d", frames.decoded_rings(F.array(_ring(*[F.col(c) for c in BOX]))))
    return df.join(rings, list(BOX), "left").select("id", F.col("d.region").alias("region"), *BOX)


@R.add(f"""
WITH a AS ({PARTS_SQL}), b AS ({ZONES_SQL})
SELECT a.id AS a_id, b.id AS b_id, (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS both_area FROM a JOIN b ON a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax
""")
def polygon_overlay(t: Tables) -> DataFrame:
    """Areas that polygons share, by the slab kernel over pairs from the grid join."""
    pairs = frames.overlaid(_as_region(_parts(t)), _as_region(_zones(t)), 64.0)
    return pairs.select("a_id", "b_id", F.round("both", 6).alias("both_area")).filter("both_area > 0")


@R.add(f"""
WITH a AS ({ZONES_SQL}), b AS ({PARTS_SQL}),
o AS (SELECT a.id, b.id AS b, (least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) AS ar FROM a JOIN b ON a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax),
c AS (SELECT a.id, count(*) AS cells FROM a, range(0, 2400) r(i) WHERE EXISTS (SELECT 1 FROM b WHERE b.xmin <= a.xmin + i % 60 AND b.xmax >= a.xmin + i % 60 + 1 AND b.ymin <= a.ymin + i // 60 AND b.ymax >= a.ymin + i // 60 + 1) GROUP BY 1),
s AS (SELECT id, count(*) FILTER (ar > 0) AS n, sum(ar) FILTER (ar > 0) AS total, count(*) FILTER (ar = 0) AS touch FROM o GROUP BY 1)
SELECT a.id, coalesce(n, 0)::INT AS n_overlaps, total AS area_sum, round(cells / 2400.0::DOUBLE, 6) AS covered_fraction, coalesce(touch, 0)::INT AS n_touch, CASE WHEN n > 0 THEN 'overlap' WHEN touch > 0 THEN 'touch_only' ELSE 'no_evidence' END AS status FROM a LEFT JOIN s USING (id) LEFT JOIN c USING (id)
""")
def zoning_screening(t: Tables) -> DataFrame:
    """Zones screened against parts: overlaps, area sums, covered fractions, touches."""
    zones = _as_region(_parts(t)).withColumn("zone", F.concat(F.lit("Z"), (F.col("id") % 5).cast("string")))
    s = frames.screen(_as_region(_zones(t)), zones, 64.0)
    return s.select("id", F.coalesce("n_overlaps", F.lit(0)).alias("n_overlaps"), F.round("area_sum", 6).alias("area_sum"), F.round("covered_fraction", 6).alias("covered_fraction"), F.coalesce("n_touch", F.lit(0)).alias("n_touch"), "status")


@R.add(f"""
WITH a AS ({ZONES_SQL}), f AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'zoning' ELSE 'wetlands' END AS topic, id % 13 = 0 AS held FROM ({PARTS_SQL})),
p AS (SELECT a.id AS aoi_id, topic, f.id, held, least(a.xmax, f.xmax) > greatest(a.xmin, f.xmin) AND least(a.ymax, f.ymax) > greatest(a.ymin, f.ymin) AS inside FROM a JOIN f ON a.xmin <= f.xmax AND f.xmin <= a.xmax AND a.ymin <= f.ymax AND f.ymin <= a.ymax),
s AS (SELECT aoi_id, topic, count(*) FILTER (NOT held AND inside) AS n_interior, count(*) FILTER (NOT held AND NOT inside) AS n_touch, count(*) FILTER (held) AS n_held FROM p GROUP BY ALL),
c AS (SELECT a.id AS aoi_id, topic, count(DISTINCT i) AS cells FROM a JOIN f ON NOT held AND a.xmin < f.xmax AND f.xmin < a.xmax AND a.ymin < f.ymax AND f.ymin < a.ymax, range(0, 2400) r(i) WHERE f.xmin <= a.xmin + i % 60 AND f.xmax >= a.xmin + i % 60 + 1 AND f.ymin <= a.ymin + i // 60 AND f.ymax >= a.ymin + i // 60 + 1 GROUP BY ALL)
SELECT a.id AS aoi_id, t.topic, CASE WHEN a.id % 4 = 0 THEN 'stale' WHEN coalesce(n_interior, 0) + coalesce(n_held, 0) > 0 THEN 'review_required' ELSE 'missing' END AS status, coalesce(n_interior, 0)::INT AS n_interior, coalesce(n_touch, 0)::INT AS n_touch, coalesce(n_held, 0)::INT AS n_blocks,
CASE WHEN coalesce(n_interior, 0) = 0 THEN 'missing' WHEN cells = 2400 THEN 'full_geometric' ELSE 'partial_geometric' END AS coverage, (a.id % 4 <> 0 AND coalesce(n_held, 0) = 0 AND coalesce(n_interior, 0) > 0) AS intersections_usable, round(coalesce(cells, 0) / 2400.0::DOUBLE, 6) AS fraction
FROM a CROSS JOIN (VALUES ('zoning'), ('wetlands')) t(topic) LEFT JOIN s ON s.aoi_id = a.id AND s.topic = t.topic LEFT JOIN c ON c.aoi_id = a.id AND c.topic = t.topic
""")
def area_packets(t: Tables) -> DataFrame:
    """Topic states of areas under features, some of them held."""
    aois = _as_region(_zones(t)).select(F.col("id").alias("aoi_id"), "region", F.lit(True).alias("within_scope"), (F.col("id") % 4 != 0).alias("snapshot_current"))
    held = F.col("id") % 13 == 0
    source = F.when(F.col("id") % 2 == 0, "parts-even").otherwise("parts-odd")
    features = _as_region(_parts(t)).select(source.alias("source_id"), F.col("id").alias("object_id"), F.when(~held, F.col("region")).alias("region"), F.when(held, "ring held").alias("hold"), F.when(held, F.struct(*BOX)).alias("held_bounds"))
    topics = t.spark.createDataFrame([("zoning", "parts-even"), ("wetlands", "parts-odd")], "topic string, source_id string")
    q = qualification.qualify(aois, features, topics, 64.0)
    return q.select("aoi_id", "topic", "status", "n_interior", "n_touch", "n_blocks", "coverage", "intersections_usable", F.round("fraction", 6).alias("fraction"))


@R.add(f"""
WITH h AS ({PARTS_SQL}), g AS ({ZONES_SQL}),
p AS (SELECT h.id, coalesce(sum(CASE WHEN g.id IS NULL THEN 0 ELSE greatest(0, least(h.xmax, g.xmax) - greatest(h.xmin, g.xmin)) * greatest(0, least(h.ymax, g.ymax) - greatest(h.ymin, g.ymin)) END), 0) AS area FROM h LEFT JOIN g ON h.xmin <= g.xmax AND g.xmin <= h.xmax AND h.ymin <= g.ymax AND g.ymin <= h.ymax GROUP BY 1),
r AS (SELECT id, area, row_number() OVER (ORDER BY area DESC, id) AS previous_rank, CASE WHEN id % 8 = 0 THEN area / 2 ELSE 0 END AS reduction FROM p)
SELECT id AS object_id, round(area - reduction, 6) AS area, previous_rank::INT AS previous_rank, row_number() OVER (ORDER BY area - reduction DESC, id)::INT AS rank FROM r
""")
def gap_ranking(t: Tables) -> DataFrame:
    """Held envelopes ranked by the gap area in them, before and after reductions."""
    held = _parts(t).select(F.col("id").alias("object_id"), *BOX)
    gaps = _as_region(_zones(t)).select(F.col("id").alias("gap_id"), "region")
    from lodestrata.operators.sequences import ranked

    first = ranked(ranking.gap_areas(held, gaps, 64.0), "area", "object_id", "rank")
    reductions = first.filter("object_id % 8 = 0").select("object_id", (F.col("area") / 2).alias("area"))
    return ranking.refresh(first, reductions).select("object_id", F.round("area", 6).alias("area"), "previous_rank", "rank")


@R.add("""
WITH c AS (SELECT l_orderkey AS mukey, count(*) AS component_count, count(CASE WHEN l_linenumber <> 6 THEN 1 END) AS known, sum(CASE WHEN l_linenumber <> 6 THEN CAST(l_quantity AS DECIMAL(12, 4)) END) AS s FROM lineitem GROUP BY 1)
SELECT mukey, component_count, CASE WHEN known = component_count THEN s END::DOUBLE AS listed_total, CASE WHEN known = component_count AND s <= 100 THEN 100 - s END::DOUBLE AS unlisted, CASE WHEN known < component_count THEN 'unknown' WHEN s < 100 THEN 'under_100' WHEN s > 100 THEN 'over_100' ELSE 'sums_to_100' END AS percentage_state FROM c
""")
def component_mixtures(t: Tables) -> DataFrame:
    """Component percentages per unit; a blank percentage makes the unit unknown."""
    percent = F.when(F.col("l_linenumber") == 6, " ").otherwise(F.col("l_quantity").cast("decimal(12,4)").cast("string"))
    m = soils.mixtures(t.lineitem.select(F.col("l_orderkey").alias("mukey"), percent.alias("percent")))
    return m.withColumns({"listed_total": F.col("listed_total").cast("double"), "unlisted": F.col("unlisted").cast("double")})


@R.add("""
SELECT o_orderkey AS cokey, count(l_orderkey) AS horizon_count, CASE WHEN count(l_orderkey) > 0 THEN 'records_present' WHEN o_orderpriority = '1-URGENT' THEN 'absent_miscellaneous_area' ELSE 'absent_requires_review' END AS horizon_state FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority
""")
def horizon_states(t: Tables) -> DataFrame:
    """Horizons of components and what their absence means."""
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "Miscellaneous area").otherwise("Series")
    return soils.horizon_states(t.orders.select(F.col("o_orderkey").alias("cokey"), kind.alias("compkind")), t.lineitem.select(F.col("l_orderkey").alias("cokey")))


@R.add("""
SELECT c_custkey AS mukey, 'legend:' || c_nationkey AS missing FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)
UNION ALL SELECT c_custkey, 'components:' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
""")
def missing_links(t: Tables) -> DataFrame:
    """Units without a legend or without components."""
    units = t.customer.select(F.col("c_custkey").alias("mukey"), F.col("c_nationkey").alias("lkey"))
    legends = t.nation.filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("lkey"))
    return soils.missing_links(units, legends, t.orders.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("mukey")))


@R.add("""
WITH d AS (SELECT user_id, max(event_id)::VARCHAR AS dep FROM events WHERE event_id % 20 <> 7 GROUP BY 1), n AS (SELECT user_id, max(event_id)::VARCHAR AS dep FROM events WHERE user_id % 9 <> 0 GROUP BY 1)
SELECT user_id, array_to_string(list_filter([CASE WHEN user_id % 11 = 0 THEN 'qualification_method_changed' END, CASE WHEN d.dep IS DISTINCT FROM n.dep THEN 'captured_dependencies_changed' END, CASE WHEN n.dep IS NULL OR user_id % 7 = 0 THEN 'geometry_snapshot_stale' END, CASE WHEN n.dep IS NULL THEN 'source_audit_missing' END], lambda x: x IS NOT NULL), ',') AS reasons FROM d LEFT JOIN n USING (user_id)
""")
def packet_currency(t: Tables) -> DataFrame:
    """Packets whose dependencies, method or snapshot have moved on."""
    dep = F.max("event_id").cast("string").alias("dependencies")
    packets = t.events.filter("event_id % 20 <> 7").groupBy("user_id").agg(dep).withColumn("method", F.when(F.col("user_id") % 11 == 0, "v0").otherwise("v1"))
    context = t.events.filter("user_id % 9 <> 0").groupBy("user_id").agg(dep).withColumn("snapshot_current", F.col("user_id") % 7 != 0)
    return qualification.currency(packets, context, ["user_id"], "v1").select("user_id", F.array_join("reasons", ",").alias("reasons"))


@R.add("""
WITH h AS (SELECT page_id, len(regexp_extract_all(html, '<a[^>]*href\\s*=\\s*["''][^"'']+')) AS n FROM pages)
SELECT page_id, n::INT AS n_links FROM h
""")
def parsed_links(t: Tables) -> DataFrame:
    """Absolute links of raw pages by a parser that knows <base>."""
    return t.pages.select("page_id", F.size(binary_formats.page_links("url", "html")).alias("n_links"))
