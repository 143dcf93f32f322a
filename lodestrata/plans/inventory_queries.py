"""Queries of ingestion pages, source conflicts and placements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.geometry.frames import box_region
from lodestrata.operators.boxes import BOX
from lodestrata.plans.spatial_queries import PARTS_SQL, ZONES_SQL, _parts, _zones
from lodestrata.plans.tables import Registry, Tables
from lodestrata.products import conflicts, ingestion

R = Registry()


@R.add("""
WITH ids AS (SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS page FROM orders),
p AS (SELECT page, CASE WHEN id % 997 = 5 THEN -id - 1 ELSE id END AS id FROM ids WHERE id % 1009 <> 3 UNION ALL SELECT page, id FROM ids WHERE id % 503 = 7),
c AS (SELECT id, count(*) AS n, min(page) AS page FROM p GROUP BY 1), s AS (SELECT page, count(*) AS n FROM p GROUP BY 1)
SELECT 'unexpected' AS fault, page AS page_no, id AS object_id, 1 AS n FROM c WHERE id NOT IN (SELECT id FROM ids)
UNION ALL SELECT 'missing', NULL, id, 1 FROM ids WHERE id NOT IN (SELECT id FROM c)
UNION ALL SELECT 'repeated', page, id, n FROM c WHERE n > 1
UNION ALL SELECT CASE WHEN n > 100 THEN 'too_long' ELSE 'short' END, page, NULL, n FROM s WHERE n > 100 OR (n < 100 AND page < (SELECT max(page) FROM s))
""")
def page_faults(t: Tables) -> DataFrame:
    """Objects that pages miss, repeat or add, and pages that are short or too long."""
    from lodestrata.operators.sequences import numbered

    k = F.col("object_id")
    ids = numbered(t.orders.select(F.col("o_orderkey").alias("object_id")), [], [k.asc()], "no").select("object_id", F.expr("(no - 1) div 100").alias("page_no"))
    came = ids.filter(k % 1009 != 3).withColumn("object_id", F.when(k % 997 == 5, -k - 1).otherwise(k)).unionByName(ids.filter(k % 503 == 7))
    return ingestion.page_faults(came, ids.select("object_id"), 100)


_KEYS = """
records AS (SELECT o_orderkey AS object_id, CASE WHEN o_orderstatus = 'F' THEN 'A' WHEN o_orderstatus = 'O' THEN 'B' ELSE 'C' END AS town,
  CASE WHEN o_orderkey % 17 = 0 THEN ' ' WHEN o_orderkey % 19 = 0 THEN 'z_' || o_custkey WHEN o_orderstatus = 'F' THEN 'a_' || o_custkey WHEN o_orderstatus = 'O' THEN 'b_' || o_custkey ELSE 'c_' || o_custkey END AS key,
  o_custkey % 4 AS code, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'L' || o_custkey % 5 END AS lot FROM orders),
tab AS (SELECT CASE c_custkey % 3 WHEN 0 THEN 'a_' WHEN 1 THEN 'b_' ELSE 'x_' END || c_custkey // 2 AS key, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey // 2 % 4 END AS code, 'L' || c_custkey % 5 AS lot FROM customer),
els AS (SELECT 'a_' || s_suppkey AS key FROM supplier)
"""


@R.add(f"""
WITH {_KEYS}, e AS (
  SELECT r.*, CASE town WHEN 'A' THEN 'a_' WHEN 'B' THEN 'b_' END AS prefix, CASE WHEN town = 'A' AND key LIKE 'a\\_%' ESCAPE '\\' THEN 'x_' || substr(key, 3) END AS trial_key FROM records r
), k AS (
  SELECT e.*, coalesce(x.n, 0) AS n_exact, coalesce(x.n, 0) - coalesce(c.n, 0) AS n_other, coalesce(s.n, 0) AS n_else, coalesce(t.n, 0) AS n_trial, coalesce(l.n, 0) AS n_lot,
    coalesce(NOT starts_with(e.key, prefix), true) AS fault
  FROM e LEFT JOIN (SELECT key, count(*) AS n FROM tab GROUP BY 1) x ON x.key = e.key LEFT JOIN (SELECT key, code, count(*) AS n FROM tab GROUP BY 1, 2) c ON c.key = e.key AND c.code IS NOT DISTINCT FROM e.code
    LEFT JOIN (SELECT key, count(*) AS n FROM els GROUP BY 1) s ON s.key = e.key LEFT JOIN (SELECT key, count(*) AS n FROM tab GROUP BY 1) t ON t.key = e.trial_key
    LEFT JOIN (SELECT key, lot, count(*) AS n FROM tab GROUP BY 1, 2) l ON l.key = e.trial_key AND l.lot = e.lot
)
SELECT town, count(*) AS records, count(*) FILTER (n_exact = 0) AS exact_zero, count(*) FILTER (n_exact = 1) AS exact_one, count(*) FILTER (n_exact > 1) AS exact_multiple, sum(n_exact)::BIGINT AS exact_links, sum(n_other)::BIGINT AS other_code_links,
  count(*) FILTER (n_else > 0) AS shared_keys, sum(n_trial)::BIGINT AS trial_links, sum(n_lot)::BIGINT AS trial_lot_links, count(*) FILTER (fault) AS faults FROM k GROUP BY 1
""")
def conflict_evidence(t: Tables) -> DataFrame:
    """How the keys of records meet a table exactly, elsewhere, and under another prefix, by town."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    town = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").otherwise("C")
    key = F.when(o % 17 == 0, " ").when(o % 19 == 0, F.concat(F.lit("z_"), c.cast("string"))).otherwise(F.concat(F.lower(town), F.lit("_"), c.cast("string")))
    records = t.orders.select(o.alias("object_id"), town.alias("town"), key.alias("key"), (c % 4).alias("code"), F.when(o % 3 == 0, "").otherwise(F.concat(F.lit("L"), (c % 5).cast("string"))).alias("lot"))
    k, half = F.col("c_custkey"), F.expr("c_custkey div 2")
    prefix = F.when(k % 3 == 0, "a_").when(k % 3 == 1, "b_").otherwise("x_")
    table = t.customer.select(F.concat(prefix, half.cast("string")).alias("key"), F.when(k % 5 != 0, half % 4).alias("code"), F.concat(F.lit("L"), (k % 5).cast("string")).alias("lot"))
    elsewhere = t.supplier.select(F.concat(F.lit("a_"), F.col("s_suppkey").cast("string")).alias("key"))
    trials = t.spark.createDataFrame([("A", "a_", "x_"), ("B", "b_", None)], "town string, prefix string, trial_prefix string")
    return conflicts.evidence_by_town(conflicts.key_evidence(records, table, elsewhere, trials))


@R.add(f"""
WITH f AS ({PARTS_SQL}), z AS ({ZONES_SQL}),
b AS (SELECT f.id, z.id AS code, (least(f.xmax, z.xmax) - greatest(f.xmin, z.xmin)) * (least(f.ymax, z.ymax) - greatest(f.ymin, z.ymin)) AS shared, (f.xmax - f.xmin) * (f.ymax - f.ymin) AS area
  FROM f JOIN z ON f.xmin < z.xmax AND z.xmin < f.xmax AND f.ymin < z.ymax AND z.ymin < f.ymax)
SELECT id AS object_id, code, round(shared / area, 6) AS fraction, shared = area AS fully FROM b
""")
def placements(t: Tables) -> DataFrame:
    """The share of each part in each zone that it overlaps."""
    region = box_region(*[F.col(c) for c in BOX])
    features = _parts(t).select(F.col("id").alias("object_id"), F.array(region[0]).alias("region"))
    found = conflicts.placements(features, _zones(t).select(F.col("id").alias("code"), F.array(region[0]).alias("region")), 64.0)
    return found.select("object_id", "code", F.round("fraction", 6).alias("fraction"), "fully")


@R.add("""
SELECT o_custkey || '' AS key, count(*) FILTER (o_orderkey % 3 = 0) AS n_records, count(*) FILTER (o_orderkey % 3 = 1) AS n_candidates
FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 3 = 0) > 0 AND count(*) FILTER (o_orderkey % 3 = 1) > 0
""")
def candidate_rows(t: Tables) -> DataFrame:
    """Keys that link records to tabular candidates, one row a key."""
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 1, ingestion.TABULAR).otherwise(ingestion.GEOMETRY)
    records = t.orders.select(F.when(k % 11 == 0, " ").otherwise(F.col("o_custkey").cast("string")).alias("candidate_key"), F.when(k % 3 == 0, "own").otherwise("other").alias("source_id"), kind.alias("record_kind"))
    return ingestion.candidate_rows(records, "own")
