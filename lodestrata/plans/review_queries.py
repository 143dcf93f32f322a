"""Queries of review contracts: events, payloads, requests, proposals, trees, scopes, snapshots and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import json_paths
from lodestrata.functions.digest import EMPTY_FINGERPRINT
from lodestrata.operators import boxes, history, raster, validation
from lodestrata.plans.product_queries import _as_region
from lodestrata.plans.spatial_queries import PARTS_SQL, ZONES_SQL, _parts, _zones
from lodestrata.plans.tables import Registry, Tables
from lodestrata.products import ingestion, ranking

R = Registry()


@R.add("""
WITH e AS (
  SELECT o_orderkey AS k, o_orderkey % 5 = 1 AS bad_id, o_orderkey % 7 = 2 AS short_sha, o_orderpriority = '5-LOW' AS bad_priority,
    CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE 'paused' END AS status, o_orderkey % 11 = 3 AS blank_note, o_orderkey % 3 AS refs
  FROM orders
)
SELECT k AS o_orderkey, concat_ws(',', CASE WHEN bad_id THEN 'finding_id' END, CASE WHEN short_sha THEN 'expected_event' END, CASE WHEN status = 'paused' THEN 'status' END,
  CASE WHEN bad_priority THEN 'priority' END, CASE WHEN blank_note THEN 'review_text' END, CASE WHEN refs = 2 THEN 'evidence_text' END,
  CASE WHEN status = 'resolved' AND refs = 0 THEN 'resolution_without_evidence' END) AS faults
FROM e
""")
def event_rules(t: Tables) -> DataFrame:
    """Faults of review events built from orders."""
    k = F.col("o_orderkey")
    number = F.lpad((k % 10000).cast("string"), 4, "0")
    refs = F.when(k % 3 == 0, F.expr("cast(array() as array<string>)")).when(k % 3 == 1, F.array(F.lit("audit:1"))).otherwise(F.array(F.lit("audit:1"), F.lit(" \t")))
    events = t.orders.select(
        "o_orderkey", F.concat(F.lit("TL-F-"), F.when(k % 5 == 1, F.concat(number, F.lit("x"))).otherwise(number)).alias("finding_id"),
        F.when(k % 7 == 2, F.substring(F.sha2(k.cast("string"), 256), 1, 63)).otherwise(F.sha2(k.cast("string"), 256)).alias("expected_event_id"),
        F.when(F.col("o_orderstatus") == "F", "resolved").when(F.col("o_orderstatus") == "O", "open").otherwise("paused").alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "lowest").when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").otherwise("medium").alias("priority"),
        F.lit("look").alias("next_action"), F.lit("a reviewer").alias("actor"), F.when(k % 11 == 3, " \n").otherwise("seen").alias("note"), refs.alias("evidence_refs"),
    )
    return events.select("o_orderkey", F.array_join(validation.finding_event_faults(), ",").alias("faults"))


@R.add("""
SELECT event_id, user_id % 3 = 0 AS exact FROM events
""")
def payload_fields(t: Tables) -> DataFrame:
    """Whether review payloads have the five fields and no others."""
    five = [F.col("event_id").cast("string").alias("event_id"), F.lit("c").alias("correction_id"), F.lit("accepted").alias("status"), F.lit("a").alias("actor"), F.lit("n").alias("note")]
    kind = F.col("user_id") % 3
    text = F.when(kind == 0, F.to_json(F.struct(*five))).when(kind == 1, F.to_json(F.struct(*five[:4]))).otherwise(F.to_json(F.struct(*five, F.lit(1).alias("more"))))
    return t.events.select("event_id", validation.has_exact_keys(text).alias("exact"))


@R.add("""
SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 29 = 0 THEN 'source' END, CASE WHEN p_partkey % 29 = 0 OR p_partkey % 7 = 0 THEN 'source_sha256' END, CASE WHEN p_partkey % 11 = 0 THEN 'status' END,
  CASE WHEN p_partkey % 29 = 0 OR p_partkey % 5 = 1 THEN 'segments' END) AS faults FROM part
""")
def geometry_proposals(t: Tables) -> DataFrame:
    """Faults of ring proposals: another source, another status, or a moved vertex; an equal ring begun elsewhere is sound."""
    k = F.col("p_partkey")
    p = lambda x, y: F.array((k + x).cast("double"), F.lit(float(y)))
    ring = lambda *points: F.array(F.array(*[p(x, y) for x, y in points]))
    rows = t.part.select("p_partkey")
    sources = rows.filter(k % 29 != 0).select("p_partkey", F.concat(F.lit("source "), k.cast("string")).alias("text"), ring((0, 0), (0, 9), (9, 9), (0, 0)).alias("rings"))
    text = F.concat(F.lit("candidate "), k.cast("string"))
    proposals = rows.select(
        "p_partkey", F.sha2(F.concat(F.when(k % 7 == 0, "other ").otherwise("source "), k.cast("string")), 256).alias("source_sha256"), F.sha2(text, 256).alias("candidate_sha256"), text.alias("candidate_text"),
        F.when(k % 11 == 0, "accepted").otherwise("proposed_not_accepted").alias("status"), F.lit("DERIVED").alias("evidence_state"), F.sha2(F.concat_ws(":", k.cast("string"), F.sha2(text, 256)), 256).alias("correction_id"),
        F.when(k % 5 == 1, ring((9, 9), (0, 9), (0, 1), (9, 9))).otherwise(ring((9, 9), (0, 9), (0, 0), (9, 9))).alias("rings"),
    )
    return validation.proposal_faults(proposals, sources, ["p_partkey"]).select("p_partkey", F.array_join("faults", ",").alias("faults"))


@R.add("""
WITH c AS (SELECT * FROM customer WHERE c_custkey % 17 <> 0), o AS (SELECT CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderkey END AS k, o_custkey FROM orders)
SELECT * FROM (
  SELECT 'customer' AS level, 'missing_parent' AS fault, count(*) AS n FROM c WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> 3)
  UNION ALL SELECT 'orders', 'missing_key', count(*) FROM o WHERE k IS NULL
  UNION ALL SELECT 'orders', 'missing_parent', count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM c)
  UNION ALL SELECT 'lineitem', 'repeated_key', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'lineitem', 'missing_parent', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM o WHERE k IS NOT NULL)
  UNION ALL SELECT 'nation', 'row_count', 1
) WHERE n > 0
""")
def record_tree(t: Tables) -> DataFrame:
    """Faults of a tree of four levels: keys, parents and announced counts."""
    key = F.when(F.col("o_orderkey") % 19 != 0, F.col("o_orderkey"))
    nations = t.nation.filter("n_nationkey <> 3")
    levels = [
        ("nation", nations, "n_nationkey", None), ("customer", t.customer.filter("c_custkey % 17 <> 0"), "c_custkey", "c_nationkey"),
        ("orders", t.orders.select(key.alias("k"), "o_custkey"), "k", "o_custkey"), ("lineitem", t.lineitem.select("l_orderkey", F.col("l_orderkey").alias("parent")), "l_orderkey", "parent"),
    ]
    return validation.tree_faults(levels, {"nation": 25})


@R.add("""
WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 49),
a AS (SELECT l_partkey FROM p GROUP BY 1 HAVING count(*) = 1), b AS (SELECT l_suppkey FROM p GROUP BY 1 HAVING count(*) = 1)
SELECT l_partkey, l_suppkey FROM p WHERE l_partkey IN (SELECT l_partkey FROM a) AND l_suppkey IN (SELECT l_suppkey FROM b)
""")
def one_to_one_candidates(t: Tables) -> DataFrame:
    """Parts and suppliers that qualify for one another and for nobody else."""
    return validation.one_to_one(t.lineitem, "l_partkey", "l_suppkey", F.col("l_quantity") >= 49)


@R.add("""
SELECT n_nationkey, coalesce(max(CASE WHEN c_custkey % 50 = 7 THEN 1 END) = 1, false) AS is_stale FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
""")
def scoped_staleness(t: Tables) -> DataFrame:
    """Results by nation that a change of a customer makes stale, in its own nation only."""
    inputs = t.customer.select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", F.col("c_mktsegment").alias("d"))
    made = history.scope_fingerprint(inputs, ["n_nationkey"], "c_custkey", "d")
    results = t.nation.select("n_nationkey").join(made, "n_nationkey", "left").withColumn("dependencies", F.coalesce("dependencies", F.lit(EMPTY_FINGERPRINT)))
    now = inputs.withColumn("d", F.when(F.col("c_custkey") % 50 == 7, F.concat("d", F.lit("!"))).otherwise(F.col("d")))
    return history.scoped_staleness(results, now, ["n_nationkey"], "c_custkey", "d").select("n_nationkey", "is_stale")


@R.add("""
WITH l AS (SELECT o_custkey AS c, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1)
SELECT c_custkey AS scope, CASE WHEN c_custkey % 10 = 0 THEN 'unknown' WHEN c_custkey % 4 = 1 THEN 'superseded' WHEN s IS DISTINCT FROM 'F' THEN 'unaccepted' ELSE 'current' END AS currency
FROM customer LEFT JOIN l ON c = c_custkey
""")
def bound_coverage(t: Tables) -> DataFrame:
    """Coverage results that rest on a snapshot and on the last review event of their scope."""
    k = F.col("c_custkey")
    coverage = t.customer.select(k.alias("scope"), F.lit("s1").alias("snapshot_id"))
    snapshots = t.customer.filter(k % 10 != 0).select(k.alias("scope"), F.when(k % 4 == 1, "s2").otherwise("s1").alias("snapshot_id"))
    events = t.orders.select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("event_seq"), F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("withdrawn").alias("status"))
    return history.bound_coverage(coverage, snapshots, events).select("scope", "currency")


@R.add(f"""
WITH g AS ({ZONES_SQL}), p AS ({PARTS_SQL}), cells AS (SELECT id, xmin + i % 60 AS x, ymin + i // 60 AS y FROM g, range(0, 2400) r(i)),
near AS (SELECT g.id AS g_id, p.* FROM g JOIN p ON p.xmin < g.xmax AND g.xmin < p.xmax AND p.ymin < g.ymax AND g.ymin < p.ymax),
hit AS (SELECT c.id, c.x, c.y, bool_or(n.id % 4 = 0) AS old FROM cells c JOIN near n ON n.g_id = c.id AND n.xmin <= c.x AND n.xmax >= c.x + 1 AND n.ymin <= c.y AND n.ymax >= c.y + 1 GROUP BY ALL)
SELECT g.id AS gap_id, coalesce(n, 0)::DOUBLE AS area FROM g LEFT JOIN (SELECT id, count(*) AS n FROM hit WHERE NOT old GROUP BY 1) h ON h.id = g.id
""")
def scenario_areas(t: Tables) -> DataFrame:
    """Area that proposals add to each zone beyond what accepted parts cover."""
    gaps = _as_region(_zones(t)).select(F.col("id").alias("gap_id"), "region")
    parts = _as_region(_parts(t)).select(F.col("id").alias("cand_id"), "region")
    found = ranking.scenario_areas(gaps, parts.filter("cand_id % 4 <> 0"), parts.filter("cand_id % 4 = 0"), 64.0)
    return found.select("gap_id", F.round("area", 6).alias("area"))


@R.add("""
SELECT event_id, '{"a":{"k":' || k || '},"b":[' || event_id || ',"x/y"],"k":' || (event_id % 100) || '}' AS document, k::VARCHAR AS at_key, 'x/y' AS at_index, NULL AS nowhere FROM (SELECT event_id, (props->>'k')::BIGINT AS k FROM events)
""")
def json_documents(t: Tables) -> DataFrame:
    """Values set by path in JSON texts, and read by pointer."""
    text = F.concat(F.lit('{"a": '), F.col("props"), F.lit(', "k": 0, "b": ['), F.col("event_id").cast("string"), F.lit(', "x/y"]}'))
    done = t.events.select("event_id", json_paths.set_path(text, ["k"], (F.col("event_id") % 100).cast("string")).alias("document"))
    return done.select("event_id", "document", json_paths.pointer(F.col("document"), "/a/k").alias("at_key"), json_paths.pointer(F.col("document"), "/b/1").alias("at_index"), json_paths.pointer(F.col("document"), "/b/k").alias("nowhere"))


AFFINE = (2.0, 0.0, 100.0, 0.0, -2.0, 900.0)


@R.add(f"""
WITH p AS ({PARTS_SQL}), w AS (
  SELECT id, greatest(0, least(200, floor((xmin - 100) / 2)))::BIGINT AS c0, greatest(0, least(200, ceil((xmax - 100) / 2)))::BIGINT AS c1, greatest(0, least(300, floor((900 - ymax) / 2)))::BIGINT AS r0, greatest(0, least(300, ceil((900 - ymin) / 2)))::BIGINT AS r1 FROM p
)
SELECT id, c0 < c1 AND r0 < r1 AS met, CASE WHEN c0 < c1 AND r0 < r1 THEN (c1 - c0) * (r1 - r0) ELSE 0 END AS n_cells, CASE WHEN c0 < c1 AND r0 < r1 THEN (100 + 2 * c0)::DOUBLE END AS west, CASE WHEN c0 < c1 AND r0 < r1 THEN (900 - 2 * r0)::DOUBLE END AS north FROM w
""")
def raster_windows(t: Tables) -> DataFrame:
    """Cells of a north-up raster that each part's box meets, and the map position of the first."""
    box = {c: F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")}
    w = _parts(t).select("id", raster.window_of(box, F.lit(200), F.lit(300), AFFINE).alias("w"))
    cells = F.coalesce((F.col("w.row1") - F.col("w.row0")) * (F.col("w.col1") - F.col("w.col0")), F.lit(0))
    corner = raster.to_map(F.col("w.col0"), F.col("w.row0"), AFFINE)
    return w.select("id", F.col("w").isNotNull().alias("met"), cells.alias("n_cells"), corner["x"].alias("west"), corner["y"].alias("north"))


@R.add("""
WITH r AS (
  SELECT 'parcels' AS source_id, c_custkey AS object_id, CASE WHEN c_custkey % 6 <> 0 THEN 'g' END AS gid, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE (c_nationkey + CASE WHEN c_custkey % 13 = 0 THEN 100 ELSE 0 END)::VARCHAR END AS code,
    CASE WHEN c_custkey % 4 = 0 THEN 'elsewhere' ELSE (SELECT n_name FROM nation WHERE n_nationkey = c_nationkey) END AS name, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 40)::VARCHAR END AS k,
    CASE c_custkey % 3 WHEN 0 THEN '2011' WHEN 1 THEN '' ELSE '13/1/2020' END AS d, true AS geo FROM customer
  UNION ALL
  SELECT 'table', s_suppkey, 'g', s_nationkey::VARCHAR, NULL, (s_suppkey % 60)::VARCHAR, '2011', false FROM supplier
), n AS (
  SELECT *, count(*) OVER (PARTITION BY source_id, k) AS reps, (SELECT count(*) FROM r x WHERE NOT x.geo AND x.k = r.k) AS m, (SELECT count(*) FROM r x WHERE NOT x.geo AND x.k = r.k AND x.code = r.code) AS agree, (SELECT lower(n_name) FROM nation WHERE n_nationkey::VARCHAR = r.code) AS known FROM r
)
SELECT source_id, object_id, sha256('b1:' || source_id || ':' || object_id) AS record_id, CASE WHEN geo THEN m END AS candidate_count, CASE WHEN NOT geo THEN 'field_semantics_unverified' WHEN d = '' THEN 'missing' WHEN d <> '2011' THEN 'malformed_or_uninterpreted' END AS reason,
  concat_ws(',', CASE WHEN trim(code) = '' THEN 'blank_jurisdiction' END, CASE WHEN trim(code) <> '' AND known IS NULL THEN 'unrecognized_jurisdiction' END, CASE WHEN geo AND known <> lower(name) THEN 'code_name_conflict' END,
    CASE WHEN k IS NULL THEN 'missing_candidate_key' END, CASE WHEN k IS NOT NULL AND reps > 1 THEN 'repeated_candidate_key_in_batch' END, CASE WHEN gid IS NULL THEN 'missing_global_id' END, CASE WHEN geo AND d = '' THEN 'missing_source_date' END,
    CASE WHEN geo AND d = '13/1/2020' THEN 'uninterpreted_source_date' END, CASE WHEN geo AND code IN ('1', '2', '3') THEN 'source_overlap_unresolved' END, CASE WHEN NOT geo THEN 'assessment_date_semantics' END,
    CASE WHEN geo AND m = 0 THEN 'assessment_no_match' END, CASE WHEN geo AND m > 1 THEN 'assessment_multiple_candidates' END, CASE WHEN geo AND m > CASE WHEN trim(code) = '' THEN 0 ELSE agree END THEN 'assessment_geocode_disagreement' END) AS flags
FROM n
""")
def ingestion_batch(t: Tables) -> DataFrame:
    """A batch of parcels and tabular records with identities, date states, candidates and quality flags."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    names = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    code = F.when(c % 9 == 0, " ").otherwise((F.col("c_nationkey") + F.when(c % 13 == 0, 100).otherwise(0)).cast("string"))
    parcels = t.customer.join(names, "c_nationkey", "left").select(
        F.lit("parcels").alias("source_id"), c.alias("object_id"), F.when(c % 6 != 0, "g").alias("global_id"), code.alias("code"), F.when(c % 4 == 0, "elsewhere").otherwise(F.col("n_name")).alias("name"),
        F.when(c % 7 != 0, (c % 40).cast("string")).alias("candidate_key"), F.lit(ingestion.GEOMETRY).alias("record_kind"), F.when(c % 3 == 0, "2011").when(c % 3 == 1, "").otherwise("13/1/2020").alias("raw_date"),
    )
    table = t.supplier.select(F.lit("table").alias("source_id"), s.alias("object_id"), F.lit("g").alias("global_id"), F.col("s_nationkey").cast("string").alias("code"), F.lit(None).cast("string").alias("name"), (s % 60).cast("string").alias("candidate_key"), F.lit(ingestion.TABULAR).alias("record_kind"), F.lit("2011").alias("raw_date"))
    reference = t.nation.select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("common_name"))
    done = ingestion.classified(parcels.unionByName(table), reference, reference.filter("code in ('1', '2', '3')").select("code"), "b1", "parcels")
    return done.select("source_id", "object_id", "record_id", "candidate_count", F.col("parsed_date.reason").alias("reason"), F.array_join("quality_flags", ",").alias("flags"))


@R.add(f"""
WITH p AS (SELECT *, 'source-' || id % 3 AS source_id, id % 13 = 0 AS held FROM ({PARTS_SQL})),
r AS (SELECT *, CASE WHEN held THEN 'held' WHEN xmin > 500 OR xmax < 100 OR ymin > 500 OR ymax < 100 THEN 'outside' WHEN xmin < 500 AND xmax > 100 AND ymin < 500 AND ymax > 100 THEN 'interior' ELSE 'touch' END AS relation FROM p)
SELECT source_id, count(*) AS n_rows, count(*) FILTER (relation = 'interior') AS n_interior, count(*) FILTER (relation = 'touch') AS n_touch, count(*) FILTER (relation = 'outside') AS n_outside, count(*) FILTER (held) AS n_held,
  sha256(string_agg(id || ':' || sha256('part ' || id) || chr(10), '' ORDER BY id)) AS fingerprint FROM r GROUP BY 1
""")
def area_inventory(t: Tables) -> DataFrame:
    """The manifest of each source within a study box: relations, holds and fingerprints."""
    held = F.col("id") % 13 == 0
    box = {c: F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")}
    relation = boxes.scope_relation(box, {"xmin": 100.0, "ymin": 100.0, "xmax": 500.0, "ymax": 500.0}, held)
    rows = _parts(t).select(F.concat(F.lit("source-"), (F.col("id") % 3).cast("string")).alias("source_id"), F.col("id").alias("object_id"), F.sha2(F.concat(F.lit("part "), F.col("id").cast("string")), 256).alias("digest"), F.when(held, "ring held").alias("hold"), relation.alias("scope_relation"))
    return ingestion.inventory(rows)


@R.add("""
WITH b AS (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 97 <> 5 GROUP BY 1), a AS (SELECT o_custkey AS k, count(*) AS n, round(sum(CASE WHEN o_orderkey % 101 = 9 THEN 0 ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1)
SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change, b.n AS n_before, a.n AS n_after, b.total AS total_before, a.total AS total_after
FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n OR a.total IS DISTINCT FROM b.total
""")
def recomputed_results(t: Tables) -> DataFrame:
    """Customers whose totals a recomputation changed, with both values."""
    sums = lambda df, price: df.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum(price), 2).alias("total"))
    before = sums(t.orders.filter("o_orderkey % 97 <> 5"), F.col("o_totalprice"))
    after = sums(t.orders, F.when(F.col("o_orderkey") % 101 == 9, 0).otherwise(F.col("o_totalprice")))
    return ingestion.recomputed(before, after, ["o_custkey"], ["n", "total"])
