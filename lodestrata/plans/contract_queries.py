"""Queries of contracts over JSON: both engines build the same texts, and the SQL states the rules over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import variants
from lodestrata.operators import corrections, validation
from lodestrata.plans.tables import Registry, Tables

R = Registry()
SOILS = validation.SOIL_BATCH

# Requests of customers, with faults that meet one another. Numbers are chosen by remainders, so every type occurs.
_REQUESTS = f"""
SELECT c_custkey AS id, '{{"audit":"' || CASE WHEN c_custkey % 3 = 1 THEN upper(sha256('a' || c_custkey)) ELSE sha256('a' || c_custkey) END
  || '","snapshot":' || CASE WHEN c_custkey % 13 = 5 THEN '7' ELSE '"' || sha256('s' || c_custkey) || '"' END
  || CASE c_custkey % 4 WHEN 0 THEN ',"purchase_candidate":true' WHEN 1 THEN ',"purchase_candidate":"true"' WHEN 2 THEN '' ELSE ',"purchase_candidate":false' END
  || CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ',"soils":{{"batch":"{SOILS}","snapshot":"' || sha256('x' || c_custkey) || '"}}' WHEN 2 THEN ',"soils":{{"batch":"other","snapshot":"' || sha256('x' || c_custkey) || '"}}'
    WHEN 3 THEN ',"soils":{{"batch":"{SOILS}","snapshot":"' || sha256('x' || c_custkey) || '","more":1}}' ELSE ',"soils":{{"batch":"{SOILS}","snapshot":"short"}}' END
  || CASE WHEN c_custkey % 7 = 5 THEN ',"source_id":"ut-parcels","object_id":' || c_custkey % 40 - 10 WHEN c_custkey % 7 = 6 THEN ',"source_id":"organized-parcels","object_id":"' || c_custkey || '"'
    ELSE ',"geometry":{{"type":"Polygon","coordinates":[[[' || x || ',45],' || CASE WHEN c_custkey % 7 = 1 THEN '[' || x + 1 || ',46],[' || x || ',46],' WHEN c_custkey % 7 = 2 THEN '[' || x || ',46,3],[' || x + 1 || ',46],' ELSE '[' || x || ',46],[' || x + 1 || ',46],' END
      || '[' || x + 1 || ',45],[' || CASE WHEN c_custkey % 7 = 3 THEN x + 2 ELSE x END || ',45]]]}}' END
  || CASE WHEN c_custkey % 11 = 0 AND c_custkey % 7 < 5 THEN ',"object_id":3' ELSE '' END || '}}' AS request
FROM (SELECT *, c_custkey % 380 - 190 AS x FROM customer)
"""


@R.add(rf"""
WITH r AS ({_REQUESTS}), j AS (SELECT id, request, request::JSON AS j FROM r),
p AS (SELECT id, (j->'$.geometry.coordinates'->0)::DOUBLE[][] AS ring FROM j),
g AS (
  SELECT id, ring, len(list_filter(ring, lambda q: len(q) <> 2)) = 0 AS flat, ring[1] = ring[len(ring)] AS closed,
    len(list_filter(ring, lambda q: abs(q[1]) > 180 OR abs(q[2]) > 90)) = 0 AS degrees
  FROM p WHERE ring IS NOT NULL
), e AS (
  SELECT g.id, a.i AS i, b.i AS j, ring[a.i] AS p, ring[a.i + 1] AS q, ring[b.i] AS s, ring[b.i + 1] AS t, len(ring) AS n FROM g, range(1, 9) a(i), range(1, 9) b(i) WHERE a.i + 1 < b.i AND b.i < len(ring) AND NOT (a.i = 1 AND b.i = len(ring) - 1)
), x AS (
  SELECT id, bool_or(sign((q[1] - p[1]) * (s[2] - p[2]) - (q[2] - p[2]) * (s[1] - p[1])) <> sign((q[1] - p[1]) * (t[2] - p[2]) - (q[2] - p[2]) * (t[1] - p[1]))
    AND sign((t[1] - s[1]) * (p[2] - s[2]) - (t[2] - s[2]) * (p[1] - s[1])) <> sign((t[1] - s[1]) * (q[2] - s[2]) - (t[2] - s[2]) * (q[1] - s[1]))) AS crosses FROM e GROUP BY id
)
SELECT j.id AS c_custkey, concat_ws(',',
  CASE WHEN NOT (json_type(j, '$.audit') = 'VARCHAR' AND regexp_full_match(j->>'$.audit', '[0-9a-f]{{64}}')) THEN 'audit' END,
  CASE WHEN NOT (json_type(j, '$.snapshot') = 'VARCHAR' AND regexp_full_match(j->>'$.snapshot', '[0-9a-f]{{64}}')) THEN 'snapshot' END,
  CASE WHEN json_type(j, '$.soils') IS NOT NULL AND NOT (list_sort(json_keys(j, '$.soils')) = ['batch', 'snapshot'] AND j->>'$.soils.batch' = '{SOILS}' AND regexp_full_match(j->>'$.soils.snapshot', '[0-9a-f]{{64}}')) THEN 'soils' END,
  CASE WHEN json_type(j, '$.purchase_candidate') IS DISTINCT FROM 'BOOLEAN' THEN 'purchase_candidate' END,
  CASE WHEN json_type(j, '$.geometry') IS NOT NULL AND (json_type(j, '$.source_id') IS NOT NULL OR json_type(j, '$.object_id') IS NOT NULL) THEN 'one_selection' END,
  CASE WHEN ring IS NOT NULL AND NOT (flat AND closed AND NOT crosses) THEN 'area' END,
  CASE WHEN ring IS NOT NULL AND NOT degrees THEN 'lon_lat' END,
  CASE WHEN ring IS NULL AND NOT (j->>'$.source_id' IN ('ut-parcels', 'organized-parcels') AND json_type(j, '$.object_id') IN ('BIGINT', 'UBIGINT') AND (j->>'$.object_id')::BIGINT >= 0) THEN 'parcel' END) AS faults
FROM j LEFT JOIN g ON g.id = j.id LEFT JOIN x ON x.id = j.id
""")
def request_validation(t: Tables) -> DataFrame:
    """Faults of qualification requests: types, digests, soils, and crossing, open, three-dimensional or displaced rings."""
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    sha = lambda letter: F.sha2(text(letter, k), 256)
    x, kind = k % 380 - 190, k % 7
    pick = lambda n, *values: F.coalesce(*[F.when(k % n == r, v if not isinstance(v, str) else F.lit(v)) for r, v in enumerate(values)])
    soils = lambda batch, snapshot, more="": text(f',"soils":{{"batch":"{batch}","snapshot":"', snapshot, f'"{more}}}')
    corner = F.when(kind == 1, text("[", x + 1, ",46],[", x, ",46],")).when(kind == 2, text("[", x, ",46,3],[", x + 1, ",46],")).otherwise(text("[", x, ",46],[", x + 1, ",46],"))
    area = text(',"geometry":{"type":"Polygon","coordinates":[[[', x, ",45],", corner, "[", x + 1, ",45],[", F.when(kind == 3, x + 2).otherwise(x), ",45]]]}")
    request = text(
        '{"audit":"', F.when(k % 3 == 1, F.upper(sha("a"))).otherwise(sha("a")), '","snapshot":', F.when(k % 13 == 5, "7").otherwise(text('"', sha("s"), '"')),
        pick(4, ',"purchase_candidate":true', ',"purchase_candidate":"true"', "", ',"purchase_candidate":false'),
        pick(5, "", soils(SOILS, sha("x")), soils("other", sha("x")), soils(SOILS, sha("x"), ',"more":1'), soils(SOILS, F.lit("short"))),
        F.when(kind == 5, text(',"source_id":"ut-parcels","object_id":', k % 40 - 10)).when(kind == 6, text(',"source_id":"organized-parcels","object_id":"', k, '"')).otherwise(area),
        F.when((k % 11 == 0) & (kind < 5), ',"object_id":3').otherwise(""), "}",
    )
    rows = t.customer.select("c_custkey", request.alias("r")).withColumn("v", variants.parsed(F.col("r")))
    return rows.select("c_custkey", F.array_join(validation.request_faults(F.col("r"), F.col("v")), ",").alias("faults"))


# Features and proposals of orders. A proposal may be missing, doubled, of another text, or change what it may not.
_CORRECTIONS = """
SELECT k AS object_id, f AS feature_text, CASE WHEN k % 5 <> 0 THEN p END AS proposal, CASE WHEN k % 6 = 0 THEN ['hold'] ELSE [] END AS holds,
  CASE WHEN k % 5 <> 0 THEN CASE WHEN k % 17 = 3 THEN 2 ELSE 1 END ELSE 0 END AS n_audit, CASE WHEN k % 12 = 0 THEN ['hold'] WHEN k % 10 = 0 THEN [] END AS audit_holds, k % 19 = 4 AS other
FROM (
  SELECT *, '{"changes":' || CASE k % 8 WHEN 0 THEN '{}' WHEN 1 THEN '{"GEOCODE":{"from":"' || g || '","to":"9"}}' WHEN 2 THEN '{"GEOCODE":{"from":"other","to":"9"}}' WHEN 3 THEN '{"STATE_ID":{"from":' || k || ',"to":"9"}}'
      WHEN 4 THEN '{"STATE_ID":{"from":"' || k || '","to":"9"}}' WHEN 5 THEN '{"OWNER":{"from":null,"to":"9"}}' WHEN 6 THEN '{"GEOCODE":{"from":"' || g || '","to":9}}' ELSE '[]' END
    || ',"evidence_state":"' || CASE WHEN k % 23 = 1 THEN 'DERIVED' ELSE 'INFERRED' END || '","global_id":"G' || k || '","holds":' || CASE WHEN k % 6 = 0 THEN '["hold"]' ELSE '[]' END
    || ',"source_feature_sha256":"' || sha256(CASE WHEN k % 29 = 2 THEN 'x' ELSE '' END || f) || '","source_id":"organized-parcels","source_snapshot_sha256":"snap","status":"' || CASE WHEN k % 31 = 7 THEN 'accepted' ELSE 'proposed' END || '"}' AS p
  FROM (SELECT *, '{"properties":{"GEOCODE":"' || g || '","GlobalID":"G' || k || '","OBJECTID":' || CASE WHEN k % 37 = 5 THEN k + 1 ELSE k END || ',"STATE_ID":' || k || '}}' AS f
    FROM (SELECT o_orderkey AS k, o_custkey AS g FROM orders))
)
"""


@R.add(f"""
WITH r AS ({_CORRECTIONS}), j AS (SELECT *, feature_text::JSON AS f, proposal::JSON AS p FROM r),
c AS (SELECT object_id, f, p, unnest(json_keys(p, '$.changes')) AS name FROM j WHERE json_type(p, '$.changes') = 'OBJECT'),
w AS (
  SELECT object_id, bool_or(NOT (name IN ('GEOCODE', 'STATE_ID') AND json_extract(p, '$.changes.' || name || '.from') IS NOT DISTINCT FROM json_extract(f, '$.properties.' || name) AND json_type(p, '$.changes.' || name || '.to') = 'VARCHAR')) AS wrong, count(*) AS n
  FROM c GROUP BY 1
)
SELECT j.object_id, concat_ws(',',
  CASE WHEN (f->>'$.properties.OBJECTID')::BIGINT <> j.object_id THEN 'identity' END, CASE WHEN n_audit > 1 THEN 'ambiguous' END,
  CASE WHEN other AND n_audit > 0 THEN 'proposal' END, CASE WHEN n_audit = 0 AND audit_holds IS NULL THEN 'scope' END,
  CASE WHEN holds <> coalesce(audit_holds, []) THEN 'holds' END,
  CASE WHEN p IS NOT NULL AND NOT (p->>'$.status' = 'proposed' AND p->>'$.evidence_state' = 'INFERRED' AND p->>'$.source_id' = 'organized-parcels' AND p->>'$.source_snapshot_sha256' = 'snap'
    AND p->>'$.source_feature_sha256' = sha256(feature_text) AND (p->'$.holds')::VARCHAR[] = holds AND p->>'$.global_id' = f->>'$.properties.GlobalID') THEN 'stale' END,
  CASE WHEN p IS NOT NULL AND coalesce(n, 0) = 0 THEN 'changes' END, CASE WHEN p IS NOT NULL AND wrong THEN 'change' END) AS faults
FROM j LEFT JOIN w ON w.object_id = j.object_id
""")
def attribute_proposals(t: Tables) -> DataFrame:
    """Faults of attribute corrections against their features and the reviewed audit."""
    k, g = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    feature = text('{"properties":{"GEOCODE":"', g, '","GlobalID":"G', k, '","OBJECTID":', F.when(k % 37 == 5, k + 1).otherwise(k), ',"STATE_ID":', k, "}}")
    change = F.coalesce(*[F.when(k % 8 == r, v) for r, v in enumerate((
        text("{}"), text('{"GEOCODE":{"from":"', g, '","to":"9"}}'), text('{"GEOCODE":{"from":"other","to":"9"}}'), text('{"STATE_ID":{"from":', k, ',"to":"9"}}'),
        text('{"STATE_ID":{"from":"', k, '","to":"9"}}'), text('{"OWNER":{"from":null,"to":"9"}}'), text('{"GEOCODE":{"from":"', g, '","to":9}}'), text("[]"),
    ))])
    hold = F.when(k % 6 == 0, F.array(F.lit("hold"))).otherwise(F.expr("cast(array() as array<string>)"))
    proposal = text(
        '{"changes":', change, ',"evidence_state":"', F.when(k % 23 == 1, "DERIVED").otherwise("INFERRED"), '","global_id":"G', k, '","holds":', F.when(k % 6 == 0, '["hold"]').otherwise("[]"),
        ',"source_feature_sha256":"', F.sha2(F.concat(F.when(k % 29 == 2, "x").otherwise(""), F.col("f")), 256), '","source_id":"organized-parcels","source_snapshot_sha256":"snap","status":"', F.when(k % 31 == 7, "accepted").otherwise("proposed"), '"}',
    )
    rows = t.orders.select(k, g, feature.alias("f")).select(k.alias("object_id"), F.lit("snap").alias("source_snapshot"), F.col("f").alias("feature_text"), F.when(k % 5 != 0, proposal).alias("proposal"), hold.alias("holds"))
    o = F.col("object_id")
    own = rows.filter("proposal is not null").select("object_id", F.when(o % 19 == 4, F.regexp_replace("proposal", '"snap"', '"SNAP"')).otherwise(F.col("proposal")).alias("proposal"))
    audit = own.unionByName(own.filter(o % 17 == 3))
    exceptions = rows.filter((o % 12 == 0) | (o % 10 == 0)).select("object_id", F.when(o % 12 == 0, F.array(F.lit("hold"))).otherwise(F.expr("cast(array() as array<string>)")).alias("holds"))
    return corrections.attribute_proposal_faults(rows, audit, exceptions).select("object_id", F.array_join("faults", ",").alias("faults"))


@R.add("""
WITH o AS (SELECT s_suppkey AS id, s_name AS raw, 'shape ' || s_suppkey AS shape, CASE WHEN s_suppkey % 7 = 0 THEN 'invalid' ELSE 'valid' END AS state FROM supplier WHERE s_suppkey % 23 <> 9),
a AS (SELECT s_suppkey AS id, 'e' || s_suppkey AS event, 'accepted ' || s_suppkey AS shape, 'valid' AS state FROM supplier WHERE s_suppkey % 7 = 0),
z AS (
  SELECT s.s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 THEN s_name || '!' ELSE s_name END AS raw, CASE WHEN a.id IS NOT NULL AND s_suppkey % 5 <> 0 THEN a.shape ELSE 'shape ' || s_suppkey END AS shape,
    CASE WHEN s_suppkey % 13 = 0 THEN 'invalid' ELSE 'valid' END AS state, CASE WHEN s_suppkey % 3 <> 0 THEN a.event END AS event
  FROM supplier s LEFT JOIN a ON a.id = s_suppkey, range(0, 2) t(i) WHERE s_suppkey % 29 <> 4 AND (t.i = 0 OR s_suppkey % 31 = 6)
), m AS (
  SELECT z.*, o.raw AS o_raw, coalesce(a.shape, o.shape) AS e_shape, coalesce(a.state, o.state) AS e_state, a.event AS e_event FROM z JOIN o ON o.id = z.id LEFT JOIN a ON a.id = z.id
)
SELECT kind, id, fault, count(*) AS n FROM (
  SELECT 'zone' AS kind, id, 'added' AS fault FROM (SELECT DISTINCT id FROM z) WHERE id NOT IN (SELECT id FROM o)
  UNION ALL SELECT 'zone', id, 'removed' FROM o WHERE id NOT IN (SELECT id FROM z)
  UNION ALL SELECT 'zone', id, 'repeated' FROM z WHERE id IN (SELECT id FROM o) GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'zone', id, 'source' FROM m WHERE raw <> o_raw
  UNION ALL SELECT 'zone', id, 'acceptance' FROM m WHERE event IS DISTINCT FROM e_event
  UNION ALL SELECT 'zone', id, 'shape' FROM m WHERE shape <> e_shape
  UNION ALL SELECT 'zone', id, 'state' FROM m WHERE state <> e_state
  UNION ALL SELECT 'subject', c_custkey, 'added' FROM customer WHERE c_custkey % 41 = 3 AND c_custkey % 43 <> 1
  UNION ALL SELECT 'subject', c_custkey, 'removed' FROM customer WHERE c_custkey % 43 = 1 AND c_custkey % 41 <> 3
  UNION ALL SELECT 'subject', c_custkey, 'source' FROM customer WHERE c_custkey % 41 <> 3 AND c_custkey % 43 <> 1 AND c_custkey % 47 = 2
) GROUP BY ALL
""")
def screening_inputs(t: Tables) -> DataFrame:
    """Faults of screening inputs: zones and subjects added, removed, repeated or changed, and shapes without their acceptance."""
    k = F.col("s_suppkey")
    text = lambda word: F.concat(F.lit(word), k.cast("string"))
    originals = t.supplier.filter(k % 23 != 9).select(k.alias("object_id"), F.col("s_name").alias("raw_text"), text("shape ").alias("shape_text"), F.when(k % 7 == 0, "invalid").otherwise("valid").alias("state"))
    acceptances = t.supplier.filter(k % 7 == 0).select(k.alias("object_id"), text("e").alias("event_id"), text("accepted ").alias("shape_text"), F.lit("valid").alias("state"))
    accepted = k % 7 == 0
    zones = t.supplier.filter(k % 29 != 4).select(
        k.alias("object_id"), F.when(k % 11 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")).alias("raw_text"),
        F.when(accepted & (k % 5 != 0), text("accepted ")).otherwise(text("shape ")).alias("shape_text"), F.when(k % 13 == 0, "invalid").otherwise("valid").alias("state"),
        F.when(accepted & (k % 3 != 0), text("e")).alias("event_id"),
    )
    zones = zones.unionByName(zones.filter("object_id % 31 = 6"))
    c = F.col("c_custkey")
    name = F.col("c_name")
    subjects = t.customer.filter(c % 43 != 1).select(c.alias("subject_id"), F.when(c % 47 == 2, F.concat(name, F.lit("!"))).otherwise(name).alias("raw_text"))
    previous = t.customer.filter(c % 41 != 3).select(c.alias("subject_id"), F.sha2("c_name", 256).alias("raw_sha256"))
    found = corrections.screening_faults(zones, originals, acceptances, subjects, previous)
    return found.groupBy("kind", "id", "fault").agg(F.count("*").alias("n"))


_SOILS = """
SELECT l_orderkey * 10 + l_linenumber AS id, '{"kind":"' || kind || '","source_key":"' || CASE WHEN k % 11 = 3 THEN 'x' ELSE '' END || k || '","raw":{"' || own || '":"' || k || '"'
  || CASE WHEN up <> '' AND k % 7 <> 2 THEN ',"' || up || '":"' || l_suppkey || '"' ELSE '' END || '},"provenance":{"response_sha256":' || CASE WHEN k % 13 = 4 THEN '5' ELSE '"' || sha256(k::VARCHAR) || '"' END
  || ',"row_ordinal":' || k % 50 - 1 || '}' || CASE WHEN kind = 'mupolygon' THEN ',"srid":' || CASE WHEN k % 17 = 1 THEN '3857' ELSE '4326' END || ',"scope_relation":"' || CASE k % 5 WHEN 0 THEN 'held' WHEN 1 THEN 'interior' WHEN 2 THEN 'touch' WHEN 3 THEN 'outside' ELSE 'else' END || '"'
    || CASE WHEN k % 3 = 0 THEN ',"hold":"odd"' WHEN k % 19 = 1 THEN ',"hold":""' ELSE ',"hold":null' END || CASE WHEN k % 4 <> 0 THEN ',"geometry_wkb":"00"' ELSE '' END ELSE '' END || '}' AS input_text
FROM (
  SELECT *, l_orderkey * 10 + l_linenumber AS k, CASE l_linenumber WHEN 1 THEN 'legend' WHEN 2 THEN 'mapunit' WHEN 3 THEN 'component' WHEN 4 THEN 'chorizon' WHEN 5 THEN 'mupolygon' ELSE 'other' END AS kind,
    CASE l_linenumber WHEN 1 THEN 'lkey' WHEN 2 THEN 'mukey' WHEN 3 THEN 'cokey' WHEN 4 THEN 'chkey' WHEN 5 THEN 'mupolygonkey' ELSE 'key' END AS own,
    CASE l_linenumber WHEN 2 THEN 'lkey' WHEN 3 THEN 'mukey' WHEN 4 THEN 'cokey' WHEN 5 THEN 'mukey' ELSE '' END AS up
  FROM lineitem
)
"""


@R.add(f"""
WITH r AS ({_SOILS}), j AS (SELECT DISTINCT id, input_text, input_text::JSON AS j FROM r), d AS (
  SELECT *, j->>'$.kind' AS kind, j->>'$.source_key' AS key, j->>'$.scope_relation' AS scope, j->>'$.hold' AS hold, j->>'$.geometry_wkb' AS wkb,
    j->>('$.raw.' || CASE j->>'$.kind' WHEN 'legend' THEN 'lkey' WHEN 'mapunit' THEN 'mukey' WHEN 'component' THEN 'cokey' WHEN 'chorizon' THEN 'chkey' WHEN 'mupolygon' THEN 'mupolygonkey' ELSE 'none' END) AS own,
    CASE j->>'$.kind' WHEN 'mapunit' THEN 'legend' WHEN 'component' THEN 'mapunit' WHEN 'chorizon' THEN 'component' WHEN 'mupolygon' THEN 'mapunit' END AS parent_kind,
    CASE j->>'$.kind' WHEN 'mapunit' THEN j->>'$.raw.lkey' WHEN 'component' THEN j->>'$.raw.mukey' WHEN 'chorizon' THEN j->>'$.raw.cokey' WHEN 'mupolygon' THEN j->>'$.raw.mukey' END AS parent_key
  FROM j
)
SELECT id, kind, parent_kind, parent_key, concat_ws(',',
  CASE WHEN kind NOT IN ('legend', 'mapunit', 'component', 'chorizon', 'mupolygon') THEN 'kind' END, CASE WHEN own IS NULL OR own <> key THEN 'identity' END,
  CASE WHEN parent_kind IS NOT NULL AND parent_key IS NULL THEN 'parent' END,
  CASE WHEN json_type(j, '$.provenance.response_sha256') <> 'VARCHAR' OR (j->>'$.provenance.row_ordinal')::INT < 0 THEN 'provenance' END,
  CASE WHEN kind = 'mupolygon' AND j->>'$.srid' <> '4326' THEN 'crs' END, CASE WHEN kind = 'mupolygon' AND scope NOT IN ('interior', 'touch', 'outside', 'held') THEN 'scope' END,
  CASE WHEN kind = 'mupolygon' AND hold IS NOT NULL AND NOT (hold <> '' AND scope = 'held' AND wkb IS NULL) THEN 'hold' END,
  CASE WHEN kind = 'mupolygon' AND hold IS NULL AND NOT (scope <> 'held' AND wkb IS NOT NULL) THEN 'geometry' END) AS faults
FROM d
""")
def soil_rows(t: Tables) -> DataFrame:
    """Soil rows of five kinds decoded from JSON: parents by kind, and what is inconsistent in each."""
    line, k = F.col("l_linenumber"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    by_line = lambda *names: F.coalesce(*[F.when(line == n, v) for n, v in enumerate(names[:-1], 1)], F.lit(names[-1]))
    kind, own, up = by_line(*corrections.KINDS, "other"), by_line("lkey", "mukey", "cokey", "chkey", "mupolygonkey", "key"), by_line("", "lkey", "mukey", "cokey", "mukey", "")
    scope = F.element_at(F.array(*map(F.lit, ("held", "interior", "touch", "outside", "else"))), (k % 5 + 1).cast("int"))
    polygon = text(
        ',"srid":', F.when(k % 17 == 1, "3857").otherwise("4326"), ',"scope_relation":"', scope, '"',
        F.when(k % 3 == 0, ',"hold":"odd"').when(k % 19 == 1, ',"hold":""').otherwise(',"hold":null'), F.when(k % 4 != 0, ',"geometry_wkb":"00"').otherwise(""),
    )
    row = text(
        '{"kind":"', kind, '","source_key":"', F.when(k % 11 == 3, "x").otherwise(""), k, '","raw":{"', own, '":"', k, '"', F.when((up != "") & (k % 7 != 2), text(',"', up, '":"', F.col("l_suppkey"), '"')).otherwise(""),
        '},"provenance":{"response_sha256":', F.when(k % 13 == 4, "5").otherwise(text('"', F.sha2(k.cast("string"), 256), '"')), ',"row_ordinal":', k % 50 - 1, "}", F.when(line == 5, polygon).otherwise(""), "}",
    )
    rows = t.lineitem.select(k.alias("id"), row.alias("input_text")).distinct()
    return corrections.soil_rows(rows).select("id", "kind", "parent_kind", "parent_key", F.array_join("faults", ",").alias("faults"))
