"""Queries of incremental recomputation, order-free identities and the single writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.digest import tree_fingerprint
from lodestrata.functions.stages import Stages
from lodestrata.geometry.frames import box_region
from lodestrata.operators.boxes import BOX
from lodestrata.plans.spatial_queries import PARTS_SQL, ZONES_SQL, _parts, _zones
from lodestrata.plans.tables import Registry, Tables
from lodestrata.products import recompute
from lodestrata.streaming import single_writer

R = Registry()
CELL = 64.0
SHIFT = 5.0

# Proposals move every third part to the right; the last event on a part (lines are events) decides whether that holds.
# The stored results are those of the events of even orders only.
_EFFECTIVE = """
SELECT p.id, p.xmin + shift AS xmin, p.ymin, p.xmax + shift AS xmax, p.ymax
FROM (SELECT p.*, CASE WHEN p.id % 3 = 0 AND e.flag = 'A' THEN 5.0 ELSE 0.0 END AS shift FROM parts p LEFT JOIN {events} e USING (id)) p
"""
_EVENTS = "SELECT l_partkey AS id, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS flag FROM lineitem {where} GROUP BY 1"


@R.add(f"""
WITH parts AS ({PARTS_SQL}), zones AS ({ZONES_SQL}),
e0 AS ({_EVENTS.format(where="WHERE l_orderkey % 2 = 0")}), e1 AS ({_EVENTS.format(where="")}),
s0 AS ({_EFFECTIVE.format(events="e0")}), s1 AS ({_EFFECTIVE.format(events="e1")}),
d0 AS (SELECT z.id, list((s.id, s.xmin) ORDER BY s.id) AS deps FROM zones z JOIN s0 s ON s.xmin <= z.xmax AND z.xmin <= s.xmax AND s.ymin <= z.ymax AND z.ymin <= s.ymax GROUP BY 1),
d1 AS (SELECT z.id, list((s.id, s.xmin) ORDER BY s.id) AS deps FROM zones z JOIN s1 s ON s.xmin <= z.xmax AND z.xmin <= s.xmax AND s.ymin <= z.ymax AND z.ymin <= s.ymax GROUP BY 1),
near AS (SELECT z.id, z.xmin AS zx, z.ymin AS zy, s.* EXCLUDE (id) FROM zones z JOIN s1 s ON s.xmin < z.xmax AND z.xmin < s.xmax AND s.ymin < z.ymax AND z.ymin < s.ymax),
hit AS (SELECT id, count(DISTINCT i) AS n FROM near, range(0, 2400) r(i) WHERE xmin <= zx + i % 60 AND xmax >= zx + i % 60 + 1 AND ymin <= zy + i // 60 AND ymax >= zy + i // 60 + 1 GROUP BY 1)
SELECT z.id, coalesce(n, 0)::DOUBLE AS covered, d0.deps IS DISTINCT FROM d1.deps AS recomputed
FROM zones z LEFT JOIN hit ON hit.id = z.id LEFT JOIN d0 ON d0.id = z.id LEFT JOIN d1 ON d1.id = z.id
""")
def incremental_coverage(t: Tables) -> DataFrame:
    """Covered area of zones after some proposals were accepted or withdrawn: only the zones that they meet are computed again."""
    zones, parts = _zones(t), _parts(t)
    box = box_region(*[F.col(c) for c in BOX])
    subjects, sources = zones.select("id", F.array(box[0]).alias("region")), parts.select("id", box.alias("region"))
    moved = box_region(F.col("xmin") + SHIFT, F.col("ymin"), F.col("xmax") + SHIFT, F.col("ymax"))
    proposals = parts.filter("id % 3 = 0").select("id", moved.alias("region"))
    status = F.when(F.col("l_returnflag") == "A", "accepted").otherwise("withdrawn")
    events = t.lineitem.select(F.col("l_partkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), status.alias("status"), "l_orderkey")
    stages = Stages(t.spark, "recompute")
    before = recompute.accepted_shapes(sources, proposals, events.filter("l_orderkey % 2 = 0"))
    after = recompute.accepted_shapes(sources, proposals, events)
    turn = iter(range(100))
    compute = lambda s, i: recompute.covered_areas(s, i, CELL, Stages(t.spark, f"covered-{next(turn)}"))
    stored = stages.keep(recompute.computed(subjects, before, compute, CELL), "stored")
    found = recompute.recomputed(stored, subjects, after, compute, CELL, stages)
    return found.select("id", F.round("covered", 6).alias("covered"), "recomputed")


@R.add("""
WITH d AS (
  SELECT l_returnflag, sha256(l_orderkey || '-' || l_linenumber || '-' || sha256(l_linestatus)) AS h FROM lineitem
), s AS (
  SELECT l_returnflag, count(*) AS n_rows, sum(('0x' || substr(h, 1, 16))::UBIGINT) AS a, sum(('0x' || substr(h, 17, 16))::UBIGINT) AS b,
    sum(('0x' || substr(h, 33, 16))::UBIGINT) AS c, sum(('0x' || substr(h, 49, 16))::UBIGINT) AS d
  FROM d GROUP BY 1
)
SELECT l_returnflag, n_rows, sha256(concat_ws('|', n_rows::VARCHAR, a::VARCHAR, b::VARCHAR, c::VARCHAR, d::VARCHAR)) AS fingerprint FROM s
""")
def tree_fingerprints(t: Tables) -> DataFrame:
    """Order-free identities of groups of lines: no group is ever sorted or one task's."""
    row = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.sha2("l_linestatus", 256))
    return tree_fingerprint(t.lineitem.select("l_returnflag", row.alias("d")), ["l_returnflag"], "d")


@R.add("""
WITH e AS (SELECT user_id, event_id, event_id % 7 <> 0 AS good, event_id % 11 = 0 AND event_id % 7 <> 0 AS rival FROM events),
s AS (SELECT user_id, count(*) FILTER (good) AS n_appended, count(*) FILTER (NOT good) + count(*) FILTER (rival) AS n_stale, max(event_id) FILTER (good) AS head_id FROM e GROUP BY 1)
SELECT user_id, n_appended, n_stale, coalesce(head_id, -1) AS head_id FROM s
""")
def single_writer_log(t: Tables) -> DataFrame:
    """Append requests of users as a stream in several starts: each names the head it has seen; rivals and wrong heads are stale.

    Every seventh event names a head that was never there, every eleventh has a rival with the same expectation, and the
    last file brings the first one again.
    """
    e = t.events.select("user_id", "event_id", (F.col("event_id") % 7 != 0).alias("good"))
    seen = F.lag("event_id").over(Window.partitionBy("user_id", "good").orderBy("event_id"))
    own = e.select("user_id", F.col("event_id").alias("request_id"), F.when(F.col("good"), seen).otherwise(F.lit(-1)).cast("long").alias("expected_id"), (F.col("event_id") * 2).alias("at"), "good")
    rivals = own.filter("good and request_id % 11 = 0").select("user_id", (-F.col("request_id") - 1).alias("request_id"), "expected_id", (F.col("at") + 1).alias("at"), "good")
    stages = Stages(t.spark, "writer")
    requests = stages.keep(own.unionByName(rivals).drop("good"), "requests")
    low, high = requests.agg(F.min("at"), F.max("at")).first()
    third = ((high or 0) - (low or 0)) // 3 + 1
    inbox, log, checkpoint = (f"{stages.path}/{n}" for n in ("inbox", "log", "checkpoint"))
    for part in (0, 1, 2, 0):
        rows = requests.filter((F.col("at") >= (low or 0) + part * third) & (F.col("at") < (low or 0) + (part + 1) * third))
        rows.write.mode("append").parquet(inbox)
        single_writer.run_writer(t.spark, inbox, requests.schema, "user_id", log, checkpoint, files_per_batch=1000)
    decided = single_writer.read_log(t.spark, log)
    counted = decided.groupBy("key").agg(F.count_if(F.col("decision") == "append").alias("n_appended"), F.count_if(F.col("decision") == "stale").alias("n_stale"))
    last = single_writer.heads(decided).select(F.col("key").alias("_key"), "head_id")
    return counted.join(last, F.col("key").eqNullSafe(F.col("_key")), "left").select(F.col("key").alias("user_id"), "n_appended", "n_stale", F.coalesce("head_id", F.lit(-1)).alias("head_id"))
