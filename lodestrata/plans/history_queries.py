"""Queries of event logs, effective views, dependencies, sets and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import history, sequences
from lodestrata.plans.tables import Registry, Tables

R = Registry()

LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


@R.add(f"SELECT user_id, event_id, event_type, value FROM ({LAST})")
def latest_event(t: Tables) -> DataFrame:
    """The last event of each user."""
    return history.latest(t.events.select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@R.add("""
WITH p AS (SELECT user_id, max(ts) AS p_ts FROM events WHERE event_type = 'purchase' GROUP BY 1), o AS (SELECT user_id, max(ts) AS o_ts FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT user_id, coalesce(o_ts > p_ts, false) AS needs_revisit FROM p LEFT JOIN o USING (user_id)
""")
def needs_revisit(t: Tables) -> DataFrame:
    """Users whose last purchase an error followed."""
    bought = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("at"))
    return history.needs_revisit(bought, ["user_id"], F.lit(True), "at", t.events.filter("event_type = 'error'").select("user_id", "ts"), "ts").select("user_id", "needs_revisit")


@R.add(f"""
WITH l AS ({LAST}), c AS (SELECT user_id, event_type, value FROM l WHERE event_type IN ('purchase', 'click'))
SELECT c_custkey, CASE WHEN c.user_id IS NOT NULL THEN c.event_type ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c.user_id IS NOT NULL THEN c.value ELSE c_acctbal END AS c_acctbal, c.user_id IS NOT NULL AS change_applied FROM customer LEFT JOIN c ON c.user_id = c_custkey
""")
def effective_properties(t: Tables) -> DataFrame:
    """Customers with the fields of accepted latest events in place of their own."""
    changes = history.latest(t.events.select("user_id", "ts", "event_id", "event_type", "value"), ["user_id"], ["ts", "event_id"]).withColumnRenamed("user_id", "c_custkey")
    base = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return history.effective(base, changes, ["c_custkey"], {"c_mktsegment": "event_type", "c_acctbal": "value"}, F.col("event_type").isin("purchase", "click"))


DEPS = "SELECT user_id, '{' || string_agg('\"' || event_type || '\":' || v, ',' ORDER BY event_type) || '}' AS dependencies FROM (SELECT user_id, event_type, max(event_id) AS v FROM events %s GROUP BY ALL) GROUP BY 1"


@R.add(DEPS % "")
def dependency_map(t: Tables) -> DataFrame:
    """Per user the last event of each type, as canonical JSON."""
    return history.dependency_map(t.events, ["user_id"], "event_type", "event_id")


@R.add(f"""
WITH a AS ({DEPS % "WHERE event_id % 50 <> 49"}), b AS ({DEPS % ""})
SELECT user_id, sha256(a.dependencies) AS recorded_id, sha256(b.dependencies) AS current_id, a.dependencies IS NOT DISTINCT FROM b.dependencies AS is_current FROM a FULL JOIN b USING (user_id)
""")
def snapshot_is_current(t: Tables) -> DataFrame:
    """Recorded dependency digests against those of today."""
    recorded = history.dependency_map(t.events.filter("event_id % 50 <> 49"), ["user_id"], "event_type", "event_id")
    return history.snapshot_state(recorded, history.dependency_map(t.events, ["user_id"], "event_type", "event_id"), ["user_id"])


@R.add("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def distinct_on_latest(t: Tables) -> DataFrame:
    """The last order of each customer."""
    return history.latest(t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@R.add("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')))")
def semi_chain(t: Tables) -> DataFrame:
    """Orders below one region, by semi joins down the tree."""
    nations = t.nation.join(t.region.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    customers = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return t.orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@R.add("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_orphans(t: Tables) -> DataFrame:
    """Orders without lines."""
    return t.orders.select("o_orderkey").join(t.lineitem.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@R.add("SELECT p_partkey AS l_partkey, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def tree_orphans(t: Tables) -> DataFrame:
    """Lines that name a supplier outside the accepted ones."""
    lines = t.lineitem.select("l_partkey", "l_suppkey").join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return history.orphans(lines, t.supplier.filter("s_acctbal > 0"), ["l_suppkey"], ["s_suppkey"]).select("l_partkey", "l_suppkey")


@R.add("""
WITH h AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, sha256(l_shipdate::DATE::VARCHAR) AS v, l_returnflag FROM lineitem), c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, v FROM h WHERE l_returnflag = 'R')
SELECT h.l_orderkey, h.l_partkey, h.l_suppkey, h.l_linenumber, c.v IS NOT NULL AS corrected FROM h LEFT JOIN c USING (l_orderkey, l_partkey, l_suppkey, l_linenumber, v)
""")
def composite_version_join(t: Tables) -> DataFrame:
    """Corrections apply only to the exact version that they name."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    lines = t.lineitem.select(*keys, F.sha2(F.date_format("l_shipdate", "yyyy-MM-dd"), 256).alias("v"), "l_returnflag")
    corrections = lines.filter("l_returnflag = 'R'").select(*keys, "v", F.lit(True).alias("hit"))
    return lines.join(corrections, [*keys, "v"], "left").select(*keys, F.coalesce("hit", F.lit(False)).alias("corrected"))


@R.add("""
(SELECT p_partkey AS k, 'left' AS side FROM part EXCEPT ALL SELECT l_partkey, 'left' FROM (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 45))
UNION ALL (SELECT DISTINCT l_partkey, 'right' FROM lineitem WHERE l_quantity > 45 EXCEPT ALL SELECT p_partkey, 'right' FROM part)
""")
def symmetric_difference(t: Tables) -> DataFrame:
    """Parts and parts in large lines, what only one of them has."""
    return sequences.symmetric_difference(t.part.select(F.col("p_partkey").alias("k")), t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("k")).distinct())


@R.add("SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 400000 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity = 50 UNION SELECT l_orderkey FROM lineitem WHERE l_discount > 0.09 UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def union_candidates(t: Tables) -> DataFrame:
    """Four-branch union of candidate keys, each branch with its own pushed filter."""
    orders, lines = t.orders, t.lineitem
    parts = [orders.filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("k")), lines.filter("l_quantity = 50").select(F.col("l_orderkey").alias("k")), lines.filter("l_discount > 0.09").select(F.col("l_orderkey").alias("k")), orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("k"))]
    return sequences.union_of_keys(*parts)


@R.add("""
WITH s AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000), u AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 9000)
SELECT 'both' AS part, count(*) AS n FROM (SELECT k FROM s INTERSECT SELECT k FROM u) UNION ALL SELECT 'either', count(*) FROM (SELECT k FROM s UNION SELECT k FROM u) UNION ALL SELECT 'left_only', count(*) FROM (SELECT k FROM s EXCEPT SELECT k FROM u)
""")
def set_operations(t: Tables) -> DataFrame:
    """Intersection, union and difference of two code sets."""
    a, b = t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), t.supplier.filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("k"))
    named = lambda df, n: df.agg(F.count("*").alias("n")).select(F.lit(n).alias("part"), "n")
    return named(a.intersect(b), "both").unionByName(named(a.union(b).distinct(), "either")).unionByName(named(a.subtract(b), "left_only"))


@R.add("""
WITH e AS (SELECT user_id, event_id, epoch_ms(ts) AS a, epoch_ms(ts) + (value * 10000)::BIGINT AS b FROM events), n AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY a, event_id) AS na FROM e)
SELECT user_id, CASE WHEN na IS NULL THEN 'last' WHEN na > b THEN 'gap' WHEN na < b THEN 'overlap' ELSE 'touch' END AS class, count(*) AS n FROM n GROUP BY ALL
""")
def adjacent_gaps(t: Tables) -> DataFrame:
    """How each user's consecutive event spans lie to one another."""
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    spans = t.events.select("user_id", "event_id", start.alias("a"), (start + F.round(F.col("value") * 10000).cast("long")).alias("b"))
    pairs = sequences.adjacent_pairs(spans, ["user_id"], ["a", "event_id"], ["a"])
    return pairs.groupBy("user_id", sequences.adjacency_class(F.col("b"), F.col("next_a")).alias("class")).agg(F.count("*").alias("n"))


@R.add("""
WITH p AS (SELECT l_partkey AS x, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS y FROM lineitem)
SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM p WHERE y IS NOT NULL GROUP BY ALL
""")
def segment_multiset(t: Tables) -> DataFrame:
    """Undirected pairs of consecutive parts of an order, with multiplicity."""
    pairs = sequences.adjacent_pairs(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_partkey"])
    return sequences.segment_multiset(pairs, "l_partkey", "next_l_partkey")


@R.add("""
WITH v AS (SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) FILTER (year(l_shipdate) = 1997) AS now, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) FILTER (year(l_shipdate) = 1996) AS before FROM lineitem GROUP BY 1)
SELECT l_suppkey, row_number() OVER (ORDER BY coalesce(now, 0) DESC, l_suppkey)::INT AS rank, row_number() OVER (ORDER BY coalesce(before, 0) DESC, l_suppkey)::INT AS previous_rank FROM v
""")
def rank_refresh(t: Tables) -> DataFrame:
    """Suppliers ranked by revenue, with the rank of the year before."""
    price, year = F.col("l_extendedprice").cast("decimal(18,2)"), F.year("l_shipdate")
    total = lambda y, n: F.coalesce(F.sum(F.when(year == y, price)), F.lit(0)).alias(n)
    sums = t.lineitem.groupBy("l_suppkey").agg(total(1997, "now"), total(1996, "before"))
    return sequences.ranked(sequences.ranked(sums, "now", "l_suppkey", "rank"), "before", "l_suppkey", "previous_rank").select("l_suppkey", "rank", "previous_rank")


@R.add("""
WITH v AS (SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS s FROM lineitem GROUP BY 1), r AS (SELECT s, row_number() OVER (ORDER BY s DESC, l_suppkey) AS k FROM v)
SELECT n AS top_n, (SELECT sum(s)::DOUBLE FROM r WHERE k <= n) AS total FROM (VALUES (3), (5), (10), (20), (40)) AS x(n) UNION ALL SELECT 0, sum(s)::DOUBLE FROM v
""")
def scenario_curve(t: Tables) -> DataFrame:
    """Revenue of the n largest suppliers, for several n and for all."""
    sums = t.lineitem.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("s"))
    return sequences.top_curve(sums, "s", "l_suppkey", [3, 5, 10, 20, 40]).select("top_n", F.col("total").cast("double").alias("total"))


@R.add("""
SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(sqrt(avg(l_extendedprice * l_extendedprice)), 4) AS rms, round(quantile_cont(l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, round(quantile_cont(abs(l_extendedprice), 0.95), 4) AS abs_p95, max(abs(l_extendedprice)) AS max_abs FROM lineitem GROUP BY 1
""")
def descriptive_stats(t: Tables) -> DataFrame:
    """Exact statistics of prices per return flag."""
    s = sequences.describe_exact(t.lineitem, ["l_returnflag"], "l_extendedprice")
    return s.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "rms", "p05", "p95", "abs_p95")], "max_abs")


@R.add("""
WITH p AS (SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS DECIMAL(10, 2)) END AS pct FROM lineitem), m AS (SELECT l_orderkey, max(pct) AS m FROM p GROUP BY 1)
SELECT p.l_orderkey, count(*)::BIGINT AS n_parts, sum(pct)::DOUBLE AS total, count(*) - count(pct) AS n_missing, any_value(m)::DOUBLE AS largest, count(*) FILTER (pct = m)::INT AS n_largest,
CASE WHEN count(*) > count(pct) THEN 'unknown' WHEN sum(pct) < 100 THEN 'under_100' WHEN sum(pct) > 100 THEN 'over_100' ELSE 'sums_to_100' END AS state FROM p JOIN m ON m.l_orderkey = p.l_orderkey GROUP BY p.l_orderkey
""")
def mixture_state(t: Tables) -> DataFrame:
    """Whether the parts of each order make up a hundred, in exact decimals."""
    pct = F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("decimal(10,2)"))
    m = sequences.mixture_state(t.lineitem.select("l_orderkey", pct.alias("pct")), ["l_orderkey"], "pct")
    return m.withColumns({"total": F.col("total").cast("double"), "largest": F.col("largest").cast("double")})


@R.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY abs(o_totalprice - 250000) DESC, o_orderkey LIMIT 5")
def top_residuals(t: Tables) -> DataFrame:
    """The five orders farthest from a price."""
    return sequences.top_n(t.orders, 5, F.abs(F.col("o_totalprice") - 250000), "o_orderkey").select("o_orderkey", "o_totalprice")


@R.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 3")
def idempotent_append(t: Tables) -> DataFrame:
    """What a replayed load still has to write."""
    incoming = t.orders.select("o_orderkey", "o_custkey")
    return history.new_rows(incoming.unionByName(incoming), t.orders.filter("o_orderkey % 7 = 3").select("o_orderkey"), ["o_orderkey"])


@R.add("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def replay_conflicts(t: Tables) -> DataFrame:
    """Keys that come again with another payload."""
    stored = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    incoming = stored.withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "X").otherwise(F.col("o_orderstatus")))
    return history.replay_conflicts(incoming, stored, ["o_orderkey"])


@R.add("SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0 OR (o_orderkey % 13 = 0 AND o_totalprice > 100000)")
def immutability_guard(t: Tables) -> DataFrame:
    """Rows that a new version removed or changed."""
    before = t.orders.select("o_orderkey", "o_totalprice")
    after = before.filter("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when((F.col("o_orderkey") % 13 == 0) & (F.col("o_totalprice") > 100000), 0.0).otherwise(F.col("o_totalprice")))
    return history.changed_or_removed(before, after, ["o_orderkey"])


@R.add(f"""
WITH head AS (SELECT user_id, event_id AS head_id FROM ({LAST})), i AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_id - 1 ELSE event_id END AS expected_id FROM ({LAST})),
p AS (SELECT user_id, event_id + 1000000 AS event_id, expected_id FROM i UNION ALL SELECT user_id, event_id + 2000000, expected_id FROM i WHERE user_id % 2 = 0)
SELECT user_id, event_id, CASE WHEN expected_id IS DISTINCT FROM head_id THEN 'stale' WHEN event_id <> min(event_id) OVER (PARTITION BY user_id, expected_id) THEN 'stale' ELSE 'append' END AS decision FROM p LEFT JOIN head USING (user_id)
""")
def optimistic_append(t: Tables) -> DataFrame:
    """Which events append and which expect a head that has moved on."""
    head = history.latest(t.events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("head_id"))
    expected = F.when(F.col("head_id") % 3 == 0, F.col("head_id") - 1).otherwise(F.col("head_id"))
    one = head.select("user_id", (F.col("head_id") + 1000000).alias("event_id"), expected.alias("expected_id"))
    two = head.filter("user_id % 2 = 0").select("user_id", (F.col("head_id") + 2000000).alias("event_id"), expected.alias("expected_id"))
    return history.plan_append(head, one.unionByName(two), ["user_id"]).select("user_id", "event_id", "decision")


@R.add(f"""
WITH r AS (SELECT user_id, event_id AS result FROM ({LAST.replace("FROM events", "FROM events WHERE event_id % 2 = 0")})), v AS (SELECT user_id, event_id AS result FROM ({LAST.replace("FROM events", "FROM events WHERE event_type = 'purchase'")})), n AS (SELECT user_id, max(event_id) AS now FROM events GROUP BY 1)
SELECT user_id, coalesce(v.result, r.result) AS result, v.user_id IS NOT NULL AS revised, coalesce(v.result, r.result) IS DISTINCT FROM now AS is_stale FROM r LEFT JOIN v USING (user_id) LEFT JOIN n USING (user_id)
""")
def latest_revision(t: Tables) -> DataFrame:
    """The last revision of each result, with visible staleness."""
    ev = t.events.select("user_id", "ts", "event_id")
    results = history.latest(ev.filter("event_id % 2 = 0"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("result"))
    revisions = t.events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("result"), "ts")
    now = t.events.groupBy("user_id").agg(F.max("event_id").alias("result"))
    return history.latest_with_staleness(results, revisions, ["user_id"], ["ts", "result"], "result", now)


@R.add("""
SELECT l_returnflag FROM (SELECT l_returnflag, count(*) AS n, count(*) + CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS claimed FROM lineitem GROUP BY 1) WHERE n <> claimed
""")
def incomplete_batches(t: Tables) -> DataFrame:
    """Batches whose rows do not match their manifest."""
    from lodestrata.functions.digest import ordered_fingerprint

    rows = t.lineitem.select("l_returnflag", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("id"), F.sha2("l_linestatus", 256).alias("d"))
    manifest = ordered_fingerprint(rows, ["l_returnflag"], ["id"], "d").withColumn("n_rows", F.col("n_rows") + (F.col("l_returnflag") == "N").cast("int"))
    return history.incomplete_batches(rows, manifest, ["l_returnflag"], "id", "d")


@R.add("""
SELECT coalesce(c.k, s.k) AS k, CASE WHEN c.k IS NULL THEN 'only_right' WHEN s.k IS NULL THEN 'only_left' WHEN c.n = s.n THEN 'equal' ELSE 'differs' END AS state FROM (SELECT c_nationkey AS k, count(*) // 30 AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) // 2 AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c.k = s.k
""")
def reconciliation(t: Tables) -> DataFrame:
    """Two services reconciled on a key, neither side lost."""
    c = t.customer.filter("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.floor(F.count("*") / 30).alias("n"))
    s = t.supplier.filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.floor(F.count("*") / 2).alias("m"))
    state = F.when(F.col("n").isNull(), "only_right").when(F.col("m").isNull(), "only_left").when(F.col("n") == F.col("m"), "equal").otherwise("differs")
    return c.join(s, "k", "full_outer").select("k", state.alias("state"))
