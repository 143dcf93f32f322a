"""Queries of variants, lookups, proposals, lateral picks and derived documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import dates, digest, scalars
from lodestrata.operators import history, matching, sequences
from lodestrata.plans.tables import Registry, Tables

R = Registry()


@R.add("""
WITH v AS (SELECT l_orderkey, count(*) AS n_rows, count(DISTINCT l_linestatus) = 1 AS core_consistent, count(DISTINCT (l_returnflag, l_linenumber))::INT AS n_variants, count(DISTINCT l_returnflag) AS a, count(DISTINCT l_linenumber) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, n_rows, core_consistent, n_variants, concat_ws(',', CASE WHEN a > 1 THEN 'l_returnflag' END, CASE WHEN b > 1 THEN 'l_linenumber' END) AS differing FROM v
""")
def source_variants(t: Tables) -> DataFrame:
    """Rows of each order as variants of one record, and the fields in which they differ."""
    v = matching.grouped_variants(t.lineitem, "l_orderkey", ["l_linestatus"], ["l_returnflag", "l_linenumber"])
    return v.select("l_orderkey", "n_rows", "core_consistent", "n_variants", F.array_join("differing_fields", ",").alias("differing"))


@R.add("""
WITH c AS (SELECT s_nationkey AS k, count(*) AS n, min(s_name) AS s_name FROM supplier WHERE s_acctbal > 6000 GROUP BY 1)
SELECT c_custkey, coalesce(n, 0)::BIGINT AS n_matches, CASE WHEN n = 1 THEN s_name END AS s_name FROM customer LEFT JOIN c ON k = c_nationkey
""")
def guarded_lookup(t: Tables) -> DataFrame:
    """A supplier's name for each customer, given only where exactly one qualifies."""
    return matching.exactly_one_lookup(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", t.supplier.filter("s_acctbal > 6000"), "s_nationkey", "s_name").select("c_custkey", "n_matches", "s_name")


@R.add("""
WITH l AS (SELECT c_custkey, o_orderkey % 997 AS cand, c_acctbal < 0 AS neg FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'),
sh AS (SELECT cand FROM l WHERE cand IS NOT NULL GROUP BY 1 HAVING count(DISTINCT c_custkey) > 1),
s AS (SELECT c_custkey, count(l.cand) AS n, min(l.cand) AS c, bool_or(sh.cand IS NOT NULL) AS shared, bool_or(neg) AS neg FROM l LEFT JOIN sh ON sh.cand = l.cand GROUP BY 1)
SELECT c_custkey, CASE WHEN n = 1 AND NOT shared AND NOT neg THEN c::DOUBLE END AS proposed, concat_ws(',', CASE WHEN n = 0 THEN 'no_candidate' END, CASE WHEN n > 1 THEN 'multiple_candidates' END, CASE WHEN shared THEN 'shared_candidate' END, CASE WHEN neg THEN 'negative_balance' END) AS holds FROM s
""")
def crosswalk_proposals(t: Tables) -> DataFrame:
    """Proposals that only an unshared, single candidate without holds makes."""
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey", (F.col("o_orderkey") % 997).alias("cand"))
    links = t.customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "cand", "c_acctbal")
    p = matching.proposals(links, "c_custkey", "cand", {"negative_balance": F.col("c_acctbal") < 0})
    return p.select("c_custkey", F.col("proposed").cast("double").alias("proposed"), F.array_join("holds", ",").alias("holds"))


@R.add("""
SELECT n_nationkey, c_custkey, c_acctbal FROM (SELECT n_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal, c_custkey) AS rn FROM nation JOIN customer ON c_nationkey = n_nationkey) WHERE rn = 1
""")
def lateral_pick(t: Tables) -> DataFrame:
    """The first customer of each nation by balance."""
    return matching.first_per_row(t.nation, t.customer, F.col("n_nationkey") == F.col("c_nationkey"), ["c_acctbal", "c_custkey"], ["c_custkey", "c_acctbal"], ["n_nationkey"])


@R.add("""
WITH q AS (SELECT role, name, array_to_string(list_sort(list_distinct(list(priv))), ',') AS p FROM (SELECT l_returnflag AS role, o_orderstatus AS name, l_linestatus AS priv FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 49 AND l_discount > 0.09) GROUP BY ALL)
SELECT r.role, s.name, coalesce(p, '') AS privileges FROM (SELECT DISTINCT l_returnflag AS role FROM lineitem) r CROSS JOIN (SELECT DISTINCT o_orderstatus AS name FROM orders) s LEFT JOIN q ON q.role = r.role AND q.name = s.name
""")
def privilege_matrix(t: Tables) -> DataFrame:
    """Every role and table with what is granted."""
    lines = t.lineitem
    grants = lines.filter("l_quantity > 49 and l_discount > 0.09").join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_returnflag").alias("role"), F.col("o_orderstatus").alias("name"), F.col("l_linestatus").alias("privilege"))
    m = matching.privilege_matrix(lines.select(F.col("l_returnflag").alias("role")), t.orders.select(F.col("o_orderstatus").alias("name")), grants)
    return m.select("role", "name", F.array_join("privileges", ",").alias("privileges"))


@R.add("""
WITH d AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN NULL ELSE strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') END AS b FROM orders)
SELECT o_orderkey, CASE WHEN b IS NULL THEN 'unknown' WHEN a = b THEN 'same' ELSE 'differs' END AS agreement FROM d
""")
def date_reconciliation(t: Tables) -> DataFrame:
    """Two dates of each order, written differently, reconciled without widening a year to a day."""
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 4
    other = F.when(kind == 0, dates.unpadded(day)).when(kind == 1, F.date_format(day, "yyyy")).when(kind == 2, "13/45/1990").otherwise(F.date_format(F.date_add(day, 1), "yyyyMMdd"))
    parsed = t.orders.select("o_orderkey", dates.parse_date(F.date_format(day, "yyyyMMdd")).alias("a"), dates.parse_date(other).alias("b"))
    return matching.date_agreement(parsed, ["a", "b"]).select("o_orderkey", "agreement")


@R.add("SELECT event_id, props AS canonical, sha256(props) AS digest FROM (SELECT event_id, replace(props, ' ', '') AS props FROM events)")
def canonical_props(t: Tables) -> DataFrame:
    """Canonical form and digest of each event's properties."""
    c = digest.canonical_json(F.col("props"))
    return t.events.select("event_id", c.alias("canonical")).select("event_id", "canonical", digest.sha256(F.col("canonical")).alias("digest"))


@R.add("""
SELECT l_linestatus, count(*) AS n_rows, sha256(string_agg(concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) || ':' || sha256(l_returnflag) || chr(10), '' ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, sha256(l_returnflag))) AS fingerprint FROM lineitem GROUP BY 1
""")
def stream_fingerprint(t: Tables) -> DataFrame:
    """Fingerprint of rows in load order."""
    rows = t.lineitem.withColumn("d", F.sha2("l_returnflag", 256))
    return digest.ordered_fingerprint(rows, ["l_linestatus"], ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "d")


@R.add("""
SELECT p_partkey, p_size, CASE WHEN p_size % 3 = 0 THEN 'incomplete' WHEN p_size % 10 > p_size % 7 OR p_size % 7 > 8 THEN 'inverted' ELSE 'complete' END AS range_state, ((p_size > 10)::INT + (p_partkey % 2 = 0)::INT = 1) AS exclusive, greatest(0.0, least(1.0, (p_retailprice - 900) / 1000)) AS clamped, 'P-' || p_partkey AS code FROM part
""")
def scalar_contracts(t: Tables) -> DataFrame:
    """Range sanity, mutual exclusion and clamped fractions of parts."""
    size = F.col("p_size")
    low, typical, high = F.when(size % 3 != 0, size % 10), F.when(size % 3 != 0, size % 7), F.lit(8)
    state = scalars.range_sanity(low, typical, F.when(size % 3 != 0, high))
    return t.part.select("p_partkey", "p_size", state.alias("range_state"), scalars.exactly_one(size > 10, F.col("p_partkey") % 2 == 0).alias("exclusive"), scalars.clamp01((F.col("p_retailprice") - 900) / 1000).alias("clamped"), F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("code"))


@R.add("""
SELECT user_id, list_sort(list_distinct(list(event_type)))[1] AS first_type, count(*) AS n, max(event_id) FILTER (event_type = 'click') AS last_click FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'click') > 0
""")
def scoped_current(t: Tables) -> DataFrame:
    """Users with a click: their first type, rows, and last click."""
    g = t.events.groupBy("user_id").agg(F.min("event_type").alias("first_type"), F.count("*").alias("n"), F.max(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("last_click"))
    return g.filter("last_click is not null")


@R.add("""
WITH a AS (SELECT p_partkey, p_brand, p_size FROM part), b AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 50 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 70 <> 1)
SELECT side, count(*) AS n FROM (SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY 1
""")
def multiset_difference(t: Tables) -> DataFrame:
    """How two versions of a table differ as multisets."""
    a = t.part.select("p_partkey", "p_brand", "p_size")
    b = a.filter("p_partkey % 70 <> 1").withColumn("p_size", F.when(F.col("p_partkey") % 50 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    return sequences.symmetric_difference(a, b).groupBy("side").agg(F.count("*").alias("n"))


@R.add("""
WITH r AS (SELECT c_custkey, c_mktsegment FROM customer), f AS (SELECT c_custkey, c_mktsegment AS seg FROM customer WHERE c_custkey % 6 = 0)
SELECT r.c_custkey, coalesce(f.seg, r.c_mktsegment) AS seg, f.c_custkey IS NOT NULL AS applied FROM r LEFT JOIN f USING (c_custkey)
""")
def accepted_only(t: Tables) -> DataFrame:
    """Effective values in which only accepted changes take part."""
    base = t.customer.select("c_custkey", F.col("c_mktsegment").alias("seg"))
    changes = t.customer.select("c_custkey", F.col("c_mktsegment").alias("new"), F.when(F.col("c_custkey") % 6 == 0, "accepted").otherwise("proposed").alias("status"))
    return history.effective(base, changes, ["c_custkey"], {"seg": "new"}, F.col("status") == "accepted").withColumnRenamed("change_applied", "applied")
