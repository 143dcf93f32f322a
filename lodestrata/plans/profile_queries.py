"""Queries of profiles, links, flags and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import dates, digest, scalars
from lodestrata.operators import quality
from lodestrata.plans.tables import Registry, Tables

R = Registry()


@R.add("""
SELECT 'lineitem' AS source, count(*) AS n_rows, count(l_orderkey) AS n_present, count(*) - count(l_orderkey) AS n_missing, count(DISTINCT l_orderkey) AS n_distinct, count(l_orderkey) - count(DISTINCT l_orderkey) AS n_excess FROM lineitem
UNION ALL SELECT 'orders', count(*), count(o_orderkey), count(*) - count(o_orderkey), count(DISTINCT o_orderkey), count(o_orderkey) - count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'customer', count(*), count(c_custkey), count(*) - count(c_custkey), count(DISTINCT c_custkey), count(c_custkey) - count(DISTINCT c_custkey) FROM customer
UNION ALL SELECT 'documents', count(*), count(nullif(trim(text), '')), count(*) - count(nullif(trim(text), '')), count(DISTINCT nullif(trim(text), '')), count(nullif(trim(text), '')) - count(DISTINCT nullif(text, '')) FROM documents
""")  # fmt: skip
def key_profile(t: Tables) -> DataFrame:
    """Rows, present, missing, distinct and excess of four keys."""
    parts = [quality.key_profile(t.lineitem, "l_orderkey", "lineitem"), quality.key_profile(t.orders, "o_orderkey", "orders"), quality.key_profile(t.customer, "c_custkey", "customer"), quality.key_profile(t.documents, "text", "documents")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@R.add("""
WITH a AS (SELECT o_orderkey AS k, count(*) AS l FROM orders WHERE o_orderkey IS NOT NULL GROUP BY 1),
b AS (SELECT l_orderkey AS k, count(*) AS r FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1),
j AS (SELECT l, r, CASE WHEN r IS NULL THEN 'unmatched_left' WHEN l IS NULL THEN 'unmatched_right' WHEN l = 1 AND r = 1 THEN 'one_to_one' WHEN l = 1 THEN 'one_to_many' WHEN r = 1 THEN 'many_to_one' ELSE 'many_to_many' END AS pattern FROM a FULL JOIN b USING (k))
SELECT pattern, count(*) AS n_keys, coalesce(sum(l), 0)::BIGINT AS left_rows, coalesce(sum(r), 0)::BIGINT AS right_rows FROM j GROUP BY pattern
""")  # fmt: skip
def join_cardinality(t: Tables) -> DataFrame:
    """Key patterns between orders and lines."""
    return quality.join_patterns(t.orders.select("o_orderkey"), t.lineitem.select("l_orderkey"), "o_orderkey", "l_orderkey")


@R.add("""
WITH a AS (SELECT l_partkey AS k, count(*) AS l FROM lineitem GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
j AS (SELECT l, r, CASE WHEN r IS NULL THEN 'unmatched_left' WHEN l IS NULL THEN 'unmatched_right' WHEN l = 1 AND r = 1 THEN 'one_to_one' WHEN l = 1 THEN 'one_to_many' WHEN r = 1 THEN 'many_to_one' ELSE 'many_to_many' END AS pattern FROM a FULL JOIN b USING (k))
SELECT pattern, count(*) AS n_keys, coalesce(sum(l), 0)::BIGINT AS left_rows, coalesce(sum(r), 0)::BIGINT AS right_rows FROM j GROUP BY pattern
""")  # fmt: skip
def join_cardinality_many(t: Tables) -> DataFrame:
    """Key patterns of two many-sided sources."""
    lines = t.lineitem.select("l_partkey", "l_returnflag")
    return quality.join_patterns(lines, lines.filter("l_returnflag = 'R'"), "l_partkey", "l_partkey")


@R.add("""
WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0)::BIGINT AS candidate_count, CASE WHEN n IS NULL THEN 'zero' WHEN n = 1 THEN 'one' ELSE 'multiple' END AS match_state FROM orders LEFT JOIN n ON k = o_orderkey
""")
def candidate_links(t: Tables) -> DataFrame:
    """Each order with its candidates among the lines."""
    return quality.candidate_links(t.orders.select("o_orderkey"), t.lineitem.select("l_orderkey"), "o_orderkey", "l_orderkey")


@R.add("""
WITH n AS (SELECT match_state, count(*) AS n FROM (SELECT CASE WHEN count(l_orderkey) = 0 THEN 'zero' WHEN count(l_orderkey) = 1 THEN 'one' ELSE 'multiple' END AS match_state, o_orderstatus, o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus) GROUP BY 1)
SELECT match_state, n FROM n
""")
def candidate_summary(t: Tables) -> DataFrame:
    """Orders per match state."""
    linked = quality.candidate_links(t.orders.select("o_orderkey"), t.lineitem.select("l_orderkey"), "o_orderkey", "l_orderkey")
    return linked.groupBy("match_state").agg(F.count("*").alias("n"))


def _document_flags(t: Tables) -> DataFrame:
    docs = quality.repeated_keys(t.documents.select("doc_id", "text", "n_chars", "lang"), ["text"]).join(t.labels, "doc_id", "left")
    rules = {
        "repeated_text": F.col("repeated"),
        "short_text": F.col("n_chars") < 20,
        "label_missing": F.col("quality").isNull(),
        "low_quality": F.coalesce(F.col("quality") == 0, F.lit(False)),
        "toxic": F.coalesce(F.col("toxic") == 1, F.lit(False)),
    }
    return quality.flagged(docs, rules)


FLAGS_SQL = """
WITH d AS (SELECT doc_id, lang, n_chars, quality, toxic, count(*) OVER (PARTITION BY text) > 1 AS rep FROM documents LEFT JOIN labels USING (doc_id)),
f AS (SELECT doc_id, lang, list_filter([CASE WHEN rep THEN 'repeated_text' END, CASE WHEN n_chars < 20 THEN 'short_text' END, CASE WHEN quality IS NULL THEN 'label_missing' END, CASE WHEN quality = 0 THEN 'low_quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS flags FROM d)
"""


@R.add(FLAGS_SQL + "SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM f) GROUP BY flag")
def quality_flags(t: Tables) -> DataFrame:
    """Documents per quality flag."""
    return quality.flag_histogram(_document_flags(t))


@R.add(FLAGS_SQL + "SELECT doc_id, array_to_string(flags, ',') AS flags, len(flags)::INT AS n_flags FROM f")
def flagged_documents(t: Tables) -> DataFrame:
    """Each document with its flags; none is dropped."""
    return _document_flags(t).select("doc_id", F.array_join("quality_flags", ",").alias("flags"), F.size("quality_flags").alias("n_flags"))


@R.add(FLAGS_SQL + """, m(flag, finding_id) AS (VALUES ('repeated_text', 'F-DUP'), ('short_text', 'F-SHORT'), ('label_missing', 'F-LABEL'), ('low_quality', 'F-QUALITY'))
SELECT finding_id, lang, count(DISTINCT doc_id) AS n_documents, min(doc_id) AS first_doc FROM (SELECT doc_id, lang, unnest(flags) AS flag FROM f) JOIN m USING (flag) GROUP BY ALL""")
def finding_occurrences(t: Tables) -> DataFrame:
    """Flags mapped to findings, with how often each occurs."""
    mapping = t.spark.createDataFrame([("repeated_text", "F-DUP"), ("short_text", "F-SHORT"), ("label_missing", "F-LABEL"), ("low_quality", "F-QUALITY")], "flag string, finding_id string")
    rows = _document_flags(t).select("doc_id", "lang", F.explode("quality_flags").alias("flag")).join(F.broadcast(mapping), "flag")
    return rows.groupBy("finding_id", "lang").agg(F.count_distinct("doc_id").alias("n_documents"), F.min("doc_id").alias("first_doc"))


@R.add("SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS repeated FROM documents")
def repeated_keys(t: Tables) -> DataFrame:
    """Whether a document's text occurs again."""
    return quality.repeated_keys(t.documents.select("doc_id", "text"), ["text"]).select("doc_id", "repeated")


@R.add("""
WITH s AS (SELECT event_id, ts, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y') WHEN 1 THEN strftime(ts, '%Y%m%d') WHEN 2 THEN strftime(ts, '%-m/%-d/%Y') WHEN 3 THEN '' WHEN 4 THEN strftime(ts, '%Y') || '1345' ELSE '13/' || strftime(ts, '%-d/%Y') END AS raw FROM events),
p AS (SELECT raw, regexp_matches(raw, '^[1-9][0-9]{3}$') AS y, coalesce(CASE WHEN regexp_matches(raw, '^[0-9]{8}$') THEN try_strptime(raw, '%Y%m%d') END, CASE WHEN regexp_matches(raw, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') THEN try_strptime(raw, '%m/%d/%Y') END) AS d FROM s)
SELECT CASE WHEN y OR d IS NOT NULL THEN 'DERIVED' ELSE 'UNKNOWN' END AS state, CASE WHEN y THEN 'year' WHEN d IS NOT NULL THEN 'day' ELSE 'none' END AS precision, CASE WHEN trim(raw) = '' THEN 'missing' WHEN NOT y AND d IS NULL THEN 'malformed_or_uninterpreted' ELSE 'none' END AS reason, count(*) AS n FROM p GROUP BY ALL
""")
def date_profile(t: Tables) -> DataFrame:
    """States of dates of mixed form."""
    ts = F.col("ts")
    forms = F.pmod("event_id", F.lit(6))
    raw = (
        F.when(forms == 0, F.date_format(ts, "yyyy")).when(forms == 1, F.date_format(ts, "yyyyMMdd")).when(forms == 2, dates.unpadded(ts)).when(forms == 3, "")
        .when(forms == 4, F.concat(F.date_format(ts, "yyyy"), F.lit("1345"))).otherwise(F.concat(F.lit("13/"), F.date_format(ts, "d/yyyy")))
    )
    return quality.state_profile(t.events.select("event_id", raw.alias("raw")), dates.parse_date(F.col("raw")))


@R.add("""
SELECT 'documents' AS kind, 'quality' AS field, count(*) AS n_rows, count(*) - count(quality) AS n_null, 0::BIGINT AS n_blank FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'documents', 'toxic', count(*), count(*) - count(toxic), 0 FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'documents', 'lang', count(*), count(*) - count(lang), coalesce(sum((trim(lang) = '')::INT), 0) FROM documents
UNION ALL SELECT 'orders', 'l_linenumber', count(*), count(*) - count(l_linenumber), 0 FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
""")
def null_profile(t: Tables) -> DataFrame:
    """Nulls and blanks per field after outer joins."""
    docs = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    lines = t.orders.select("o_orderkey").join(t.lineitem.select("l_orderkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return quality.null_profile(docs, ["quality", "toxic", "lang"], "documents").unionByName(quality.null_profile(lines, ["l_linenumber"], "orders"))


@R.add("""
WITH f AS (SELECT o_orderkey, o_orderstatus, bool_or(coalesce(l_returnflag = 'A', false)) AS a, bool_or(coalesce(l_returnflag = 'N', false)) AS n, bool_or(coalesce(l_returnflag = 'R', false)) AS r FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT o_orderstatus, count(*) FILTER (a) AS in_a, count(*) FILTER (n) AS in_n, count(*) FILTER (r) AS in_r, count(*) FILTER (a AND n AND r) AS in_all, count(*) FILTER (a OR n OR r) AS in_any, count(*) FILTER (NOT (a OR n OR r)) AS in_none FROM f GROUP BY 1
""")
def presence_matrix(t: Tables) -> DataFrame:
    """Orders that each return flag holds, per status."""
    lines = t.lineitem.select("l_orderkey", "l_returnflag")
    sources = {k.lower(): (lines.filter(F.col("l_returnflag") == k), "l_orderkey") for k in ("A", "N", "R")}
    return quality.presence_matrix(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", sources, "o_orderkey")


@R.add("""
WITH b AS (SELECT n_name, c_custkey AS parent, o_orderkey AS cand FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'),
p AS (SELECT n_name, parent, count(cand) AS n FROM b GROUP BY ALL), s AS (SELECT n_name, count(*) FILTER (k > 1) AS shared FROM (SELECT n_name, cand, count(DISTINCT parent) AS k FROM b WHERE cand IS NOT NULL GROUP BY ALL) GROUP BY 1)
SELECT n_name, count(*) FILTER (n = 0) AS zero, count(*) FILTER (n = 1) AS one, count(*) FILTER (n > 1) AS multiple, coalesce(any_value(shared), 0)::BIGINT AS shared_candidates FROM p LEFT JOIN s USING (n_name) GROUP BY n_name
""")
def candidate_buckets(t: Tables) -> DataFrame:
    """Customers of each nation by number of urgent orders."""
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    links = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left")
    return quality.candidate_buckets(links.select("n_name", "c_custkey", "o_orderkey"), "n_name", "c_custkey", "o_orderkey")


@R.add("""
WITH r AS (SELECT l_returnflag, l_orderkey, l_partkey, l_suppkey, l_linenumber, sha256(concat_ws('|', '=' || l_orderkey, '=' || l_quantity::INT, '=' || l_linestatus)) AS d FROM lineitem)
SELECT l_returnflag, count(*) AS n_rows, sha256(string_agg(concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) || ':' || d || chr(10), '' ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, d)) AS fingerprint FROM r GROUP BY 1
""")
def manifest_fingerprint(t: Tables) -> DataFrame:
    """Ordered fingerprint of the lines of each return flag."""
    rows = t.lineitem.withColumn("q", F.col("l_quantity").cast("int")).select("l_returnflag", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", digest.row_digest(["l_orderkey", "q", "l_linestatus"]).alias("d"))
    return digest.ordered_fingerprint(rows, ["l_returnflag"], ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "d")


@R.add("SELECT n_regionkey, count(DISTINCT n_name) AS n_values, sha256(array_to_string(list_sort(list_distinct(list(sha256(n_name)))), ',')) AS fingerprint FROM nation GROUP BY 1")
def set_fingerprint(t: Tables) -> DataFrame:
    """Fingerprint of the set of hashed names of each region."""
    return digest.set_fingerprint(t.nation.select("n_regionkey", digest.sha256(F.col("n_name")).alias("h")), ["n_regionkey"], "h")


@R.add("SELECT o_orderkey, sha256(o_custkey || ':' || o_orderstatus || ':' || o_orderpriority) AS observation_id FROM orders")
def composite_identity(t: Tables) -> DataFrame:
    """Content-addressed identity of each order."""
    return t.orders.select("o_orderkey", digest.composite_id("o_custkey", "o_orderstatus", "o_orderpriority").alias("observation_id"))


@R.add("""SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS document, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation""")
def canonical_documents(t: Tables) -> DataFrame:
    """Canonical JSON of each nation and its digest."""
    doc = digest.canonical_struct(["n_nationkey", "n_name", "n_regionkey"])
    return t.nation.select("n_nationkey", doc.alias("document"), digest.sha256(doc).alias("digest"))


@R.add("SELECT lang, count(*) AS n, count(DISTINCT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS n_forms FROM documents GROUP BY 1")
def regex_normalize(t: Tables) -> DataFrame:
    """Texts and their white-space-normal forms per language."""
    form = digest.sha256(scalars.squeezed(F.col("text")))
    return t.documents.select("lang", form.alias("f")).groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("f").alias("n_forms"))


@R.add("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(t: Tables) -> DataFrame:
    """Events per type and property."""
    return t.events.select("event_type", scalars.field(F.col("props"), "k").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@R.add("""
SELECT conv_id, count(*) AS n_turns, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, array_to_string(list(role || ':' || length(text) ORDER BY turn, role, length(text)), ' ') AS turns FROM conversations GROUP BY 1
""")
def turn_profile(t: Tables) -> DataFrame:
    """Nested roll-up of each conversation."""
    turn = F.struct("turn", "role", F.length("text").alias("n"))
    turns = F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.concat(x["role"], F.lit(":"), x["n"].cast("string")))
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.array_join(turns, " ").alias("turns"))


@R.add("""
WITH v AS (SELECT doc_id, lang, source, count(*) OVER (PARTITION BY nullif(lang, ''), nullif(source, '')) AS n FROM documents)
SELECT doc_id, n, n = 1 AS exactly_one FROM v
""")
def reference_match(t: Tables) -> DataFrame:
    """How many variants equal each document's reference fields, blank being the same as null."""
    blank_null = lambda c: F.nullif(F.col(c), F.lit(""))
    keyed = t.documents.select("doc_id", blank_null("lang").alias("a"), blank_null("source").alias("b"))
    counts = keyed.groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(F.count("*").alias("n"))
    return keyed.join(counts, F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("_b"))).select("doc_id", "n", (F.col("n") == 1).alias("exactly_one"))


@R.add("""
SELECT o_orderkey, rule FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN NOT (o_totalprice > 1000) THEN 'price_floor' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status_closed_set' END, CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-3]-') THEN 'priority_form' END], lambda x: x IS NOT NULL)) AS rule FROM orders)
""")
def contract_violations(t: Tables) -> DataFrame:
    """Orders that break a column contract."""
    rules = {"price_floor": F.col("o_totalprice") > 1000, "status_closed_set": F.col("o_orderstatus").isin("F", "O"), "priority_form": F.col("o_orderpriority").rlike("^[1-3]-")}
    return quality.violations(t.orders, ["o_orderkey"], rules)


@R.add("""
SELECT n_nationkey, '31020_' || substr('31030_' || n_nationkey, 7) AS swapped, '31030' AS head, lower(trim('  ' || n_name || ' ')) = lower(r_name) AS same, strftime(make_timestamp(n_nationkey * 86400000000), '%-m/%-d/%Y') AS day
FROM nation JOIN region ON r_regionkey = n_regionkey
""")
def code_functions(t: Tables) -> DataFrame:
    """Prefix swap, head part, name equality and unpadded dates."""
    code = F.concat(F.lit("31030_"), F.col("n_nationkey").cast("string"))
    named = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select("n_nationkey", scalars.swap_prefix(code, "31030_", "31020_").alias("swapped"), scalars.head_part(code).alias("head"), scalars.same_name(F.concat(F.lit("  "), "n_name", F.lit(" ")), F.col("r_name")).alias("same"), dates.unpadded(dates.from_epoch_millis(F.col("n_nationkey").cast("long") * 86400000)).alias("day"))


@R.add("""
WITH h AS (SELECT page_id, regexp_extract_all(html, 'href\\s*=\\s*["'']([^"''#]+)', 1) AS links FROM pages)
SELECT page_id, len(links)::INT AS n_links, (SELECT count(DISTINCT x) FROM (SELECT unnest(links) AS x))::INT AS n_distinct FROM h
""")
def html_links(t: Tables) -> DataFrame:
    """Links of each raw page."""
    links = F.regexp_extract_all("html", F.lit("href\\s*=\\s*[\"']([^\"'#]+)"), F.lit(1))
    return t.pages.select("page_id", links.alias("l")).select("page_id", F.size("l").alias("n_links"), F.size(F.array_distinct("l")).alias("n_distinct"))


@R.add("""
SELECT epoch_ms(ts) // 86400000 * 86400000 AS raw, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL
""")
def epoch_histogram(t: Tables) -> DataFrame:
    """Events per epoch day with its UTC rendering."""
    day = (F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 86400000) * 86400000).cast("long")
    return t.events.select(day.alias("raw")).groupBy("raw").agg(F.count("*").alias("n")).select("raw", F.date_format(dates.from_epoch_millis(F.col("raw")), "yyyy-MM-dd").alias("day"), "n")


@R.add("""
SELECT n_name, count(*) AS n_customers, count(*) FILTER (c_acctbal < 0) AS n_negative, bool_and(c_acctbal > -1000) AS all_sound, bool_or(c_acctbal > 9900) AS any_rich, min(c_acctbal) AS lowest, max(c_acctbal) AS highest, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1
""")
def jurisdiction_rollup(t: Tables) -> DataFrame:
    """Counts, ranges and nested lists per nation."""
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(
        F.count("*").alias("n_customers"), F.count_if(F.col("c_acctbal") < 0).alias("n_negative"), F.bool_and(F.col("c_acctbal") > -1000).alias("all_sound"),
        F.bool_or(F.col("c_acctbal") > 9900).alias("any_rich"), F.min("c_acctbal").alias("lowest"), F.max("c_acctbal").alias("highest"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"),
    )
