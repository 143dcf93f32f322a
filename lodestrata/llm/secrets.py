"""Secret scans over an incremental blob ledger (DataFrame functions only).

Every historical version of every path is addressed by the SHA-256 of its text. The ledger holds the
(blob, rule_version) pairs scanned so far with their findings. A run scans only the pairs that it lacks, one
copy of each blob and only with the rule versions that the blob has not met, returns those entries to be
appended, and joins the findings of all its rule versions back to all paths that ever held the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import let

SPAN = "array<struct<start:int, kind_no:int, kind:string, end:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if their ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hint: str = ""  # a cheaper pattern that every counting match contains


# The kinds in the order in which results list them. Runs of one character class are
# found with their least length in the pattern, which gives the same spans as dropping the short ones.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Rules that the method adds: findings beside the base ones, in a rule version of their own.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("bearer", r"(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{20,}"),
    Rule("url", r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]{1,256}:[^\s:/@]{1,256}@"),
)
RULE_VERSIONS = {"base-1": RULES, "more-1": MORE_RULES}
PIECES = 128  # matches whose offsets are summed up at once


def blob_id(text: Column) -> Column:
    """Content address of a text; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _rule_spans(text: Column, number: int, rule: Rule) -> Column:
    """Spans of one rule. The pieces between the matches and the matches themselves give the offsets.

    Offsets are summed within short runs of pieces, then over the runs, so that a text with very many matches
    costs little more than its length.
    """
    gaps = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), value, lambda p, v: F.struct(p["g"].alias("g"), p["m"].alias("m"), F.length(v).alias("v")))
    empty = F.expr(f"cast(array() as {SPAN})")

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + piece["g"]
        end = start + F.coalesce(piece["m"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = piece["m"].isNotNull() & (piece["v"] >= rule.least)
        return F.struct(end.alias("at"), F.when(kept, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def runs(ps: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / PIECES).cast("int")), lambda k: F.slice(ps, k * PIECES + 1, PIECES))

    def from_runs(rs: Column) -> Column:
        size = lambda r: F.aggregate(r, F.lit(0), lambda n, p: n + p["g"] + F.coalesce(p["m"], F.lit(0)))
        begins = F.aggregate(F.transform(rs, size), F.array(F.lit(0)), lambda b, n: F.concat(b, F.array(F.element_at(b, -1) + n)))
        of_run = lambda r, begin: F.aggregate(r, F.struct(begin.alias("at"), empty.alias("out")), step, lambda state: state["out"])
        return let(begins, lambda b: F.flatten(F.transform(rs, lambda r, k: of_run(r, F.get(b, k)))))

    spans = let(let(pieces, runs), from_runs)
    return F.when(text.rlike(rule.hint or rule.pattern), spans).otherwise(empty)


def spans_of(text: Column, rules=RULES, first: int = 0) -> Column:
    """All spans of a text by start, then by the order of the rules; offsets in code points, end exclusive."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(_rule_spans(text, first + n, rule) for n, rule in enumerate(rules))))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(versions: DataFrame, ledger: DataFrame | None = None, rule_versions: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger has not seen.

    ``versions`` has ``path`` and ``text``, a row for each version that a path ever had; further columns are
    ignored. ``rule_versions`` names sets of rules (default: the base rules). Returns (paths, entries): paths
    has a row for each row of ``versions`` with ``path``, ``blob`` and ``spans`` (of all these rule versions, by
    start, then by the order of the rules); entries has (blob, rule_version, spans) of the pairs scanned now, to
    be appended to the ledger. A null text is the empty text, very long texts are scanned whole, null and
    repeated paths are kept, an empty table gives empty tables.
    """
    rule_versions = rule_versions or {"base-1": RULES}
    versions = versions.select("path", "text", blob_id(F.col("text")).alias("blob"))
    holders = versions.groupBy("blob").agg(F.min(F.struct(F.col("path").isNull(), F.col("path"))).alias("_first"))
    every = F.array(*[F.lit(v) for v in rule_versions])
    if ledger is None:
        holders = holders.withColumn("_todo", every)
    else:
        seen = ledger.filter(F.col("rule_version").isin(list(rule_versions)))
        met = seen.groupBy("blob").agg(F.collect_set("rule_version").alias("_met"))
        holders = holders.join(met, "blob", "left").withColumn("_todo", F.array_except(every, F.coalesce("_met", F.array().cast("array<string>"))))
        holders = holders.filter(F.size("_todo") > 0)
    # One holder of each unseen blob: the texts are dealt by path, which is even, and streamed past the ids.
    holders = holders.select(F.col("blob").alias("_blob"), F.col("_first.path").alias("_path"), "_todo").hint("shuffle_hash")
    once = versions.join(holders, F.col("path").eqNullSafe(F.col("_path")) & (F.col("blob") == F.col("_blob")))
    first, results = 0, []
    for name, rules in rule_versions.items():
        results.append(F.when(F.array_contains("_todo", name), F.struct(F.lit(name).alias("rule_version"), spans_of(F.col("text"), rules, first).alias("spans"))))
        first += len(rules)
    # A path may hold the same blob more than once: equal entries meet.
    entries = once.select("blob", F.explode(F.array_compact(F.array(*results))).alias("e")).select("blob", "e.rule_version", "e.spans").dropDuplicates(["blob", "rule_version"])
    known = entries if ledger is None else entries.unionByName(seen.select("blob", "rule_version", "spans"))
    found = known.filter(F.size("spans") > 0).groupBy("blob").agg(F.collect_list("spans").alias("_all"))
    found = found.select(F.col("blob").alias("_blob"), F.array_sort(F.flatten("_all")).alias("spans"))
    empty = F.expr(f"cast(array() as {SPAN})")
    paths = versions.select("path", "blob").join(found, F.col("blob") == F.col("_blob"), "left")
    return paths.select("path", "blob", F.coalesce("spans", empty).alias("spans")), entries
