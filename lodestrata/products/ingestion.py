"""Ingestion batches: records classified with quality flags, and inventories of what a batch holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.dates import MISSING, parse_date
from lodestrata.functions.digest import composite_id, ordered_fingerprint
from lodestrata.functions.scalars import is_blank, stripped

# The kinds of records, and the quality flags in the order in which a record lists them.
GEOMETRY, TABULAR = "assessment_geometry", "assessment"
FLAGS = (
    "blank_jurisdiction", "unrecognized_jurisdiction", "code_name_conflict", "missing_candidate_key", "repeated_candidate_key_in_batch", "missing_global_id", "missing_source_date", "uninterpreted_source_date",
    "source_overlap_unresolved", "assessment_date_semantics", "assessment_no_match", "assessment_multiple_candidates", "assessment_geocode_disagreement",
)


def classified(records: DataFrame, reference: DataFrame, overlap: DataFrame, batch_id: str, linked_source: str) -> DataFrame:
    """Records with record_id, parsed_date, candidate_count and quality_flags.

    ``records``: source_id, object_id, global_id, code, name, candidate_key, record_kind, raw_date; ``reference``:
    code, common_name; ``overlap``: codes that several sources cover. Records of ``linked_source`` are matched with
    the tabular records of the same key. Keys and (key, code) pairs are counted before they are joined, so a key
    that very many records share is one row, and links are never pairs.
    """
    key = F.when(~is_blank(F.col("candidate_key")), F.col("candidate_key"))
    rows = records.withColumn("_key", key)
    repeats = rows.filter("_key is not null").groupBy(F.col("source_id").alias("_rs"), F.col("_key").alias("_rk")).agg(F.count("*").alias("_repeats"))
    table = rows.filter((F.col("record_kind") == TABULAR) & F.col("_key").isNotNull())
    matches = table.groupBy(F.col("_key").alias("_mk")).agg(F.count("*").alias("_matches"))
    agreeing = table.filter(F.col("code").isNotNull()).groupBy(F.col("_key").alias("_ak"), F.col("code").alias("_ac")).agg(F.count("*").alias("_agree"))
    known = reference.select(F.col("code").alias("_code"), F.lower(stripped(F.col("common_name"))).alias("_name")).dropDuplicates(["_code"])
    shared = overlap.select(F.col("code").alias("_shared")).distinct()
    joined = (
        rows.join(repeats, (F.col("source_id") == F.col("_rs")) & (F.col("_key") == F.col("_rk")), "left")
        .join(matches, F.col("_key") == F.col("_mk"), "left").join(agreeing, (F.col("_key") == F.col("_ak")) & (F.col("code") == F.col("_ac")), "left")
        .join(known, F.col("code") == F.col("_code"), "left").join(shared, F.col("code") == F.col("_shared"), "left")
    )
    blank, geometry = is_blank(F.col("code")), F.col("record_kind") == GEOMETRY
    recognized = F.col("_code").isNotNull()
    linked, n = F.col("source_id") == linked_source, F.coalesce("_matches", F.lit(0))
    agree = F.when(blank, F.lit(0)).otherwise(F.coalesce("_agree", F.lit(0)))
    date = parse_date(F.col("raw_date"))
    unverified = F.struct(*[F.when(geometry, date[c]).alias(c) if c not in ("raw", "state", "reason") else F.when(geometry, date[c]).otherwise({"raw": F.col("raw_date").cast("string"), "state": F.lit("UNKNOWN"), "reason": F.lit("field_semantics_unverified")}[c]).alias(c) for c in ("raw", "precision", "value", "state", "reason", "year")])
    rules = dict(zip(FLAGS, (
        blank, ~blank & ~recognized, recognized & geometry & (F.lower(stripped(F.coalesce("name", F.lit("")))) != F.col("_name")), F.col("_key").isNull(), F.col("_repeats") > 1, is_blank(F.col("global_id")),
        geometry & (date["reason"] == MISSING), geometry & (date["state"] == "UNKNOWN") & (date["reason"] != MISSING), geometry & F.col("_shared").isNotNull(), ~geometry,
        linked & (n == 0), linked & (n > 1), linked & (n > agree),
    ), strict=True))
    flags = F.array_compact(F.array(*[F.when(rule, F.lit(flag)) for flag, rule in rules.items()]))
    return joined.select(*records.columns, composite_id(F.lit(batch_id), F.col("source_id"), F.col("object_id")).alias("record_id"), unverified.alias("parsed_date"), F.when(linked, n).alias("candidate_count"), flags.alias("quality_flags"))


def inventory(rows: DataFrame, digest: str = "digest") -> DataFrame:
    """A manifest row for each source of ``rows`` (source_id, object_id, digest, hold, scope_relation): counts by relation,
    records held, and the fingerprint of all records in the order of their ids."""
    relation = lambda r: F.count_if(F.col("scope_relation") == r).alias(f"n_{r}")
    counts = rows.groupBy("source_id").agg(relation("interior"), relation("touch"), relation("outside"), F.count_if(F.col("hold").isNotNull()).alias("n_held"))
    prints = ordered_fingerprint(rows, ["source_id"], ["object_id"], digest)
    return counts.join(prints, "source_id").select("source_id", "n_rows", "n_interior", "n_touch", "n_outside", "n_held", "fingerprint")


def recomputed(before: DataFrame, after: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """What a recomputation changed: key, change (added, removed or changed) and the metrics before and after.

    Subjects must stay the same, so added and removed ones are faults; equal results have no row.
    """
    old = before.select(*[F.col(k).alias(f"_{k}") for k in key], *[F.col(m).alias(f"{m}_before") for m in metrics], F.lit(True).alias("_old"))
    new = after.select(*key, *[F.col(m).alias(f"{m}_after") for m in metrics], F.lit(True).alias("_new"))
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key])
    both = new.join(old, match, "full_outer")
    differ = reduce(lambda a, b: a | b, [~F.col(f"{m}_before").eqNullSafe(F.col(f"{m}_after")) for m in metrics])
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(differ, "changed")
    return both.select(*[F.coalesce(k, f"_{k}").alias(k) for k in key], change.alias("change"), *[f"{m}_{w}" for m in metrics for w in ("before", "after")]).filter("change is not null")


def page_faults(pages: DataFrame, ids: DataFrame, page_size: int) -> DataFrame:
    """Faults (fault, page_no, object_id, n) of a collection by pages; a sound one has no row.

    ``pages``: page_no, object_id (a row an object as it came); ``ids``: object_id (what the service announced). An object comes once, a
    page is full unless it is the last one, none is larger than ``page_size``, and what came is what was announced.
    """
    came = pages.groupBy("object_id").agg(F.count("*").alias("n"), F.min("page_no").alias("page_no"))
    announced = ids.select(F.col("object_id").alias("_id")).distinct()
    both = came.join(announced, F.col("object_id") == F.col("_id"), "full_outer")
    kind = F.when(F.col("object_id").isNull(), "missing").when(F.col("_id").isNull(), "unexpected")
    none = F.lit(None)
    members = both.filter(kind.isNotNull()).select(kind.alias("fault"), F.col("page_no").cast("long").alias("page_no"), F.coalesce("object_id", "_id").cast("long").alias("object_id"), F.lit(1).cast("long").alias("n"))
    twice = came.filter("n > 1").select(F.lit("repeated").alias("fault"), F.col("page_no").cast("long").alias("page_no"), F.col("object_id").cast("long").alias("object_id"), "n")
    sizes = pages.groupBy("page_no").agg(F.count("*").alias("n"))
    last = sizes.agg(F.max("page_no").alias("_last"))  # one row
    odd = F.when(F.col("n") > page_size, "too_long").when((F.col("n") < page_size) & (F.col("page_no") < F.col("_last")), "short")
    judged = sizes.join(F.broadcast(last)).withColumn("fault", odd).filter("fault is not null")
    return members.unionByName(twice).unionByName(judged.select("fault", F.col("page_no").cast("long").alias("page_no"), none.cast("long").alias("object_id"), "n"))


def candidate_rows(records: DataFrame, linked_source: str) -> DataFrame:
    """(key, n_records, n_candidates): what a batch stores of links, one row a key and never a pair.

    ``records`` as for ``classified``: the records of ``linked_source`` and the tabular records that share a key that is not blank.
    """
    key = F.when(~is_blank(F.col("candidate_key")), F.col("candidate_key"))
    rows = records.select(key.alias("key"), (F.col("source_id") == linked_source).alias("_own"), (F.col("record_kind") == TABULAR).alias("_table")).filter("key is not null")
    sums = rows.groupBy("key").agg(F.count_if("_own").alias("n_records"), F.count_if("_table").alias("n_candidates"))
    return sums.filter("n_records > 0 and n_candidates > 0")


def lineage(rows: DataFrame, stages: list[str], digest: str) -> DataFrame:
    """A row for each combination of ``stages`` (columns that say where a record came from): n_rows and an order-free identity.

    Two inventories rest on the same records if their identities agree, whatever the order or the partitioning.
    """
    from lodestrata.functions.digest import tree_fingerprint

    return tree_fingerprint(rows, stages, digest)
