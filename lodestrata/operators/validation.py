"""Contracts of what is appended: events, payloads, requests, proposals and record trees.

A validator is a column of fault names (empty: nothing is wrong) or a table of faults, so that a batch is
judged as a whole and refused with reasons; nothing is repaired.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import variants
from lodestrata.functions.scalars import is_blank
from lodestrata.geometry import frames

SHA256 = r"^[0-9a-f]{64}\z"
# Fixed values of the review log.
FINDING_ID = r"^TL-F-[0-9]{4}\z"
STATUSES = ("open", "in_progress", "blocked", "deferred", "resolved")
PRIORITIES = ("high", "medium", "low")
REVIEW_FIELDS = ("event_id", "correction_id", "status", "actor", "note")
SOIL_BATCH = "b31e3034caee9f70361bb9c769b936b8709fcab38706f89cdee22c9265aad512"
PARCEL_SOURCES = ("ut-parcels", "organized-parcels")


def faults(**rules: Column) -> Column:
    """Names of the rules that are broken: a rule is a condition that must hold; null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))


def finding_event_faults() -> Column:
    """Faults of an event row: finding_id, expected_event_id, status, priority, next_action, actor, note, evidence_refs."""
    refs = F.col("evidence_refs")
    sound = F.coalesce(F.forall(refs, lambda r: ~is_blank(r)), F.lit(True))
    return faults(
        finding_id=F.col("finding_id").rlike(FINDING_ID), expected_event=F.col("expected_event_id").rlike(SHA256), status=F.col("status").isin(*STATUSES), priority=F.col("priority").isin(*PRIORITIES),
        review_text=~is_blank(F.col("next_action")) & ~is_blank(F.col("actor")) & ~is_blank(F.col("note")), evidence_text=sound,
        resolution_without_evidence=(F.col("status") != "resolved") | (F.coalesce(F.size(refs), F.lit(0)) > 0),
    )


def has_exact_keys(json_text: Column, names: tuple[str, ...] = REVIEW_FIELDS) -> Column:
    """Whether a text is an object with these keys and no others."""
    keys = F.json_object_keys(json_text)
    return F.coalesce((F.size(keys) == len(names)) & (F.size(F.array_except(F.array(*map(F.lit, names)), keys)) == 0), F.lit(False))


def request_faults(request: Column, parsed: Column | None = None) -> Column:
    """Faults of a qualification request: digests, soils, an explicit Boolean, and either an area or a parcel, not both.

    Values are judged by their JSON types: "true" is no Boolean and "12" no number. An area is a Polygon or MultiPolygon of
    closed, simple rings of two finite coordinates each, holes within their shells, in degrees. ``parsed``: the request by
    ``variants.parsed`` as a column of its own, so that a row is not parsed for each value.
    """
    v = variants.parsed(request) if parsed is None else parsed
    has = lambda name: variants.at(v, f"$.{name}").isNotNull()
    sha = lambda path: variants.is_text(v, path, SHA256)
    shape = variants.at(v, "$.geometry.type", "string")
    rings, parts = variants.at(v, "$.geometry.coordinates", frames.RINGS), variants.at(v, "$.geometry.coordinates", frames.REGION)
    region = F.when(shape == "Polygon", F.array(rings)).when(shape == "MultiPolygon", parts)
    points = F.flatten(F.flatten(region))
    flat = F.forall(points, lambda p: F.size(p) == 2) & ~F.schema_of_variant(variants.at(v, "$.geometry.coordinates")).rlike("STRING|BOOLEAN|VARIANT")
    usable = F.coalesce(flat & (F.size(points) > 0), F.lit(False))
    area = usable & frames.region_reason(F.when(usable, region)).isNull()
    degrees = F.forall(points, lambda p: (F.abs(F.get(p, F.lit(0))) <= 180) & (F.abs(F.get(p, F.lit(1))) <= 90))
    soils = variants.keys_are(F.get_json_object(request, "$.soils"), ["batch", "snapshot"]) & (variants.at(v, "$.soils.batch", "string") == SOIL_BATCH) & sha("$.soils.snapshot")
    parcel = variants.at(v, "$.source_id", "string").isin(*PARCEL_SOURCES) & (variants.kind_of(v, "$.object_id") == "BIGINT") & (variants.at(v, "$.object_id", "long") >= 0)
    return faults(
        audit=sha("$.audit"), snapshot=sha("$.snapshot"), soils=~has("soils") | soils, purchase_candidate=variants.kind_of(v, "$.purchase_candidate") == "BOOLEAN",
        one_selection=~(has("geometry") & (has("source_id") | has("object_id"))), area=~has("geometry") | area,
        lon_lat=~has("geometry") | F.coalesce(degrees, F.lit(True)), parcel=has("geometry") | parcel,
    )


def proposal_faults(proposals: DataFrame, sources: DataFrame, key: list[str]) -> DataFrame:
    """Add ``faults`` to geometry proposals: what a proposal must share with the reviewed source before it is stored.

    ``proposals``: key, source_sha256, candidate_sha256, candidate_text, status, evidence_state, correction_id, rings;
    ``sources``: key, text, rings. A proposal is of this very source text, names its own digest and identity, is
    proposed and not accepted, and has the segments of the source, each as often.
    """
    named = sources.select(*[F.col(k).alias(f"_{k}") for k in key], F.sha2("text", 256).alias("_sha"), segment_counts(F.col("rings")).alias("_segments"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in key])
    identity = F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.col("candidate_sha256")), 256)
    checks = faults(
        source=F.col("_sha").isNotNull(), source_sha256=F.col("source_sha256") == F.col("_sha"), candidate_sha256=F.col("candidate_sha256") == F.sha2("candidate_text", 256),
        status=F.col("status") == "proposed_not_accepted", evidence_state=F.col("evidence_state") == "DERIVED", correction_id=F.col("correction_id") == identity, segments=segment_counts(F.col("rings")) == F.col("_segments"),
    )
    return proposals.join(named, same, "left").select(*proposals.columns, checks.alias("faults"))


def segment_counts(rings: Column) -> Column:
    """The undirected segments of rings with multiplicity, sorted: rings with equal ones have the same edges."""
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))

    def of_ring(ring: Column) -> Column:
        ends = F.arrays_zip(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))).alias("a"), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))).alias("b"))
        return F.transform(ends, lambda s: F.array_sort(F.array(point(s["a"]), point(s["b"]))))

    return F.array_sort(F.flatten(F.transform(rings, of_ring)))


def tree_faults(levels: list[tuple[str, DataFrame, str, str | None]], expected: dict[str, int] | None = None) -> DataFrame:
    """Faults (level, fault, n) of a tree of records given as (name, rows, key, parent key), the root first.

    A key is there and unique; a parent is there; a level has as many rows as announced. Levels that are sound
    have no row. Keys are counted before they are joined, so a hot parent is one row.
    """
    found, above = [], None
    for name, rows, key, parent in levels:
        keys = rows.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n"))
        parts = [keys.filter("_k is null").agg(F.lit("missing_key").alias("fault"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n")), keys.filter("_k is not null and _n > 1").agg(F.lit("repeated_key").alias("fault"), F.count("*").alias("n"))]
        if parent is not None and above is not None:
            links = rows.groupBy(F.col(parent).alias("_p")).agg(F.count("*").alias("_n"))
            parts.append(links.join(above, F.col("_p") == F.col("_a"), "left_anti").agg(F.lit("missing_parent").alias("fault"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n")))
        if expected and name in expected:
            parts.append(keys.agg(F.lit("row_count").alias("fault"), F.abs(F.coalesce(F.sum("_n"), F.lit(0)) - expected[name]).alias("n")))
        found += [p.select(F.lit(name).alias("level"), "fault", F.col("n").cast("long").alias("n")) for p in parts]
        above = keys.filter("_k is not null").select(F.col("_k").alias("_a"))
    return reduce(DataFrame.unionByName, found).filter("n > 0")


def one_to_one(pairs: DataFrame, left: str, right: str, qualified: Column) -> DataFrame:
    """Qualified pairs in which either side has no other qualified partner; a tie qualifies nobody."""
    good = pairs.filter(qualified).select(left, right).distinct()
    single = lambda side: good.groupBy(side).agg(F.count("*").alias("_n")).filter("_n = 1").select(side)
    return good.join(single(left), left).join(single(right), right).select(left, right)
