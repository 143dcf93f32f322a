"""Area qualification: what each topic's sources show for each area, with reasons and never a verdict."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.geometry import planar
from lodestrata.geometry.frames import REGION, _region, shape_id, shapes, stand_in, with_bounds
from lodestrata.operators.boxes import box_pairs

# What a topic can never establish from inventories alone.
STANDING_REASONS = {
    "identity": ("canonical_identity_unresolved", "assessment_boundary_not_surveyed", "source_currentness_unverified"),
    "zoning": ("current_legal_applicability_unverified", "municipal_zoning_not_loaded"),
    "wetlands": ("imagery_age_and_completeness_unverified_for_site", "inventory_absence_not_wetland_clearance"),
}
TOPIC = "shape string, topic string, n_interior int, n_touch int, n_held int, coverage string, uncovered double, fraction double, basis string"


def qualify(aois: DataFrame, features: DataFrame, topics: DataFrame, size: float) -> DataFrame:
    """One row for each area and topic.

    ``aois``: aoi_id, region, within_scope, snapshot_current. ``features``: source_id, object_id, region, hold,
    held_bounds (xmin, ymin, xmax, ymax of a held geometry, null if unknown). ``topics``: topic, source_id.
    A held feature counts where its bounds meet the area, and everywhere if they are unknown. Areas without
    evidence have a row too: missing is a state, not an absence.
    """
    # Areas with equal regions share their answer, and equal features of a source meet an area once.
    named = aois.select("aoi_id", "within_scope", "snapshot_current", "region", shape_id().alias("shape"))
    areas = shapes(named)
    bounds = ("xmin", "ymin", "xmax", "ymax")
    sound = with_bounds(shapes(features.filter("hold is null").select("source_id", "region", shape_id().alias("shape")), "source_id")).withColumn("hold", F.lit(False))
    boxes = features.filter("hold is not null and held_bounds is not null").groupBy("source_id", F.struct(*[F.col(f"held_bounds.{c}").alias(c) for c in bounds]).alias("box")).agg(F.count("*").alias("n"))
    held = boxes.select("source_id", F.to_json("box").alias("shape"), F.lit(None).cast(REGION).alias("region"), "n", "box.*", F.lit(True).alias("hold"))
    known = sound.unionByName(held).withColumn("fid", F.to_json(F.struct("source_id", "shape", "hold")))
    pairs = box_pairs(with_bounds(areas), known, "shape", "fid", size).select(F.col("a_id").alias("shape"), F.col("b_id").alias("fid"))
    met = pairs.join(known.select("fid", "source_id", "n", F.coalesce("region", stand_in()).alias("f"), "hold"), "fid").join(topics, "source_id")
    met = met.join(areas.select("shape", F.col("region").alias("a")), "shape")

    def one(key, frame: pd.DataFrame) -> pd.DataFrame:
        area = _region(frame["a"].iloc[0])
        there = frame[~frame["hold"]]
        regions = [_region(f) for f in there["f"]]
        shared = planar.areas_of_pairs([(region, area) for region in regions])["both"] > 0
        inside = [region for region, yes in zip(regions, shared, strict=True) if yes]
        n_inside = sum(int(n) for n, yes in zip(there["n"], shared, strict=True) if yes)
        touch = sum(int(n) for region, n, yes in zip(regions, there["n"], shared, strict=True) if not yes and planar.touches_or_crosses(region, area))
        c = planar.coverage(inside, area)
        return pd.DataFrame([(*key, n_inside, touch, int(frame["n"][frame["hold"]].sum()), c["state"], c["uncovered"], c["fraction"], c["basis"])], columns=[x.split()[0] for x in TOPIC.split(", ")])

    found = met.groupBy("shape", "topic").applyInPandas(one, TOPIC)
    nowhere = features.filter("hold is not null and held_bounds is null").join(topics, "source_id").groupBy("topic").agg(F.count("*").alias("n_unknown"))
    asked = topics.select("topic").distinct()
    every = named.drop("region").crossJoin(F.broadcast(asked))  # a handful of topics
    rows = every.join(found, ["shape", "topic"], "left").join(nowhere, "topic", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    blocks = zero("n_held") + zero("n_unknown")
    interior = zero("n_interior")
    state = F.coalesce("coverage", F.lit("missing"))
    standing = F.lit(None).cast("array<string>")
    for topic, reasons in STANDING_REASONS.items():
        standing = F.when(F.col("topic") == topic, F.array(*map(F.lit, reasons))).otherwise(standing)
    checks = F.array_compact(F.array(
        F.when(~F.col("snapshot_current"), "stale_geometry_snapshot"), F.when(~F.col("within_scope"), "aoi_not_fully_within_county_scope"),
        F.when(blocks > 0, "potentially_affected_by_held_geometry"), F.when(interior == 0, "no_positive_area_source_evidence"),
        F.when(state != "full_geometric", "incomplete_geometric_coverage"),
    ))
    status = F.when(~F.col("snapshot_current"), "stale").when((interior > 0) | (blocks > 0), "review_required").otherwise("missing")
    usable = F.col("snapshot_current") & F.col("within_scope") & (blocks == 0) & (interior > 0)
    return rows.select(
        "aoi_id", "topic", status.alias("status"), state.alias("coverage"), F.coalesce("fraction", F.lit(0.0)).alias("fraction"), interior.alias("n_interior"), zero("n_touch").alias("n_touch"), blocks.alias("n_blocks"),
        usable.alias("intersections_usable"), F.concat(checks, F.coalesce(standing, F.expr("cast(array() as array<string>)"))).alias("reasons"), F.lit("DERIVED").alias("evidence_state"), F.lit("UNKNOWN").alias("suitability"),
    )


def currency(packets: DataFrame, context: DataFrame, key: list[str], method: str) -> DataFrame:
    """Whether packets still rest on what they were made from: key, needs_revisit, reasons.

    ``packets``: key, method, dependencies (canonical text). ``context``: key, dependencies, snapshot_current.
    """
    now = context.select(*key, F.col("dependencies").alias("_now"), "snapshot_current")
    rows = packets.join(now, key, "left")
    reasons = F.array_compact(F.array(
        F.when(~F.col("method").eqNullSafe(F.lit(method)), "qualification_method_changed"), F.when(~F.col("dependencies").eqNullSafe(F.col("_now")), "captured_dependencies_changed"),
        F.when(~F.coalesce("snapshot_current", F.lit(False)), "geometry_snapshot_stale"), F.when(F.col("_now").isNull(), "source_audit_missing"),
    ))
    return rows.select(*key, (F.size(reasons) > 0).alias("needs_revisit"), reasons.alias("reasons"))
