"""Ranking of held features by the uncovered area that they may hide, and its refresh."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import decrease
from lodestrata.functions.stages import Stages
from lodestrata.geometry import planar
from lodestrata.geometry.dissolve import cell_areas, gathered, pieces, thinned
from lodestrata.geometry.frames import _region, box_region, overlay_areas, shape_id, shapes, with_bounds
from lodestrata.operators.boxes import BOX, box_pairs
from lodestrata.operators.sequences import ranked


def gap_areas(held: DataFrame, gaps: DataFrame, size: float) -> DataFrame:
    """(object_id, area): uncovered area (gaps: gap_id, region) within each held envelope (object_id, xmin..ymax)."""
    # Envelopes that are equal share their answer, and equal gaps meet an envelope once.
    boxes = held.select("object_id", F.struct(*BOX).alias("box"))
    different = boxes.select("box").distinct().select("box", "box.*")
    kinds = shapes(gaps.select("region", shape_id().alias("shape")))
    pairs = box_pairs(different, with_bounds(kinds), "box", "shape", size)
    met = pairs.join(kinds.select(F.col("shape").alias("b_id"), "region", "n"), "b_id")
    areas = met.select(F.col("a_id").alias("box"), "n", overlay_areas(box_region(*[F.col(f"a_{c}") for c in BOX]), "region").alias("o"))
    found = areas.groupBy("box").agg(F.sum(F.col("o.both") * F.col("n")).alias("area"))
    return boxes.join(found, "box", "left").select("object_id", F.coalesce("area", F.lit(0.0)).alias("area"))


def newly_covered(gaps: DataFrame, candidates: DataFrame, size: float) -> DataFrame:
    """(gap_id, area): what candidates (cand_id, region) add in each gap; only those that meet a gap are united."""
    pairs = box_pairs(with_bounds(gaps), with_bounds(candidates), "gap_id", "cand_id", size).select(F.col("a_id").alias("gap_id"), F.col("b_id").alias("cand_id"))
    met = pairs.join(gaps.select("gap_id", F.col("region").alias("g")), "gap_id").join(candidates.select("cand_id", F.col("region").alias("c")), "cand_id")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        gap = _region(frame["g"].iloc[0])
        area = planar.boolean_areas(gap, [p for c in frame["c"] for p in _region(c)])["both"]
        return pd.DataFrame({"gap_id": [frame["gap_id"].iloc[0]], "area": [area]})

    return met.groupBy("gap_id").applyInPandas(one, "gap_id long, area double").filter("area > 0")


def refresh(previous: DataFrame, reductions: DataFrame) -> DataFrame:
    """Rank again after reductions (object_id, area): area, rank, previous_rank, reduction.

    ``previous`` has object_id, area and rank, one row for each held feature. A remainder never grows.
    """
    joined = previous.withColumnRenamed("rank", "previous_rank").join(reductions.select("object_id", F.col("area").alias("reduction")), "object_id", "left")
    gone = F.coalesce("reduction", F.lit(0.0))
    left = joined.select("object_id", decrease(F.col("area"), gone).alias("area"), "previous_rank", gone.alias("reduction"))
    return ranked(left, "area", "object_id", "rank")


def civil_reductions(pieces: DataFrame) -> DataFrame:
    """Area per civil name of clipped pieces (name, area); a piece without a name is UNKNOWN, not dropped."""
    return pieces.groupBy(F.coalesce("name", F.lit("UNKNOWN")).alias("name")).agg(F.sum("area").alias("area"), F.count("*").alias("n_pieces"))


def scenario_areas(gaps: DataFrame, proposals: DataFrame, accepted: DataFrame, size: float) -> DataFrame:
    """(gap_id, area): what proposals (cand_id, region) add in each gap (gap_id, region) beyond the accepted (cand_id, region).

    Proposals count once where they overlap, and not at all where something accepted lies already. Gaps to which
    nothing is added have 0. All sides are cut to grid cells; an area is the sum over the cells that gap and proposals
    share, so neither a large gap nor one with many proposals is one task's.
    """
    # Equal gaps share their answer, and what is proposed or accepted twice adds nothing.
    different = lambda df: shapes(df.select("region", shape_id().alias("shape")))
    of = lambda side, name: gathered(thinned(pieces(different(side), [], "region", size), [], size, Stages(gaps.sparkSession, f"scenario-{name}")), [], name)
    named = gaps.select("gap_id", shape_id().alias("shape"))
    own = pieces(different(gaps), ["shape"], "region", size)
    cells = own.join(of(proposals, "new"), ["cx", "cy"]).join(of(accepted, "old"), ["cx", "cy"], "left")
    added = {"area": lambda c: (c[0] > 0) & (c[1] > 0) & (c[2] <= 0)}
    found = cell_areas(cells, ["shape"], ["edges", "new", "old"], added, size).groupBy("shape").agg(F.sum("area").alias("area"))
    return named.join(found, "shape", "left").select("gap_id", F.coalesce("area", F.lit(0.0)).alias("area"))
