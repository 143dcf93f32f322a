"""Equal shapes meet once: what is compared grows with the different shapes, not with the rows."""

from __future__ import annotations

import pytest
from lodestrata.functions.stages import Stages
from lodestrata.geometry import frames
from lodestrata.geometry.frames import REGION
from lodestrata.operators import boxes
from lodestrata.products import conflicts, packet, qualification, ranking, recompute
from pyspark.sql import functions as F


def box(x0, y0, x1, y1):
    return [[[[float(x), float(y)] for x, y in ((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0))]]]


@pytest.fixture
def sizes(monkeypatch):
    """Rows of both sides of each join of boxes, and of each table that is cut to cells."""
    seen = []
    join = boxes.box_pairs

    def watched(a, b, *rest, **more):
        seen.append((a.count(), b.count()))
        return join(a, b, *rest, **more)

    for module in (boxes, frames, qualification, ranking, packet, recompute):
        monkeypatch.setattr(module, "box_pairs", watched)
    for module in (conflicts, ranking, recompute):
        if hasattr(module, "pieces"):
            cut = module.pieces
            monkeypatch.setattr(module, "pieces", lambda df, *rest, cut=cut, **more: (seen.append(df.count()), cut(df, *rest, **more))[1])
    return seen


# Six areas of two shapes and nine features of three: one inside both, one that touches the first, one far away.
def areas(spark, name):
    return spark.createDataFrame([(k, box(0, 0, 4, 4) if k % 2 else box(2, 0, 6, 4)) for k in range(6)], f"{name} long, region {REGION}")


def features(spark, name):
    return spark.createDataFrame([(k, [box(2, 0, 3, 2), box(-1, 0, 0, 1), box(50, 50, 51, 51)][k % 3]) for k in range(9)], f"{name} long, region {REGION}")


def test_overlaid_pairs(spark, sizes):
    got = {(r.a_id, r.b_id): r.both for r in frames.overlaid(areas(spark, "id"), features(spark, "id"), 4.0).collect()}
    assert got == {(a, b): 2 for a in range(6) for b in (0, 3, 6)} and sizes == [(2, 3)]


def test_qualified_areas(spark, sizes):
    aois = areas(spark, "aoi_id").withColumns({"within_scope": F.lit(True), "snapshot_current": F.lit(True)})
    f = features(spark, "object_id").withColumns({"source_id": F.lit("s"), "hold": F.lit(None).cast("string"), "held_bounds": F.lit(None).cast("struct<xmin double, ymin double, xmax double, ymax double>")})
    held = f.withColumns({"region": F.lit(None).cast(REGION), "hold": F.lit("held"), "held_bounds": F.struct(*[F.lit(v).alias(c) for v, c in zip((3.0, 0.0, 9.0, 9.0), boxes.BOX, strict=True)])}).filter("object_id < 2")
    topics = spark.createDataFrame([("zoning", "s")], "topic string, source_id string")
    got = {r.aoi_id: (r.n_interior, r.n_touch, r.n_blocks, r.fraction) for r in qualification.qualify(aois, f.unionByName(held.select(*f.columns)), topics, 4.0).collect()}
    assert got == {k: (3, 3 if k % 2 else 0, 2, 0.125) for k in range(6)} and sizes == [(2, 4)]


def test_gap_areas(spark, sizes):
    held = spark.createDataFrame([(k, 0.0, 0.0, 4.0, 4.0) for k in range(5)] + [(9, 90.0, 90.0, 91.0, 91.0)], "object_id long, xmin double, ymin double, xmax double, ymax double")
    got = {r.object_id: r.area for r in ranking.gap_areas(held, features(spark, "gap_id"), 4.0).collect()}
    assert got == {**dict.fromkeys(range(5), 6), 9: 0} and sizes == [(2, 3)]


def test_placements(spark, sizes):
    got = {(r.object_id, r.code): (r.fraction, r.fully) for r in conflicts.placements(features(spark, "object_id"), areas(spark, "code"), 4.0).collect()}
    assert got == {(a, b): (1, True) for a in (0, 3, 6) for b in range(6)} and sizes == [3, 2]


def test_screened_zones(spark, sizes):
    zones = features(spark, "id").withColumn("zone", F.lit("Z"))
    got = {r.id: (r.n_overlaps, r.area_sum, r.covered_fraction, r.n_touch, r.touches, r.status) for r in frames.screen(areas(spark, "id"), zones, 4.0).collect()}
    assert got == {k: (3, 6, 0.125, 3 if k % 2 else 0, [1, 4, 7] if k % 2 else [], "overlap") for k in range(6)} and sizes == [(2, 3)]


def test_soils_of_areas(spark, sizes):
    a = areas(spark, "aoi_id").withColumns({c: F.lit(True) for c in ("within_scope", "snapshot_current", "soils_requested", "soils_current")})
    polygons = features(spark, "polygon_id").withColumns({"mukey": F.lit(1).cast("long"), "hold": F.when(F.col("polygon_id") == 3, "held")})
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = packet.soil_topic(a, polygons, table([(1, 1)], "mukey long, lkey long"), table([(1,)], "lkey long"), table([(1, 1, "100", "Series")], "cokey long, mukey long, percent string, compkind string"), table([(1,)], "cokey long"), 4.0, Stages(spark, "soils"))
    got = [r.reasons[:2] for r in rows.collect()]
    assert got == [["soil_geometry_holds_require_review", "incomplete_soil_geometric_coverage"]] * 6
    assert sizes[0] == (2, 4) and sizes[1:] == [2, 3]


def test_scenario_areas(spark, sizes):
    got = {r.gap_id: r.area for r in ranking.scenario_areas(areas(spark, "gap_id"), features(spark, "cand_id"), features(spark, "cand_id").filter("cand_id % 3 = 1"), 4.0).collect()}
    assert got == dict.fromkeys(range(6), 2) and sorted(sizes) == [1, 2, 3]


@pytest.mark.parametrize("chunk", [2, 256])
def test_pairs_of_members(spark, sizes, monkeypatch, chunk):
    monkeypatch.setattr(boxes, "CHUNK", chunk)
    rows = lambda n, *at: spark.createDataFrame([(k, *map(float, at[k % len(at)])) for k in range(n)], "id long, xmin double, ymin double, xmax double, ymax double")
    a, b = rows(10, (0, 0, 4, 4), (20, 20, 21, 21)), rows(9, (3, 3, 9, 9), (4, 4, 5, 5), (50, 0, 51, 1))
    got = sorted((r.a_id, r.b_id, r.area) for r in boxes.pairs_of_members(a, b, 4.0).select("a_id", "b_id", boxes.overlap_area().alias("area")).collect())
    assert got == sorted((x, y, 1 if y % 3 == 0 else 0) for x in range(0, 10, 2) for y in range(9) if y % 3 < 2) and sizes == [(2, 3)]


def test_recomputed_areas(spark, sizes):
    subjects, inputs = areas(spark, "id"), features(spark, "id")
    assert {r.id: (r.area, r.covered) for r in recompute.covered_areas(subjects, inputs, 4.0, Stages(spark, "covered")).collect()} == dict.fromkeys(range(6), (16, 2))
    found = {r.id: (r.n_inputs, r.dependencies) for r in recompute.dependencies(subjects, inputs, 4.0).collect()}
    assert [found[k][0] for k in range(6)] == [3, 6] * 3 and len({v for v in found.values()}) == 2 and sizes == [2, 3, (2, 9)]
