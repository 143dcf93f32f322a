import math
import random

import numpy as np
import pytest
from lodestrata.geometry import crs, frames, planar
from pyspark.sql import functions as F

SQUARE = [(0, 0), (0, 10), (10, 10), (10, 0), (0, 0)]  # clockwise
HOLE = [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]


def box(a, b, c, d):
    return planar.envelope(a, b, c, d)


def test_decode_assigns_holes_and_holds_what_is_odd():
    region, hold = planar.decode_rings([SQUARE, HOLE])
    assert hold is None and len(region) == 1 and len(region[0]) == 2
    assert planar.boolean_areas(region, [])["left"] == 96
    assert planar.decode_rings([HOLE])[1] == "no shell"
    assert planar.decode_rings([SQUARE, [(20, 2), (24, 2), (24, 4), (20, 2)]])[1] == "hole without a single shell"
    assert planar.decode_rings([[(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]])[1] == "self-intersection"
    assert planar.decode_rings([SQUARE[:-1]])[1] == "not closed"
    assert planar.decode_rings(None)[1] == "missing rings"
    assert planar.decode_rings([[(0, 0), (0, float("nan")), (1, 1), (0, 0)]])[1] == "not finite and two-dimensional"


def test_touching_rings_are_split_without_new_segments():
    ring = [(0, 0), (0, 10), (10, 10), (10, 0), (5, 0), (6, 3), (4, 3), (5, 0), (0, 0)]
    loops, hold = planar.split_at_touches(ring)
    assert hold is None and len(loops) == 2
    assert planar.segments(loops, directed=True) == planar.segments([ring], directed=True)
    assert planar.contact_points(ring) == [(0, 0), (5, 0)] or planar.contact_points(ring) == [(5, 0)]
    assert planar.split_at_touches([(0, 0), (1, 1), (0, 0), (2, 1), (0, 0), (3, 1), (0, 0)])[0] is None


def test_coverage_counts_overlaps_once_and_a_small_gap_stays_partial():
    aoi = box(0, 0, 10, 10)
    assert planar.coverage([], aoi)["state"] == "missing"
    whole = planar.coverage([box(-1, -1, 11, 11)], aoi)
    assert whole["basis"] == "source_covers_aoi" and whole["state"] == "full_geometric"
    twice = planar.coverage([box(0, 0, 6, 10), box(4, 0, 10, 10)], aoi)
    assert twice["state"] == "full_geometric" and twice["uncovered"] == 0
    tiny = planar.coverage([box(0, 0, 10, 9.999999)], aoi)
    assert tiny["state"] == "partial_geometric" and tiny["uncovered"] > 0
    half = planar.coverage([box(0, 0, 5, 10), box(0, 0, 5, 10)], aoi)
    assert half["fraction"] == pytest.approx(0.5)


def test_relations():
    aoi = box(0, 0, 10, 10)
    assert planar.relation(box(10, 0, 12, 5), aoi) == "touch"
    assert planar.relation(box(10, 10, 12, 12), aoi) == "touch"
    assert planar.relation(box(11, 0, 12, 5), aoi) == "outside"
    assert planar.relation(box(9, 9, 12, 12), aoi) == "interior"
    assert planar.relation(box(2, 2, 3, 3), aoi) == "interior"
    assert planar.covers(aoi, box(0, 0, 10, 10)) and not planar.covers(aoi, box(0, 0, 10, 11))


def test_boolean_areas_equal_sampling():
    rng = random.Random(4)
    for _ in range(10):
        a = [[*(ring := [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(3)]), ring[0]]]
        b = [[*(ring := [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(3)]), ring[0]]]
        got = planar.boolean_areas([a], [b])
        assert got["left"] == pytest.approx(abs(planar.signed_area(a[0])), abs=1e-9)
        assert got["both"] + got["left_only"] == pytest.approx(got["left"], abs=1e-9)
        assert got["either"] == pytest.approx(got["left"] + got["right_only"], abs=1e-9)
        points = np.array([(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(4000)])
        inside = [planar.locate(p, a[0]) > 0 and planar.locate(p, b[0]) > 0 for p in points[:1500]]
        assert got["both"] == pytest.approx(100 * sum(inside) / 1500, abs=4)


def test_areas_equal_an_independent_engine(spark):
    """The overlay engine that the Spark distribution bundles, as a second opinion."""
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    rng = random.Random(5)
    for _ in range(15):
        rings = []
        for _ in range(2):
            n = rng.randint(3, 9)
            cx, cy = rng.uniform(0, 5), rng.uniform(0, 5)
            turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
            ring = [(cx + math.cos(t) * r, cy + math.sin(t) * r) for t in turn for r in [rng.uniform(1, 4)]]
            rings.append([*ring, ring[0]])
        if any(planar.ring_fault(r) for r in rings):
            continue
        a, b = (reader.read("POLYGON((" + ",".join(f"{x!r} {y!r}" for x, y in r) + "))") for r in rings)
        got = planar.boolean_areas([[rings[0]]], [[rings[1]]])
        assert got["both"] == pytest.approx(a.intersection(b).getArea(), abs=1e-9)
        assert got["either"] == pytest.approx(a.union(b).getArea(), abs=1e-9)


def test_held_envelope_is_all_or_nothing(spark):
    good = ([[[0.0, 0.0], [3.0, 4.0]]], [[[0.0, 1.0, 9.0]], [[-1.0, 5.0]]])
    odd = (None, [], [[]], [[[0.0, 1.0]], []], [[[0.0, float("inf")]]], [[[0.0]]], [[[0.0, None]]], [[None]], [None])
    rows = [(k, rings) for k, rings in enumerate((*good, *odd))]
    df = spark.createDataFrame(rows, "k int, rings array<array<array<double>>>")
    got = {r.k: r.box and tuple(r.box) for r in df.select("k", frames.held_bounds(F.col("rings")).alias("box")).collect()}
    assert got == {0: (0.0, 0.0, 3.0, 4.0), 1: (-1.0, 1.0, 0.0, 5.0)} | {k: None for k in range(len(good), len(rows))}


def test_distances():
    assert planar.hausdorff([SQUARE], [[(x + 1, y) for x, y in SQUARE]]) == 1
    assert planar.hausdorff([SQUARE], [[(x + 100, y) for x, y in SQUARE]], give_up=10) == math.inf
    assert planar.vertex_distances(SQUARE, [(x, y + 2) for x, y in SQUARE]) == (2, 2)
    x, y = planar.representative_point([SQUARE, HOLE])
    assert planar.locate((x, y), SQUARE) == 1 and planar.locate((x, y), HOLE) == -1


def test_projections_turn_back():
    lon, lat = np.array([-69.3, -68.1, -70.9]), np.array([45.2, 47.3, 43.1])
    for there, back in (("4269:26919", "26919:4269"), ("4269:5070", "5070:4269"), ("4326:3857", "3857:4326")):
        x, y = crs.transform(lon, lat, there)
        a, b = crs.transform(x, y, back)
        assert np.allclose(a, lon, atol=1e-9) and np.allclose(b, lat, atol=1e-9)
    x, y = crs.transform([-69.0], [0.0], "4269:26919")
    assert (x[0], y[0]) == (500000.0, 0.0)
    x, y = crs.transform([180.0], [0.0], "4326:3857")
    assert x[0] == pytest.approx(20037508.342789244)
    with pytest.raises(ValueError):
        crs.transform([0], [0], "4326:26919")
