"""Unions and faces over a grid, against an independent engine and plain counts."""

import math
import random
import time

import pytest
from lodestrata.functions.stages import Stages
from lodestrata.geometry import dissolve, planar
from pyspark.sql import functions as F

REGIONS = "subject long, region array<array<array<array<double>>>>"


def star(rng, cx, cy, reach, n, hole):
    turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    shell = [[cx + math.cos(t) * reach * r, cy + math.sin(t) * reach * r] for t in turn for r in [rng.uniform(0.6, 1)]]
    rings = [[*shell, shell[0]]]
    if hole:
        inner = [[cx + (x - cx) * 0.4, cy + (y - cy) * 0.4] for x, y in shell]
        rings.append([*inner, inner[0]])
    return rings


def wkt(region):
    ring = lambda r: "(" + ",".join(f"{x!r} {y!r}" for x, y in r) + ")"
    return "MULTIPOLYGON(" + ",".join("(" + ",".join(map(ring, p)) + ")" for p in region) + ")"


def slanted(seed, subjects, each):
    rng, rows = random.Random(seed), []
    for s in range(subjects):
        for _ in range(each):
            rings = star(rng, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(1, 6), rng.randint(4, 9), rng.random() < 0.4)
            if not any(planar.ring_fault([tuple(p) for p in r]) for r in rings) and planar.ring_covers(rings[0], rings[-1]):
                rows.append((s, [rings]))
    return rows


def test_unions_equal_an_independent_engine(spark):
    rows = slanted(11, 5, 14) + [(5, None), (6, [])]
    rows += rows[:6]
    reader = spark._jvm.org.locationtech.jts.io.WKTReader()
    want = {}
    for s, region in rows:
        if region:
            shape = reader.read(wkt(region))
            want[s] = want[s].union(shape) if s in want else shape
    for size in (7.5, 1000.0):
        out = dissolve.dissolved(spark.createDataFrame(rows, REGIONS), ["subject"], "region", size, Stages(spark, "union")).collect()
        assert {r.subject for r in out} == set(want)
        for s, shape in want.items():
            own = [r for r in out if r.subject == s]
            assert sum(r.area for r in own) == pytest.approx(shape.getArea(), abs=1e-6)
            assert sum(r.length for r in own) == pytest.approx(shape.getLength(), rel=1e-6)
            # The rings themselves: shells less holes differ from the engine's union by nothing.
            even_odd = None
            for r in own:
                assert r.ring[0] == r.ring[-1] and r.area == pytest.approx(planar.signed_area([tuple(p) for p in r.ring]), abs=1e-9)
                one = reader.read(wkt([[r.ring]])).buffer(0.0)
                even_odd = one if even_odd is None else even_odd.symDifference(one)
            assert even_odd.symDifference(shape).getArea() == pytest.approx(0, abs=1e-5)


def test_boxes_touching_and_nested(spark):
    box = lambda a, b, c, d: [[[[float(x), float(y)] for x, y in ((a, b), (a, d), (c, d), (c, b), (a, b))]]]
    cases = {
        0: ([box(0, 0, 10, 10), box(10, 0, 20, 10)], [(200, 60)]),  # a shared edge goes
        1: ([box(0, 0, 10, 10), box(10, 10, 20, 20)], [(100, 40), (100, 40)]),  # a shared corner keeps faces apart
        2: ([box(0, 0, 30, 5), box(0, 25, 30, 30), box(0, 0, 5, 30), box(25, 0, 30, 30)], [(900, 120), (-400, 80)]),  # a frame has a hole
        3: ([box(0, 0, 8, 8), box(2, 2, 4, 4)], [(64, 32)]),
        4: ([box(0, 0, 8, 8)] * 3, [(64, 32)]),
        5: ([box(-8, -8, 8, 8), box(0, 0, 16, 16)], [(448, 96)]),
    }
    rows = [(k, region) for k, (regions, _) in cases.items() for region in regions]
    for size in (4.0, 3.0, 100.0):
        out = dissolve.dissolved(spark.createDataFrame(rows, REGIONS), ["subject"], "region", size, Stages(spark, "union")).collect()
        for k, (_, want) in cases.items():
            assert sorted((round(r.area, 6), round(r.length, 6)) for r in out if r.subject == k) == sorted(want), (size, k)
        assert max(len(r.ring) for r in out if r.subject in (0, 2, 3, 4)) == 5  # no points on straight lines


def test_crowded_cells_are_united_in_parts(spark, monkeypatch):
    rows = slanted(3, 1, 60)
    df = spark.createDataFrame(rows * 3, REGIONS)
    want = sum(r.area for r in dissolve.dissolved(df, ["subject"], "region", 9.0, Stages(spark, "union")).collect())
    monkeypatch.setattr(dissolve, "CROWD", 40)
    got = dissolve.dissolved(df, ["subject"], "region", 9.0, Stages(spark, "union")).collect()
    assert sum(r.area for r in got) == pytest.approx(want, abs=1e-6)


def test_faces_and_roles(spark):
    square = [[0.0, 0.0], [8.0, 0.0], [8.0, 8.0], [0.0, 8.0], [0.0, 0.0]]
    inner = [[2.0, 2.0], [6.0, 2.0], [6.0, 6.0], [2.0, 6.0], [2.0, 2.0]]
    eight = [[0.0, 0.0], [4.0, 4.0], [4.0, 0.0], [0.0, 4.0], [0.0, 0.0]]
    sliver = [[0.0, 0.0], [40.0, 0.0], [40.0, 0.01], [0.0, 0.0]]
    rows = [(0, [[eight]]), (1, [[square], [inner]]), (2, [[square], [inner[::-1]]]), (3, [[sliver]]), (4, None)]
    for size in (3.0, 64.0):
        out = dissolve.roles(dissolve.faces(spark.createDataFrame(rows, REGIONS), ["subject"], "region", size, Stages(spark, "faces")), 0.05).collect()
        got = {s: sorted((r.label, r.role, round(r.area, 6)) for r in out if r.subject == s) for s in range(5)}
        assert got[0] == [(-1, "reversed", 4.0), (1, "shell", 4.0)]
        assert got[1] == [(1, "hole", -16.0), (1, "shell", 64.0), (2, "overlap", 16.0)]
        assert got[2] == [(1, "hole", -16.0), (1, "shell", 64.0)]
        assert got[3] == [(1, "sliver", 0.2)] and got[4] == []


def test_subjects_of_any_name(spark):
    """Key columns may be named like the columns that the work uses, and may be null."""
    box = lambda x: [[[[x, 0.0], [x + 3, 0.0], [x + 3, 3.0], [x, 3.0], [x, 0.0]]]]
    df = spark.createDataFrame([(1, None, box(0.0)), (1, None, box(2.0)), (2, "a", box(8.0)), (None, "a", box(1.0))], "id long, label string, ring array<array<array<array<double>>>>")
    out = dissolve.dissolved(df.withColumnRenamed("label", "low"), ["id", "low"], "ring", 2.0, Stages(spark, "names")).collect()
    assert {(r.id, r.low, round(r.area, 9)) for r in out} == {(1, None, 15.0), (2, "a", 9.0), (None, "a", 9.0)}


def test_contact_patterns():
    square, hole = [(0, 0), (0, 9), (9, 9), (9, 0), (0, 0)], [(2, 1), (2, 2), (0, 0)]
    assert planar.contact_pattern(square)[0] == "simple"
    pattern, loops, hold = planar.contact_pattern(square + hole)
    assert (pattern, len(loops), hold) == ("single_touch", 2, None) and planar.segments(loops, True) == planar.segments([square + hole], True)
    beside = [(9, 0), (9, 9), (0, 0), (-2, 0), (-2, -2), (0, 0)]
    assert planar.contact_pattern([(0, 0), *beside])[0] == "touching_holes"
    assert planar.contact_pattern([*square, (-2, -1), (-2, -2), (0, 0)])[2] in ("loops of opposite turn are not nested", "two shells in one ring")
    two = [(0, 0), (0, 9), (9, 9), (7, 8), (8, 7), (9, 9), (9, 0), (0, 0), *hole]
    pattern, loops, hold = planar.contact_pattern(two)
    assert (pattern, hold) == ("two_contacts", None) and planar.segments(loops, True) == planar.segments([two], True)
    overlap = [(0, 0), (9, 0), (9, 9), (0, 0), (5, 1), (5, 4), (0, 0)]
    assert planar.contact_pattern(overlap)[2] in ("touching holes overlap", "vertex visited more than twice")
    assert planar.contact_pattern([*beside[:0], (0, 0), (9, 0), (9, 9), (0, 0), (-2, 0), (-2, -2), (0, 0), (0, 2), (-2, 2), (0, 0)])[2] == "vertex visited more than twice"


def test_many_boxes_in_one_gap_are_quick():
    rng = random.Random(1)
    corners = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(200)]
    boxes = [planar.envelope(x, y, x + rng.randint(2, 30), y + rng.randint(2, 30))[0] for x, y in corners]
    planar.boolean_areas(planar.envelope(0, 0, 1, 1), [])
    begun = time.process_time()
    areas = planar.boolean_areas(planar.envelope(0, 0, 100, 100), boxes)
    assert time.process_time() - begun < 1
    span = lambda b, k: range(int(min(p[k] for p in b[0])), int(max(p[k] for p in b[0])))
    cells = {(x, y) for b in boxes for x in span(b, 0) for y in span(b, 1)}
    assert areas["right"] == len(cells) and areas["both"] == sum(x < 100 and y < 100 for x, y in cells)


def test_cell_areas_sum_to_plain_areas(spark):
    rows = slanted(7, 1, 25)
    df = spark.createDataFrame(rows, REGIONS)
    cells = dissolve.gathered(dissolve.pieces(df, ["subject"], "region", 6.0), ["subject"])
    got = dissolve.cell_areas(cells, ["subject"], ["edges"], {"area": lambda c: c[0] > 0}, 6.0).agg(F.sum("area")).first()[0]
    region = [[[tuple(p) for p in ring] for ring in polygon] for _, r in rows for polygon in r]
    assert got == pytest.approx(planar.boolean_areas(region, [])["left"], abs=1e-6)
