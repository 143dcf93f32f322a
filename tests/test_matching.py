"""Nearest sites, gates, compared representations, tiles and contracts on small tables with the hard cases."""

import math
import random

import numpy as np
import pytest
from lodestrata.functions.stages import Stages
from lodestrata.operators import corrections, matching, nearest, raster, tiles, validation
from lodestrata.products import representations
from pyspark.sql import functions as F

PLACE = "id long, x double, y double"


def places(seed, n):
    rng = random.Random(seed)
    rows = [(k, rng.choice([rng.uniform(-50, 50), rng.gauss(0, 1), 5.0]), rng.choice([rng.uniform(-50, 50), rng.gauss(0, 1), 5.0])) for k in range(n)]
    return rows + [(n, 4000.0, -3000.0), (n + 1, None, 1.0), (n + 2, float("nan"), 1.0), (n + 3, 5.0, 5.0), (n + 4, 5.0, 5.0), (n + 5, -0.0, 0.0)]


def test_nearest_equals_brute_force(spark):
    points, sites = places(1, 120), places(2, 60)
    sound = [s for s in sites if s[1] is not None and not math.isnan(s[1])]
    for size in (0.5, 40.0):
        got = {r.id: r for r in nearest.nearest_sites(spark.createDataFrame(points, PLACE), spark.createDataFrame(sites, PLACE), size, Stages(spark, "nearest")).collect()}
        assert len(got) == len(points)
        for k, x, y in points:
            if x is None or math.isnan(x):
                assert got[k].site_id is None and got[k].distance is None
                continue
            far = min(math.hypot(x - s[1], y - s[2]) for s in sound)
            ties = [s[0] for s in sound if math.isclose(math.hypot(x - s[1], y - s[2]), far, rel_tol=1e-12)]
            assert got[k].distance == pytest.approx(far) and got[k].site_id == min(ties) and got[k].n_ties == len(ties)
    none = nearest.nearest_sites(spark.createDataFrame(points, PLACE), spark.createDataFrame([], PLACE), 1.0, Stages(spark, "nearest")).collect()
    assert len(none) == len(points) and all(r.site_id is None for r in none)


def test_gates_equal_brute_force(spark):
    left, right = places(3, 80), places(4, 70)
    gates = [0.5, 2.0, 9.0]
    got = {(r.id, r.gate): r for r in nearest.gated_matches(spark.createDataFrame(left, PLACE), spark.createDataFrame(right, PLACE), gates).collect()}
    finite = lambda r: r[1] is not None and not math.isnan(r[1])
    for g in gates:
        within = {k: [s[0] for s in right if finite(s) and finite((k, x, y)) and math.hypot(x - s[1], y - s[2]) <= g] for k, x, y in left}
        claims = [m[0] for m in within.values() if len(m) == 1]
        for k, m in within.items():
            kind = "none" if not m else "multiple" if len(m) > 1 else "conflict" if claims.count(m[0]) > 1 else "single"
            assert (got[k, g].n, got[k, g].match_class, got[k, g].match_id) == (len(m), kind, m[0] if len(m) == 1 else None)


def test_reverse_scope(spark):
    pairs = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (4, 40), (5, 40), (6, 60)], "left_id long, right_id long")
    left = spark.createDataFrame([(k, s) for k, s in zip(range(1, 7), ("a", "a", None, "b", "b", "c"), strict=True)], "id long, scope string")
    right = spark.createDataFrame([(10, "a"), (20, "b"), (30, None), (40, "b"), (60, "c")], "id long, scope string")
    assert {tuple(r) for r in nearest.reverse_scope(pairs, left, right, "scope").select("left_id", "right_id").collect()} == {(1, 10), (6, 60)}


def test_representations(spark):
    square = [[0.0, 0.0], [0.0, 2.0], [2.0, 2.0], [2.0, 0.0], [0.0, 0.0]]
    turned = [[2.0, 2.0], [2.0, 0.0], [-0.0, 0.0], [0.0, 2.0], [2.0, 2.0]]
    schema = "k long, a string, rings array<array<array<double>>>"
    left = spark.createDataFrame([(1, "x", [square]), (2, None, [square]), (3, "x", [square]), (4, "x", None), (5, "x", [square]), (6, "x", [square]), (8, "x", [square, square]), (None, "x", [])], schema)
    right = spark.createDataFrame([(1, "x", [turned]), (2, None, [turned[:-1]]), (3, "y", [square]), (4, "x", []), (6, "x", [square]), (6, "x", [square]), (7, "x", None), (8, "y", [square]), (None, "x", None)], schema)
    got = {r.k: (r.state, r.n_left_only, r.n_right_only) for r in representations.compared(left, right, ["k"], ["a"], "rings").collect()}
    assert got == {
        1: ("equal", 0, 0), 2: ("shape_differs", 1, 0), 3: ("attributes_differ", 0, 0), 4: ("equal", 0, 0), 5: ("missing_right", None, None),
        6: ("repeated", None, None), 7: ("missing_left", None, None), 8: ("both_differ", 4, 0), None: ("equal", 0, 0),
    }


def test_tiles_equal_cells(spark):
    rng = random.Random(9)
    cells = [("a" if r < 9 else None, r, c, rng.uniform(0, 9), rng.random() < 0.9) for r in range(-3, 9) for c in range(-2, 11)]
    cells += [(None, r, c, float(2 * c + 3 * r), True) for r in range(4) for c in range(20)]
    grid = spark.createDataFrame(cells, "by string, row int, col int, value double, valid boolean")
    held = tiles.from_cells(grid, ["by"], 4)
    got = {(r.by, r.row, r.col): r.slope for r in tiles.to_cells(tiles.tile_slopes(held, ["by"], 4, 2.0), ["by"], 4, "slope", "slope").collect()}
    valid = {(b, r, c) for b, r, c, _, ok in cells if ok}
    want = {(r.by, r.row, r.col): r.slope for r in raster.horn_slope(grid, 2.0, ["by"]).collect()}
    want = {k: v for k, v in want.items() if k in valid}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert any(k[0] is None for k in got) and got[None, 1, 4] == pytest.approx(math.degrees(math.atan(math.hypot(1, 1.5))))
    rings = tiles.valid_footprint(held, ["by"], 4, Stages(spark, "footprint")).collect()
    for b in ("a", None):
        own = {(r, c) for k, r, c in valid if k == b}
        assert sum(r.area for r in rings if r.by == b) == pytest.approx(len(own))
        edges = sum((r + dr, c + dc) not in own for r, c in own for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        assert sum(r.length for r in rings if r.by == b) == pytest.approx(edges)
    samples = {(r.by, r.tx, r.ty): r for r in tiles.block_samples(held, ["by"], 4).collect()}
    value = {(b, r, c): v for b, r, c, v, ok in cells if ok}
    for (b, tx, ty), r in samples.items():
        want = [value.get((b, ty * 4 + 2 + dr, tx * 4 + 2 + dc)) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
        assert r.samples == want and r.n_valid == sum(v is not None for v in want)


SHA = "ab" * 32
AREA = '"geometry":{"type":"%s","coordinates":%s}'
BOX = "[[-69.5,45.1],[-69.5,45.2],[-69.4,45.2],[-69.4,45.1],[-69.5,45.1]]"
HOLE = "[[-69.47,45.14],[-69.44,45.14],[-69.44,45.16],[-69.47,45.14]]"


def test_requests(spark):
    head = f'"audit":"{SHA}","snapshot":"{SHA}","purchase_candidate":true'
    soils = f',"soils":{{"batch":"{validation.SOIL_BATCH}","snapshot":"{SHA}"}}'
    cases = [
        (f"{{{head},{AREA % ('Polygon', f'[{BOX}]')}{soils}}}", []),
        (f"{{{head},{AREA % ('Polygon', f'[{BOX},{HOLE}]')}}}", []),
        (f"{{{head},{AREA % ('MultiPolygon', f'[[{BOX},{HOLE}]]')}}}", []),
        (f"{{{head},{AREA % ('MultiPolygon', f'[[{BOX}],[{HOLE}]]')}}}", ["area"]),
        (f"{{{head},{AREA % ('Polygon', f'[{HOLE},{BOX}]')}}}", ["area"]),
        (f"{{{head},{AREA % ('Point', '[1,2]')}}}", ["area"]),
        (f"{{{head},{AREA % ('Polygon', '[]')}}}", ["area"]),
        (f"{{{head},{(AREA % ('Polygon', f'[{BOX}]')).replace('45.2]', '95.2]')}}}", ["lon_lat"]),
        (f'{{{head},{(AREA % ("Polygon", f"[{BOX}]")).replace("45.2]", chr(34) + "45.2" + chr(34) + "]")}}}', ["area"]),
        (f'{{{head},"source_id":"ut-parcels","object_id":0}}', []),
        (f'{{{head},"source_id":"ut-parcels","object_id":1.5}}', ["parcel"]),
        (f'{{{head},"source_id":"ut-parcels","object_id":true}}', ["parcel"]),
        (f'{{{head.replace("true", "1")},"source_id":"ut-parcels","object_id":3,"soils":[]}}', ["soils", "purchase_candidate"]),
        (None, ["audit", "snapshot", "purchase_candidate", "parcel"]),
        ("[]", ["audit", "snapshot", "purchase_candidate", "parcel"]),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, r string")
    got = {r.k: r.f for r in df.select("k", validation.request_faults(F.col("r")).alias("f")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[1] for c in cases]


def test_soil_rows_and_screening_references(spark):
    rows = ["nonsense", None, '{"kind":"legend","source_key":"1","raw":{"lkey":"1"},"provenance":{"response_sha256":"%s","row_ordinal":0}}' % SHA, '{"kind":"mapunit","source_key":"1","raw":{"mukey":"1"},"provenance":{"response_sha256":"%s","row_ordinal":0}}' % SHA]
    got = [r.faults for r in corrections.soil_rows(spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, input_text string")).orderBy("k").collect()]
    assert got[0] == got[1] == ["kind", "identity", "provenance"] or {"kind", "identity"} <= set(got[0])
    assert got[2] == [] and got[3] == ["parent"]
    zones = spark.createDataFrame([(1, "valid"), (2, "invalid")], "object_id long, state string")
    hits = spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "subject_id long, object_id long")
    assert {tuple(r) for r in corrections.usable_references(hits, zones).collect()} == {(7, 2), (8, 3)}


def test_empty_tables(spark):
    assert tiles.from_cells(spark.createDataFrame([], "row int, col int, value double, valid boolean"), [], 4).count() == 0
    schema = "k long, a string, rings array<array<array<double>>>"
    assert representations.compared(spark.createDataFrame([], schema), spark.createDataFrame([], schema), ["k"], ["a"], "rings").count() == 0
    assert np.isclose(nearest.gated_matches(spark.createDataFrame([(1, 0.0, 0.0)], PLACE), spark.createDataFrame([], PLACE), [1.0]).first().n, 0)


def test_variants_are_counted_without_repeating_rows(spark):
    rows = [(1, "a", "x", 0.0), (1, "a", "x", -0.0), (1, "a", None, 0.0), (2, None, "~", 1.0), (2, None, None, 1.0), (3, None, "x", 1.0), (3, "b", "x", 1.0), (4, "b", "y", 2.0), (None, "b", "y", 2.0), (None, "b", "y", 3.0)]
    df = spark.createDataFrame(rows, "k long, c string, v string, w double").repartition(3)
    out = matching.grouped_variants(df, "k", ["c"], ["v", "w"])
    assert {r.k: tuple(r)[1:] for r in out.collect()} == {1: (3, True, 2, ["v"]), 2: (2, True, 2, []), 3: (2, False, 1, []), 4: (1, True, 1, []), None: (2, True, 2, ["w"])}
    assert "Expand" not in out._jdf.queryExecution().toString()
