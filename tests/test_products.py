"""Products, readers and contracts that no registered query exercises."""

import datetime
import json

import pytest
from lodestrata.functions import dates, digest, json_paths, scalars
from lodestrata.geometry import frames, planar
from lodestrata.operators import history, raster, validation, vectors
from lodestrata.products import ingestion, ranking, soils
from lodestrata.sources import captures, sinks
from lodestrata.streaming import event_log
from pyspark.sql import functions as F

REGION = "array<array<array<array<double>>>>"


def box(a, b, c, d):
    return [[[[float(x), float(y)] for x, y in ring] for ring in polygon] for polygon in planar.envelope(a, b, c, d)]


TRIANGLE = [[[[0.0, 0.0], [0.0, 10.0], [10.0, 0.0], [0.0, 0.0]]]]
RINGED = [[[[0.0, 0.0], [0.0, 10.0], [10.0, 10.0], [10.0, 0.0], [0.0, 0.0]], [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0], [2.0, 2.0]]]]


def test_dates_of_mixed_precision(spark):
    """Year and day forms, and what is neither; expectations from the calendar, not from the engine."""
    good = {"2011": ("year", "2011"), "9999": ("year", "9999"), "20240229": ("day", "2024-02-29"), "4/1/2011": ("day", "2011-04-01"), " 12/31/1999\t": ("day", "1999-12-31"), " 2011\n": ("year", "2011")}
    odd = {None: "missing", "": "missing", " \t ": "missing", **dict.fromkeys(("0", "20", "0123", "0000", "0999", "20230229", "13/1/2020", "2/30/2020", "2011x", "1/1/20", "12011"), "malformed_or_uninterpreted")}
    df = spark.createDataFrame([(x,) for x in (*good, *odd)], "raw string")
    got = {r.raw: r.d for r in df.select("raw", dates.parse_date(F.col("raw")).alias("d")).collect()}
    for raw, (precision, value) in good.items():
        assert (got[raw].precision, got[raw].value, got[raw].state, got[raw].reason) == (precision, value, "DERIVED", None)
        assert got[raw].year == (int(value) if precision == "year" else None)
        if precision == "day":
            datetime.date.fromisoformat(got[raw].value)
    for raw, reason in odd.items():
        assert (got[raw].precision, got[raw].value, got[raw].state, got[raw].reason, got[raw].raw) == (None, None, "UNKNOWN", reason, raw)


def test_blanks_and_identities(spark):
    texts = ["", " ", "\t", " ", "\x1f", "　\n", "a", " a ", None]
    got = {r.t: r.b for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.is_blank(F.col("t")).alias("b")).collect()}
    assert got == {t: t is None or not t.strip() for t in texts}
    rows = [("a", None, "b"), ("a", "b", None), ("a", "", "b"), ("a:", None, "b")]
    assert spark.createDataFrame(rows, "x string, y string, z string").select(digest.composite_id("x", "y", "z").alias("i")).distinct().count() == 4


def test_fingerprints_stream_in_order(spark):
    import hashlib

    rows = [(g, k, f"d{k % 7}") for g in ("a", None, "b") for k in range(2500)]
    got = {r.g: (r.n_rows, r.fingerprint) for r in digest.ordered_fingerprint(spark.createDataFrame(rows, "g string, k long, d string").repartition(5), ["g"], ["k"], "d").collect()}
    for g in ("a", None, "b"):
        text = "".join(f"{k}:d{k % 7}\n" for k in range(2500))
        assert got[g] == (2500, hashlib.sha256(text.encode()).hexdigest())


def test_conflicts_inside_a_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k long, v string")
    assert sinks.append_new(rows, path, ["k"]) == 2 and sinks.append_new(rows, path, ["k"]) == 0
    with pytest.raises(ValueError, match="different payloads"):
        sinks.append_new(spark.createDataFrame([(3, "a"), (3, None)], rows.schema), path, ["k"])
    assert history.own_conflicts(rows, ["k"]).count() == 0


def test_geometry_columns(spark):
    df = spark.createDataFrame([(1, TRIANGLE, box(0, 0, 5, 5)), (2, RINGED, box(1, 1, 3, 3)), (3, None, box(0, 0, 1, 1)), (4, box(0, 0, 1, 1), box(1, 0, 2, 1)), (5, box(0, 0, 1, 1), box(3, 0, 4, 1))], f"k int, a {REGION}, b {REGION}")
    got = {r.k: r for r in df.select("k", frames.overlay_areas("a", "b").alias("o"), frames.region_relation("a", "b").alias("r"), frames.hausdorff(F.col("a")[0], F.col("b")[0]).alias("h")).collect()}
    assert (got[1].o.left, got[1].o.both, got[1].o.right_only) == (50, 25, 0)  # the corner (5, 5) lies on the slanted edge
    assert (got[2].o.left, got[2].o.both, got[2].o.right_only) == (96, 3, 1)  # a hole takes one of four
    assert got[3].o is None and got[3].h is None and got[3].r == "held"
    assert (got[4].r, got[5].r) == ("touch", "outside") and got[5].h == 3
    moved = spark.createDataFrame([(RINGED[0],), (None,)], "rings array<array<array<double>>>").select(frames.transformed("rings", "4326:3857").alias("m")).collect()
    assert moved[1].m is None and moved[0].m[0][1][1] == pytest.approx(1118889.9748, abs=1e-3)
    bow = [[0.0, 0.0], [4.0, 0.0], [2.0, 2.0], [4.0, 4.0], [0.0, 4.0], [2.0, 2.0], [0.0, 0.0]]
    cut = spark.createDataFrame([(bow,), (None,)], "ring array<array<double>>").select(frames.split_touches("ring").alias("s")).collect()
    assert len(cut[0].s.loops) == 2 and cut[1].s.hold == "missing"


def test_areas_of_zones_and_gaps(spark):
    pairs = spark.createDataFrame([("z1", box(0, 0, 10, 10), box(0, 0, 4, 10)), ("z1", box(0, 0, 10, 10), box(2, 0, 6, 10)), ("z2", box(0, 0, 10, 10), TRIANGLE)], f"zone string, s {REGION}, z {REGION}")
    assert {r.zone: r.area for r in frames.zone_areas(pairs, ["zone"]).collect()} == {"z1": 60, "z2": 50}
    gaps = spark.createDataFrame([(1, RINGED), (2, box(50, 50, 60, 60))], f"gap_id long, region {REGION}")
    cands = spark.createDataFrame([(1, box(0, 0, 4, 4)), (2, box(3, 0, 6, 4)), (3, box(100, 0, 101, 1))], f"cand_id long, region {REGION}")
    assert {r.gap_id: r.area for r in ranking.newly_covered(gaps, cands, 8.0).collect()} == {1: 20}
    accepted = cands.filter("cand_id = 2")
    assert {r.gap_id: r.area for r in ranking.scenario_areas(gaps, cands.filter("cand_id <> 2"), accepted, 8.0).collect()} == {1: 10, 2: 0}  # 16, less the hole, less what is accepted outside the hole
    pieces = spark.createDataFrame([("a", 1.0), (None, 2.0), ("a", 3.0)], "name string, area double")
    assert {r["name"]: (r.area, r.n_pieces) for r in ranking.civil_reductions(pieces).collect()} == {"a": (4, 2), "UNKNOWN": (2, 1)}


def test_readers(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnot json\n')
    rows = captures.jsonl(spark, str(tmp_path / "l.jsonl"), "a int").collect()
    assert [r.record.a if r.record else None for r in rows] == [1, None] and len(rows[0].line_sha256) == 64
    (tmp_path / "c.csv").write_text("a,b\n1,x\n2,\n", encoding="utf-8")
    assert [tuple(r) for r in captures.csv_members(spark, str(tmp_path / "c.csv"), "a int, b string").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "log.json").write_text(json.dumps([{"id": "r1", "http_status": 200, "bytes": 5}, {"id": "r2", "error": "timeout"}]))
    assert {r.id: r.http_status for r in captures.response_log(spark, str(tmp_path / "log.json")).collect()} == {"r1": 200, "r2": None}
    document = sinks.json_document(spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), ["k"]).first().document
    assert json.loads(document) == [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}]


def test_horizons_and_running_state(spark, tmp_path):
    h = spark.createDataFrame([("c", "h1", 0, 10), ("c", "h2", 10, 20), ("c", "h3", 25, 30), ("c", "h4", 28, 40)], "cokey string, chkey string, top int, bottom int")
    found = {r.chkey: r.relation for r in soils.horizon_adjacency(h).collect()}
    assert found["h1"] != found["h2"] != found["h3"] and found["h1"] != found["h3"]
    events = spark.createDataFrame([("f", 2, "b"), ("f", 1, "a"), ("g", 1, "c")], "finding string, seq long, kind string")
    assert {r.finding: r.kind for r in event_log.running_state(events, ["finding"], ["seq"]).collect()} == {"f": "b", "g": "c"}


def test_contracts_of_events_and_trees(spark):
    good = '{"event_id":"e","correction_id":"c","status":"accepted","actor":"a","note":"n"}'
    texts = [good, good.replace('"note":"n"', '"notes":"n"'), "[1]", "x", None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(validation.has_exact_keys(F.col("t"))).collect()] == [True, False, False, False, False]
    nothing = spark.createDataFrame([], "k long, p long")
    assert validation.tree_faults([("root", nothing, "k", None), ("leaf", nothing, "k", "p")]).count() == 0
    pairs = spark.createDataFrame([(1, 10, True), (1, 10, True), (2, 20, True), (2, 21, False), (3, 30, True), (4, 30, True)], "a long, b long, ok boolean")
    assert sorted(map(tuple, validation.one_to_one(pairs, "a", "b", F.col("ok")).collect())) == [(1, 10), (2, 20)]
    before = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k long, m double")
    after = spark.createDataFrame([(1, 1.0), (2, 2.0), (4, 4.0)], "k long, m double")
    assert {r.k: r.change for r in ingestion.recomputed(before, after, ["k"], ["m"]).collect()} == {2: "changed", 3: "removed", 4: "added"}


def test_json_paths(spark):
    df = spark.createDataFrame([('{"a/b":{"~":[5,{"0":7}]},"n":null}', "1"), ("x", "1"), (None, "1"), ('{"a":1}', "{")], "t string, v string")
    at = lambda p: [r[0] for r in df.select(json_paths.pointer(F.col("t"), p)).collect()]
    assert at("/a~1b/~0/0")[0] == "5" and at("/a~1b/~0/1/0")[0] == "7" and at("/q") == [None] * 4
    put = [r[0] for r in df.select(json_paths.set_path(F.col("t"), ["a/b", "new"], F.col("v"))).collect()]
    assert json.loads(put[0])["a/b"]["new"] == 1 and put[1:] == [None, None, None]
    assert spark.range(1).select(json_paths.without_flag(F.array(F.lit("a"), F.lit("b"), F.lit("a")), "a")).first()[0] == ["b"]


def test_raster_transforms_turn_back(spark):
    affine = (2.0, 0.5, 100.0, -0.25, -2.0, 900.0)
    df = spark.createDataFrame([(0.0, 0.0), (3.5, 7.25)], "c double, r double").select("c", "r", raster.to_map(F.col("c"), F.col("r"), affine).alias("m"))
    for r in df.select("c", "r", raster.to_pixel(F.col("m.x"), F.col("m.y"), affine).alias("p")).collect():
        assert (r.p.col, r.p.row) == pytest.approx((r.c, r.r))
    north_up = (2.0, 0.0, 100.0, 0.0, -2.0, 900.0)
    assert tuple(spark.range(1).select(raster.footprint(F.lit(10), F.lit(20), north_up)).first()[0]) == (100, 860, 120, 900)
    with pytest.raises(ValueError, match="north-up"):
        raster.footprint(F.lit(1), F.lit(1), affine)


def test_vectors_in_blocks(spark):
    rows = [(k, [float(k % 5), float(k // 5)], k % 2) for k in range(40)] + [(100, None, 1), (101, [1.0], 1), (102, [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, label int")
    got = {r.id: (r.n, r.n_same) for r in vectors.matches_within(df, df, 1.0, tile=7, block=3).collect()}
    for k, v, label in rows:
        near = [(j, other) for j, w, other in rows if j != k and v and w and len(v) == len(w) and sum((a - b) ** 2 for a, b in zip(v, w, strict=True)) <= 1]
        assert got[k] == (len(near), sum(other == label for _, other in near if label is not None))
