import json
import sqlite3
import struct
import zipfile

import pytest
from lodestrata.functions import dates, digest, scalars
from lodestrata.geometry import frames
from lodestrata.operators import boxes, history, raster, sequences
from lodestrata.sources import binary_formats, captures, sinks
from lodestrata.streaming import event_log
from pyspark.sql import functions as F


def test_dates(spark):
    raw = ["2011", "4/1/2011", "20240229", None, "", " ", "0", "20", "20230229", "13/1/2020"]
    got = [r.d for r in spark.createDataFrame([(x,) for x in raw], "x string").select(dates.parse_date(F.col("x")).alias("d")).collect()]
    assert [d.value for d in got] == ["2011", "2011-04-01", "2024-02-29"] + [None] * 7
    assert [d.precision for d in got[:3]] == ["year", "day", "day"] and all(d.state == "UNKNOWN" for d in got[3:])


def test_canonical_json(spark):
    rows = ['{"b": 2, "a": {"d": 1, "c": "é"}}', "not json", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(digest.canonical_json(F.col("x"))).collect()]
    assert got == ['{"a":{"c":"\\u00e9","d":1},"b":2}', None, None]


def test_scalars(spark):
    row = spark.sql("select map('a', 1, 'b', 2) m, map('b', 3) c, '{\"A.b\": 5, \"k\": [1]}' j, unhex('01020000') b").select(
        scalars.merged(F.col("m"), F.col("c")).alias("m"), scalars.field(F.col("j"), "A.b").alias("f"), scalars.has_all_keys(F.col("j"), "A.b", "k").alias("h"),
        scalars.json_kind(F.col("j")).alias("kind"), scalars.little_endian_int(F.col("b"), 1).alias("n"), scalars.clamp01(F.lit(1.5)).alias("one"), scalars.decrease(F.lit(1.0), F.lit(1.005)).alias("zero"),
        scalars.range_sanity(F.lit(3), F.lit(2), F.lit(5)).alias("r"), scalars.exactly_one(F.lit(True), F.lit(None).cast("boolean")).alias("x"),
    ).first()
    assert row.m == {"a": 1, "b": 3} and row.f == "5" and row.h and row.kind == "object" and row.n == 513
    assert (row.one, row.zero, row.r, row.x) == (1.0, 0.0, "inverted", True)
    with pytest.raises(Exception, match="grew"):
        spark.range(1).select(scalars.decrease(F.lit(1.0), F.lit(2.0))).collect()


def test_geopackage_and_wkb(spark):
    ring = [[0.0, 0.0], [0.0, 1.0], [1.0, 1.0], [0.0, 0.0]]
    wkb = binary_formats.polygon_wkb([ring])
    blob = b"GP\0\1" + struct.pack("<i", 26919) + wkb
    boxed = b"GP\0\3" + struct.pack("<i", 5070) + bytes(32) + wkb
    df = spark.createDataFrame([(1, blob), (2, boxed), (3, b"xx"), (4, None)], "id int, b binary")
    got = {r.id: r.g for r in df.select("id", binary_formats.geopackage_geometry("b").alias("g")).collect()}
    assert (got[1].srid, got[2].srid, got[3].hold, got[4].hold) == (26919, 5070, "bad header", "missing")
    assert binary_formats.wkb_rings(bytes(got[2].wkb)) == [[ring]]
    polygons = df.select(binary_formats.decoded_wkb(binary_formats.geopackage_geometry("b")["wkb"]).alias("p")).collect()
    assert polygons[0].p == [[ring]] and polygons[3].p is None


def test_archives(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.sqlite")
    con.execute("create table t (k int, v text)")
    con.executemany("insert into t values (?, ?)", [(k, f"v{k}") for k in range(10)])
    con.commit()
    con.close()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/x.csv", "a,b\n1,2\n")
        z.writestr("skip.txt", "no")
    (tmp_path / "p.html").write_text('<html><base href="https://e.org/d/"><a href="x.pdf">x</a><a href="/y">y</a></html>')
    files = captures.archived_files(spark, str(tmp_path))
    kinds = {r.path.rsplit("/", 1)[1]: r.k for r in files.select("path", captures.file_signature(F.col("content")).alias("k")).collect()}
    assert kinds == {"a.sqlite": "sqlite", "z.zip": "zip", "p.html": "html"}
    assert binary_formats.sqlite_rows(files.filter("path like '%sqlite'"), "t", ["k", "v"], "k long, v string", "k >= 7").count() == 3
    members = binary_formats.zip_members(files.filter("path like '%zip'"), ".csv").collect()
    assert [(m.member, bytes(m.content)) for m in members] == [("in/x.csv", b"a,b\n1,2\n")]
    links = files.filter("path like '%html'").select(binary_formats.page_links(F.lit("https://e.org/q"), F.decode("content", "UTF-8")).alias("l")).first().l
    assert links == ["https://e.org/d/x.pdf", "https://e.org/y"]
    parts = captures.chunk_digests(files, 7)
    assert parts.groupBy("path").agg(F.sum("bytes").alias("n")).join(files, "path").filter("n <> bytes").count() == 0
    manifest = files.select(F.col("path").alias("id"), F.col("path").alias("file"), "bytes", "sha256")
    assert captures.verify_archive(manifest, manifest).count() == 0
    broken = manifest.withColumn("sha256", F.when(F.col("id").endswith("zip"), "0").otherwise(F.col("sha256")))
    assert [r.reason for r in captures.verify_archive(broken, manifest).collect()] == ["digest"]
    pieces = spark.createDataFrame([("f", 1, b"cd"), ("f", 0, b"ab")], "file string, part int, content binary")
    assert bytes(captures.reassembled(pieces).first().content) == b"abcd"
    stored = sinks.archive_objects(files, str(tmp_path / "store"))
    assert stored.count() == 3 and spark.read.parquet(str(tmp_path / "store/objects")).count() == 3
    sinks.archive_objects(files, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store/objects")).count() == 3


def test_service_pages(spark):
    geo = json.dumps({"type": "FeatureCollection", "features": [{"properties": {"OBJECTID": 1}, "geometry": {"type": "Point"}}, {"properties": {"OBJECTID": 2}, "geometry": None}]})
    rows = captures.feature_pages(spark.createDataFrame([(geo,)], "body string")).collect()
    assert [r.properties["OBJECTID"] for r in rows] == ["1", "2"]
    wrong = json.dumps({"crs": {"properties": {"name": "EPSG:3857"}}, "features": [{}]})
    with pytest.raises(Exception, match="coordinate system"):
        captures.feature_pages(spark.createDataFrame([(wrong,)], "body string")).collect()
    esri = json.dumps({"features": [{"attributes": {"OBJECTID": 7}, "geometry": {"rings": [[[0, 0], [0, 1], [1, 1], [0, 0]]]}}]})
    f = captures.ring_features(spark.createDataFrame([(esri,)], "body string"), "OBJECTID").first()
    assert f.object_id == 7 and f.rings[0][1] == [0.0, 1.0]
    decoded = captures.ring_features(spark.createDataFrame([(esri,)], "body string"), "OBJECTID").select(frames.decoded_rings("rings").alias("d")).first().d
    assert decoded.hold is None and len(decoded.region) == 1
    table = json.dumps({"Table": [["a", "b"], ["1", "2"], ["3", None]]})
    assert [r.record for r in captures.header_rows(spark.createDataFrame([(table,)], "body string")).collect()] == [{"a": "1", "b": "2"}, {"a": "3", "b": None}]
    out = spark.createDataFrame([(200, "{}", None), (200, "<x>", None), (404, "", None), (200, '{"error": 1}', None), (None, None, "timeout")], "s int, b string, e string")
    assert [r[0] for r in out.select(captures.outcome(F.col("s"), F.col("b"), F.col("e"))).collect()] == ["JSON_RECEIVED", "NON_JSON", "HTTP_ERROR", "API_ERROR", "REQUEST_FAILED"]
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    pages = spark.createDataFrame([(1,), (1,), (4,)], "id long")
    assert {(r.id, r.reason) for r in captures.page_drift(pages, ids, "id").collect()} == {(1, "repeated"), (2, "missing"), (3, "missing"), (4, "unexpected")}
    chunks = captures.key_chunks(spark.range(45).withColumnRenamed("id", "k"), "k").collect()
    assert sorted(k for c in chunks for k in c["keys"]) == list(range(45)) and max(len(c["keys"]) for c in chunks) <= 20
    source = "X = {'a': 1, 'b': 'z'}\nY = open('no')\n"
    assert spark.createDataFrame([(source,), ("((",)], "s string").select(binary_formats.literal_dictionary("s").alias("d")).collect()[0].d == {"a": "1", "b": "z"}


def test_event_stream_replays_change_nothing(spark, tmp_path):
    schema = "event_id long, finding string, seq long, kind string"
    log, checkpoint, inbox = (str(tmp_path / n) for n in ("log", "checkpoint", "inbox"))
    first = [(1, "f1", 1, "open"), (2, "f1", 2, "resolved"), (3, "f2", 3, "open")]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(inbox)
    run = lambda: event_log.append_stream(event_log.read_events(spark, inbox, schema), log, ["event_id"], checkpoint).awaitTermination()
    run()
    spark.createDataFrame([*first, (5, "f1", 5, "seen"), (4, "f2", 4, "resolved")], schema).coalesce(1).write.mode("append").parquet(inbox)
    run()
    assert spark.read.parquet(log).count() == 5
    state = {r.finding: r.kind for r in event_log.current_state(spark, log, ["finding"], ["seq"]).collect()}
    assert state == {"f1": "seen", "f2": "resolved"}
    assert {r.finding: r.needs_revisit for r in event_log.late_flags(spark, log, ["finding"], "resolved", "seen", "seq").collect()} == {"f1": True, "f2": False}
    with pytest.raises(ValueError):
        sinks.append_new(spark.createDataFrame([(1, "f1", 1, "changed")], schema), log, ["event_id"])
    assert sinks.append_new(spark.createDataFrame(first, schema), log, ["event_id"]) == 0


def test_sealed_batches(spark, tmp_path):
    batch = str(tmp_path / "b")
    rows = spark.createDataFrame([("x", 1, "d1")], "k string, id int, d string")
    sinks.write_once(rows, batch)
    with pytest.raises(Exception, match="already exists"):
        sinks.write_once(rows, batch)
    assert not sinks.is_sealed(batch, spark)
    manifest = digest.ordered_fingerprint(rows, ["k"], ["id"], "d")
    assert history.incomplete_batches(rows, manifest, ["k"], "id", "d").count() == 0
    sinks.seal(batch, spark, manifest)
    assert sinks.is_sealed(batch, spark)


def test_grids(spark):
    cells = [(r, c, 2.0 * c + 3.0 * r + 10, True) for r in range(5) for c in range(5)]
    grid = spark.createDataFrame(cells, "row int, col int, value double, valid boolean")
    slopes = raster.horn_slope(grid).collect()
    assert len(slopes) == 9 and all(abs(s.slope - 74.498640433) < 1e-6 for s in slopes)
    targets = spark.createDataFrame([(1.5, 2.25), (4.5, 1.0)], "y double, x double")
    got = {r.y: r.sample for r in raster.bilinear(grid, targets).collect()}
    assert got[1.5] == 2 * 2.25 + 3 * 1.5 + 10 and got[4.5] is None
    assert {r.sample for r in raster.nearest(grid, targets.limit(1)).collect()} == {2.0 * 2 + 3.0 * 2 + 10}


def test_boxes_and_sequences(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0)], "id long, xmin double, ymin double, xmax double, ymax double")
    b = spark.createDataFrame([(1, 10.0, 0.0, 12.0, 5.0), (2, 5.0, 5.0, 30.0, 30.0), (3, 11.0, 11.0, 12.0, 12.0)], a.schema)
    got = {r.b_id: r.area for r in boxes.box_pairs(a, b, "id", "id", 4.0).select("b_id", boxes.overlap_area().alias("area")).collect()}
    assert got == {1: 0.0, 2: 25.0}
    spans = spark.createDataFrame([("k", 0, 5), ("k", 5, 7), ("k", 9, 12), ("k", 10, 11)], "k string, lo int, hi int")
    assert sequences.union_length(spans, ["k"], "lo", "hi", "n").first().n == 10
    tile = spark.createDataFrame([(0.0, 0.0), (10.0, 10.0), (4.9, 5.0)], "x double, y double").select(boxes.tile_of(F.col("x"), F.col("y"), 0, 0, 10, 10).alias("t")).collect()
    assert [t.t for t in tile] == [0, 15, 9]


