"""A JSON text is parsed once a row, however many values are read from it, and equal rings are worked out once."""

from lodestrata.plans import arrangement_queries, registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_soil_rows_are_parsed_once(spark):
    assert plan(registry.QUERIES["soil_rows"](spark, SF)).count("parseJson") == 1


def test_requests_are_parsed_once(spark):
    assert plan(registry.QUERIES["request_validation"](spark, SF)).count("parseJson") == 1


def test_equal_rings_are_cut_once(spark):
    rings = registry.QUERIES["ring_contacts"](spark, SF)
    below = plan(rings).split("ArrowEvalPython")
    assert len(below) == 2 and "Aggregate" in below[1]


def test_equal_subjects_share_their_faces(spark, monkeypatch):
    seen, faces = [], arrangement_queries.dissolve.faces
    monkeypatch.setattr(arrangement_queries.dissolve, "faces", lambda df, *rest: (seen.append(df.count()), faces(df, *rest))[1])
    part = spark.createDataFrame([(1 + 3000 * k, 6) for k in range(4)] + [(2, 6)], "p_partkey long, p_size int")
    rows = arrangement_queries.face_reviews(type("T", (), {"part": part, "spark": spark})).collect()
    assert seen == [2] and len({r.id for r in rows}) == 5 and len(rows) == 4 * 3 + 2
