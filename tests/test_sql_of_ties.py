"""SQL that left ties or unmatched rows to chance, against definitions that cannot."""

import duckdb
import pytest
from lodestrata.operators.sequences import union_length
from lodestrata.plans import registry
from lodestrata.plans.spatial_queries import SPANS_SQL

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_coverage_of_equal_spans(duck):
    cells = f"WITH s AS ({SPANS_SQL}) SELECT k, count(DISTINCT i) AS n FROM s, range(20, 70) r(i) WHERE low <= i AND high > i GROUP BY 1"
    wrong = duck.sql(f"SELECT c.k FROM ({registry.ORACLES['coverage_state']}) c JOIN ({cells}) n USING (k) WHERE abs(covered_fraction * 50 - n.n) > 1e-6")
    assert wrong.fetchall() == []


def test_union_of_equal_spans(spark, duck):
    rows = [(k, *s) for k in range(50) for s in [(0, 2), (10, 12), (10, 12), (10, 12), (30, 31), (30, 31)]]
    df = spark.createDataFrame(rows, "k long, low long, high long")
    assert {r.n for r in union_length(df.repartition(3), ["k"], "low", "high", "n").collect()} == {5}
    wrong = duck.sql(f"WITH s AS ({SPANS_SQL}) SELECT u.k FROM ({registry.ORACLES['interval_union']}) u JOIN (SELECT k, count(DISTINCT i) AS n FROM (SELECT k, unnest(range(low, high)) AS i FROM s) GROUP BY 1) n USING (k) WHERE covered <> n")
    assert wrong.fetchall() == []


def test_every_gate_of_every_place(duck):
    rows = duck.sql(f"SELECT count(*), count(DISTINCT (id, gate)) FROM ({registry.ORACLES['gate_matches']})").fetchall()
    assert rows == [(60000, 60000)]
