"""Each query of the library against its SQL on the smallest tables."""

import duckdb
import pytest
from lodestrata.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(value):
    if value is None or value != value:
        return "~"
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return f"{float(value):.8g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in got.columns]
    a = sorted("|".join(map(shown, r)) for r in got.collect())
    b = sorted("|".join(shown(r[k]) for k in place) for r in want.fetchall())
    assert a == b
