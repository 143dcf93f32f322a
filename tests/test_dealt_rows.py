"""Operators whose tasks hold a number of rows that does not grow with the table."""

from decimal import Decimal

import pytest
from lodestrata.operators import sequences
from pyspark.sql import functions as F


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(sequences, "TASK_ROWS", 100)


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_interval_lengths(spark, small_tasks):
    spans = [(0.0, 0.1), (0.1, 0.2), (0.2, 0.3), (5.0, 5.0), (7.0, 9.0), (7.5, 8.0), (7.0, 9.0), (9.5, 9.0), (None, 3.0), (12.0, 13.0)]
    df = spark.createDataFrame([(k, *s) for k in range(400) for s in spans] + [(None, 1.0, 2.0), (-1, 3.0, 2.0)], "k long, low double, high double").repartition(3)
    out = sequences.union_length(df, ["k"], "low", "high", "n")
    assert {(r.k is None, r.n) for r in out.collect()} == {(False, 0.3 + 0.0 + 2.0 + 1.0), (True, 1.0)}
    assert out.filter("k < 0").count() == 0
    assert most_in_a_task(out) < 60  # 401 groups
    both = sequences.union_lengths(df, ["k"], "low", "high", {"whole": None, "base": F.col("low") % 5 == 0, "none": F.col("low") > 99})
    assert {tuple(r)[1:] for r in both.filter("k >= 0").collect()} == {(3.3, 0.1, None)}
    islands = sequences.interval_islands(df.filter("k < 2"), ["k"], "low", "high").filter("k = 1").orderBy("low").collect()
    assert [(r.low, r.high) for r in islands] == [(0.0, 0.3), (5.0, 5.0), (7.0, 9.0), (12.0, 13.0)]


def test_mixtures(spark, small_tasks):
    rows = [(k, Decimal(p)) for k in range(800) for p in (40, 40, 20)] + [(-1, None), (-1, Decimal(5)), (None, Decimal(101)), (-2, None)] + [(-3, Decimal(1))] * 500
    df = spark.createDataFrame(rows, "k long, p decimal(10,2)").repartition(3)
    out = sequences.mixture_state(df, ["k"], "p")
    got = {r.k: tuple(r)[1:] for r in out.collect()}
    assert {got.pop(k) for k in range(800)} == {(3, Decimal(100), 0, Decimal(40), 2, "sums_to_100")}
    assert got == {-1: (2, Decimal(5), 1, Decimal(5), 1, "unknown"), -2: (1, None, 1, None, 0, "unknown"), -3: (500, Decimal(500), 0, Decimal(1), 500, "over_100"), None: (1, Decimal(101), 0, Decimal(101), 1, "over_100")}
    assert most_in_a_task(out) < 100  # 804 units
