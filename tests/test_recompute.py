"""Incremental recomputation, identities and the single writer."""

import pytest
from lodestrata.functions import digest
from lodestrata.functions.stages import Stages
from lodestrata.products import recompute
from lodestrata.streaming import single_writer
from pyspark.sql import functions as F

REGION = "id long, region array<array<array<array<double>>>>"


def box(x, y, w, h):
    return [[[[float(a), float(b)] for a, b in ((x, y), (x, y + h), (x + w, y + h), (x + w, y), (x, y))]]]


def test_only_changed_subjects_are_computed_again(spark):
    subjects = spark.createDataFrame([(k, box(20 * k, 0, 10, 10)) for k in range(6)], REGION)
    inputs = {k: box(20 * k + 2, 2, 5, 5) for k in range(5)} | {9: box(500, 0, 1, 1)}
    calls = []

    def compute(s, i):
        calls.append((sorted(r.id for r in s.select("id").collect()), sorted(r.id for r in i.select("id").collect())))
        return recompute.covered_areas(s, i, 8.0, Stages(spark, "covered"))

    make = lambda d: spark.createDataFrame(list(d.items()), REGION)
    stages = Stages(spark, "recompute")
    stored = stages.keep(recompute.computed(subjects, make(inputs), compute, 8.0), "stored")
    changed = inputs | {1: box(22, 2, 4, 5), 4: box(700, 0, 1, 1), 9: box(105, 5, 2, 2)}
    del changed[3]
    again = {r.id: r for r in recompute.recomputed(stored, subjects, make(changed), compute, 8.0, stages).collect()}
    full = {r.id: r for r in recompute.computed(subjects, make(changed), compute, 8.0).collect()}
    assert calls[1] == ([1, 3, 4, 5], [1, 9])  # what moved, left, or came; and the inputs that meet those
    for k, r in full.items():
        assert (again[k].covered, again[k].area, again[k].dependencies) == (pytest.approx(r.covered), pytest.approx(r.area), r.dependencies)
    assert {k for k, r in again.items() if r.recomputed} == {1, 3, 4, 5}
    assert [again[k].covered for k in range(6)] == pytest.approx([25, 20, 25, 0, 0, 4])
    with pytest.raises(ValueError, match="membership"):
        recompute.recomputed(stored, subjects.filter("id <> 2"), make(inputs), compute, 8.0, Stages(spark, "recompute"))
    extra = subjects.unionByName(spark.createDataFrame([(77, box(0, 0, 1, 1))], REGION))
    assert [tuple(r) for r in recompute.membership_faults(stored, extra).collect()] == [(77, "added")]


def test_last_event_decides_the_shape(spark):
    sources = spark.createDataFrame([(k, box(0, 0, 1, 1)) for k in range(4)], REGION)
    proposals = spark.createDataFrame([(k, box(5, 5, 1, 1)) for k in (0, 1, 2, 8)], REGION)
    events = spark.createDataFrame([(0, 1, "accepted"), (1, 1, "accepted"), (1, 2, "withdrawn"), (8, 1, "accepted"), (3, 1, "accepted")], "id long, seq long, status string")
    out = {r.id: r.basis for r in recompute.accepted_shapes(sources, proposals, events).collect()}
    assert out == {0: "accepted", 1: "source", 2: "source", 3: "source"}


def test_identities_ignore_order_and_count_repeats(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "y"), ("b", "x"), ("c", "x"), ("c", "x"), ("d", None), ("e", ""), (None, "x")]
    df = spark.createDataFrame(rows, "g string, d string").repartition(3)
    got = {r.g: r for r in digest.tree_fingerprint(df, ["g"], "d").collect()}
    assert got["a"].fingerprint == got["b"].fingerprint
    assert len({got[k].fingerprint for k in ("a", "c", "d", "e", None)}) == 5
    assert digest.tree_fingerprint(df.limit(0), [], "d").first().fingerprint == digest.EMPTY_FINGERPRINT


def test_single_writer(spark, tmp_path):
    schema = "k string, request_id long, expected_id long, at long"
    inbox, log, checkpoint = (str(tmp_path / n) for n in ("inbox", "log", "checkpoint"))

    def put(*rows):
        made = spark.createDataFrame(rows, schema)
        made.coalesce(1).write.mode("append").parquet(inbox)
        single_writer.run_writer(spark, inbox, made.schema, "k", log, checkpoint)
        return {(r.key, r.request_id): (r.decision, r.seq) for r in single_writer.read_log(spark, log).collect()}

    first = put(("a", 1, None, 10), ("a", 2, None, 11), ("b", 5, 4, 1))  # two requests expect an empty key: one wins
    assert first == {("a", 1): ("append", 1), ("a", 2): ("stale", None), ("b", 5): ("stale", None)}
    second = put(("a", 3, 1, 12), ("a", 1, None, 10), ("a", 4, 1, 13), (None, 9, None, 1), ("b", 5, 4, 1))
    assert second == first | {("a", 3): ("append", 2), ("a", 4): ("stale", None), (None, 9): ("append", 1)}
    third = put(("a", 4, 3, 14), ("b", 6, None, 2), ("a", 7, 3, 15))  # 4 was decided before, whatever it says now
    assert third == second | {("b", 6): ("append", 1), ("a", 7): ("append", 3)}
    rows = single_writer.read_log(spark, log)
    assert rows.count() == len(third)
    assert {(r.key, r.head_id, r.n_appended) for r in single_writer.heads(rows).collect()} == {("a", 7, 3), ("b", 6, 1), (None, 9, 1)}
    expected = spark.createDataFrame([("a", 3), ("b", 6), ("z", 1)], "key string, head_id long")
    assert {(r.key, r.state) for r in single_writer.publishable(expected, rows).collect()} == {("a", "moved"), ("b", "current"), ("z", "unknown")}
    assert rows.filter(F.col("decision") == "append").groupBy("key", "seq").count().filter("count > 1").count() == 0


class Held:
    """A state in memory that counts its calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    getMapState = lambda self, name, key, value: self  # noqa: E731, N815

    def get(self):
        self.calls += 1
        return self.value

    def exists(self):
        self.calls += 1
        return self.value is not None

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self.map.get(key)

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self.map

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self.map[key] = value


def test_requests_of_a_key_are_decided_together():
    state, writer = Held(), single_writer.Decide()
    writer.init(state)
    decide = lambda rows: list(writer.handleInputRows(("a",), iter([dict(zip(("request_id", "expected_id", "at"), r, strict=True)) for r in rows]), None))
    chain = [(7 * k, 7 * (k - 1) if k else None, k) for k in range(5000)]
    first = decide(chain[:400][::-1])
    assert [(r.request_id, r.decision, r.seq) for r in first] == [(7 * k, "append", k + 1) for k in range(400)]
    assert state.calls < 10
    assert decide(chain[:400]) == []
    seen = [r for k in range(400, 5000, 50) for r in decide(chain[k : k + 50] + chain[k - 3 : k + 1] + [(-k, 1, k)])]
    assert [r.request_id for r in seen if r.decision == "append"] == [7 * k for k in range(400, 5000)]
    assert sorted(r.request_id for r in seen if r.decision == "stale") == sorted(-k for k in range(400, 5000, 50))
    assert decide(chain) == []
    assert len(state.map) > 4 and max(len(v[0]) for v in state.map.values()) < 3 * 8 * single_writer.PART
