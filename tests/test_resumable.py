"""Fingerprints in order, hashed by one task after the other."""

import hashlib
import random

import pytest
from lodestrata.functions import digest, resumable


@pytest.mark.parametrize("openssl", [True, False])
def test_a_hash_goes_on_from_its_state(openssl, monkeypatch):
    if not openssl:
        monkeypatch.setattr(resumable, "_openssl", lambda: None)
    rng = random.Random(1)
    for cuts in ([0], [0, 0], [55], [56], [63, 1], [64, 64], [1, 200, 64, 7]):
        parts, state = [rng.randbytes(n) for n in cuts], None
        for part in parts:
            h = resumable.Sha256(state)
            h.update(part)
            state = h.state()
        assert resumable.Sha256(state).hexdigest() == hashlib.sha256(b"".join(parts)).hexdigest()


def test_no_task_has_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(digest, "RANGE_LINES", 100)
    kept, chained = [], digest._chained
    monkeypatch.setattr(digest, "_chained", lambda pieces: kept.append(pieces) or chained(pieces))
    rng = random.Random(2)
    rows = [(g, k % (n // 2 + 1), d) for g, n in [("a", 850), ("b", 1), (None, 420), ("c", 230), ("d", 3), ("e", 90), ("", 150)] for k in range(n) for d in [rng.choice(["x", "y", "z" * 70, "", None])]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, d string").repartition(5)
    got = {r.g: (r.n_rows, r.fingerprint) for r in digest.ordered_fingerprint(df, ["g"], ["k"], "d").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        lines = sorted((k, "" if d is None else f"{k}:{d}\n") for h, k, d in rows if h == g)
        want[g] = (len(lines), hashlib.sha256("".join(x for _, x in lines).encode()).hexdigest())
    assert got == want
    assert kept[0].groupBy("_range").agg(digest.F.sum("n_rows").alias("n")).agg(digest.F.max("n")).first()[0] < 400  # the largest group has 850 rows and more


def test_batches_are_complete_by_their_manifest(spark, monkeypatch):
    from lodestrata.operators import history

    monkeypatch.setattr(digest, "RANGE_LINES", 100)
    rows = [(b, k, f"{b}{k}") for b, n in (("a", 450), ("b", 120), ("c", 30)) for k in range(n)]
    df = spark.createDataFrame(rows, "b string, k long, d string").repartition(3)
    manifest = digest.ordered_fingerprint(df, ["b"], ["k"], "d")
    changed = df.withColumn("d", digest.F.when((digest.F.col("b") == "a") & (digest.F.col("k") == 449), "other").otherwise(digest.F.col("d")))
    assert history.incomplete_batches(df, manifest, ["b"], "k", "d").count() == 0
    assert [r.b for r in history.incomplete_batches(changed, manifest, ["b"], "k", "d").collect()] == ["a"]
