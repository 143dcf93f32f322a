"""The ways that only large inputs take, forced on small ones; results must be the same."""

import random

import test_free
import test_native
from common import sentence

from lodestrata.llm import components, decontaminate, line_dedup, mixing
from lodestrata.llm.scratch import Scratch


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    monkeypatch.setattr(decontaminate, "BROADCAST_TOKENS", -1)
    monkeypatch.setattr(line_dedup, "BROADCAST_IDS", -1)
    test_native.test_mix_comes_near_targets_and_repeats(spark)
    test_native.test_windows_equal_brute_force(spark)
    test_native.test_lines_equal_brute_force(spark)


def test_components_by_alternating_stars(spark, monkeypatch):
    monkeypatch.setattr(components, "ONE_TASK", -1)
    test_free.test_components(spark)


def test_lines_of_one_template(spark, monkeypatch):
    """Lines that share most of their words but are far apart, near copies of some among them: chunks, not pairs."""
    monkeypatch.setattr(line_dedup, "CHUNK", 4)
    monkeypatch.setattr(line_dedup, "TASK_PAIRS", 50)
    rng = random.Random(4)
    base = sentence(rng, 14).split()
    lines = []
    for _ in range(120):
        words = list(base)
        words[rng.randrange(14)] = sentence(rng, 1) + sentence(rng, 1)
        line = " ".join(words)
        lines += [line, test_native.near_line(rng, line)] if rng.random() < 0.3 else [line]
    rng.shuffle(lines)
    rows = list(enumerate(lines))
    stored = {}

    def keep(df, name):
        stored[name] = Scratch(spark, "t").keep(df, name)
        return stored[name]

    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep).collect()}
    seen = []
    for k, line in rows:
        near = any(abs(len(x) - len(line)) <= 2 and test_native.distance(x, line) <= 2 for x in seen)
        assert got[k] == int(near), (k, line)
        seen.append(line)
    assert 10 < sum(got.values()) < 100
    # A signature proposes one line to each probe, whatever the size of its group.
    assert stored["hits"].count() <= 19 * len(set(lines))
    assert stored["rows"].filter("size(lines) > 24").count() == 0
