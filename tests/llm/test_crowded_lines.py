"""A signature of many lines makes no row for a pair of them."""

from lodestrata.llm import line_dedup
from lodestrata.llm.scratch import Scratch


def test_crowded_lines_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "CHUNK", 4)
    # The first 20 characters are one segment of all; the rest differs by three letters, with equal parities.
    lines = [f"the same opening for all of them {'abcdefghijkl'[k] * 6} and then an end that is fixed" for k in range(12)]
    rows = [*enumerate(lines), (99, lines[5][:-1] + "x")]
    stored = {}

    def keep(df, name):
        stored[name] = Scratch(spark, "c").keep(df, name)
        return stored[name]

    got = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), keep).collect()}
    assert got == {**dict.fromkeys(range(12), 0), 99: 1}
    assert "crowded-late" in stored and stored["rest"].count() == 0
