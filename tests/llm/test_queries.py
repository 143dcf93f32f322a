"""The registered queries: against their SQL, and where there is none against plain definitions."""

import math
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from common import SCHEMA, corpus
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestrata.llm import decontaminate, line_dedup, mixing, queries, toxicity
from lodestrata.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
#: Names that operators add or use inside.
TAKEN = ["score", "rejected", "n_lines", "n_removed", "kept_text", "gone", "_key", "_near", "_r", "n_words", "hit", "item_ids", "source_size", "target", "taken", "repeats", "_source", "_whole", "_cut", "_row", "group", "at", "line", "Near", "LINE_ID"]


def test_entry_has_all_queries():
    assert {f"op{k}" for k in range(1, 14)} | {"pipeline"} == {n.split("_")[0] for n in entry.queries() if n in queries.QUERIES or n == "pipeline"}
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    place = [want.columns.index(c) for c in got.columns]
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted("|".join(map(show, r)) for r in got.collect()) == sorted("|".join(show(r[k]) for k in place) for r in want.fetchall())


def plain_logit(model, text):
    """The network word by word: embeddings, each filter at each position, the greatest response, the logistic layer."""
    words = toxicity.WORD.findall((text or "").lower())
    zero = np.zeros(toxicity.DIM)
    e = [model.e1[toxicity._bucket(w)].astype(float) + model.e2[toxicity._bucket(w[: toxicity.STEM])] for w in words] + [zero] * (toxicity.PAD + 1)
    z, k = model.base, 0
    for width, w, bias in zip(toxicity.WIDTHS, model.filters, model.bias, strict=True):
        for f in range(toxicity.FILTERS):
            best = max(sum(float(e[i + j] @ w[j][:, f]) for j in range(width)) + float(bias[f]) for i in range(len(words) + 1))
            z += max(best, 0) * float(model.out[k])
            k += 1
    return z


def test_toxicity_query(spark):
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert set(got) == set(texts)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    for k in sorted(texts)[:40]:
        z = plain_logit(model, texts[k]) + model.shift
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)


def awkward(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return docs.withColumns({c: F.lit(f"own {c}") for c in TAKEN})


def test_operators_keep_columns_of_any_name(spark):
    docs = awkward(spark)
    items = spark.createDataFrame([(1, "ba be bi"), (2, None)], "item_id long, text string")
    keep = Scratch(spark, "names").keep
    results = {
        ("n_lines", "n_removed", "kept_text"): line_dedup.dedup_lines(docs, keep),
        ("n_words", "hit", "item_ids"): decontaminate.decontaminate(docs, items, keep),
        ("source_size", "target", "taken", "repeats"): mixing.mix(docs.withColumn("size", mixing.word_count(F.col("text")))),
    }
    for added, out in results.items():
        own = [c for c in TAKEN if c not in added]
        rows = out.select(*own).collect()
        assert len(rows) == docs.count() and all(r[c] == f"own {c}" for r in rows for c in own)
        assert not any(str(r[c]).startswith("own ") for r in out.select(*added).collect() for c in added)


def test_columns_named_like_internal_ones_do_not_change_texts(spark):
    """A user's column of the same name and type as an internal one must not be taken for it."""
    text = "first line of a text that is long enough to be compared\nsecond line, which is long enough as well, of course\nthird line of that text, again with some more words"
    rows = [(1, text), (2, text.split("\n")[1] + "\nand one line that occurs here only, in this document")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keep = Scratch(spark, "same").keep
    show = lambda df: sorted((r.doc_id, r.n_removed, r.kept_text) for r in df.collect())
    plain = show(line_dedup.dedup_lines(docs, keep))
    assert [r[1] for r in plain] == [0, 1]
    clashing = docs.withColumns({"gone": F.array(F.lit(0)), "_added0": F.lit(5), "lines": F.array(F.lit("x")), "g": F.lit(7)})
    out = line_dedup.dedup_lines(clashing, keep)
    assert show(out) == plain and {(tuple(r.gone), r._added0, r.g) for r in out.collect()} == {((0,), 5, 7)}


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows and clashing names go through every stage; what is clean and single stays."""
    docs = awkward(spark)
    spark.createDataFrame([(k, 1, 0) for k in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "no such words in any text at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    alone = {r.doc_id for r in docs.collect() if r.text is None or not r.text.strip()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        last = name == corpus_pipeline.STAGES[-1][0]
        if not last:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows = docs.collect()
        added = ("source_size", "target", "taken", "repeats") if last else ()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in TAKEN if c not in added)
        if not last:
            assert alone <= {r.doc_id for r in rows}
    assert sum(r.taken for r in rows) > 0


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
