import random

import corpus_pipeline
from common import sentence


def test_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(20)
    leak = sentence(rng, 14)
    rows, labels = [], []
    for k in range(400):
        text = "\n".join(sentence(rng, 25) for _ in range(3))
        if k % 8 == 0:
            text = text.replace(" ", " zorgish ", 1)
        if k == 11:
            text += " " + leak
        rows.append([k, text, "en", f"s{k % 4}", len(text)])
        labels.append((k, 1, int(k % 8 == 0)))
    rows[30][1] = rows[29][1] + " one word more"  # another last line, the rest repeated
    rows[33][1] = rows[31][1]  # exact copy
    near = rows[34][1].replace("\n", " ").split()
    near[5] = "changed"
    rows[34][1], rows[35][1] = rows[34][1].replace("\n", " "), " ".join(near)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    everything = set(range(400))
    assert everything - kept[0] == {k for k in range(400) if k % 8 == 0}
    assert kept[0] - kept[1] == {33}
    assert kept[1] - kept[2] == {35}
    assert kept[2] - kept[3] == {11}
    assert kept[4] <= kept[3] and docs.filter("taken > 3 * size or repeats < 1").count() == 0
