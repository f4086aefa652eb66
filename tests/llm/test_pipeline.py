"""The pipeline's stages on a small corpus with planted cases."""

import numpy as np

import corpus_pipeline
from tests.llm.test_operators import prose


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(800):
        kind = "toxic" if i % 8 == 1 else "junk" if i % 8 == 2 else "good"
        text = " | ".join(prose(rng, 1).upper() for _ in range(70)) if kind == "junk" else prose(rng, 70, "blockhead" if kind == "toxic" else "")
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 2 or i % 8 == 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    passage = prose(rng, 20)
    clean = docs[3][1]
    extra = [(900, clean, "en", "s", 1), (901, clean + " more words here", "en", "s", 1), (902, passage + " " + prose(rng, 40), "en", "s", 1), (903, prose(rng, 60), None, None, None)]
    spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    good = {i for i in range(800) if i % 8 not in (1, 2)}
    assert len(good - set(got)) <= 0.02 * len(good)
    assert {i for i in (3, 900, 901, 902) if i in got} == {3}
    assert sum(i in got for i in range(800) if i % 8 in (1, 2)) <= 4
    assert all(len(r.ids) == 4 * r.n_tokens for r in got.values())
