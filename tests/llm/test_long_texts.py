"""Texts of millions of characters through the operators that hold a text whole; memory is in proportion to the longest text of a batch."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import chunk_store, positive_unlabelled, string_kernel
from tests.llm.test_operators import prose

LONG = ["word " * 600_000, "x" * 1_500_000, "né\n" * 500_000, " " * 1_000_000]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, at = np.random.default_rng(4), tmp_path_factory.mktemp("long")
    docs = [(i, prose(rng, 40, "blockhead" if i % 4 == 0 else ""), "en", "s", 1) for i in range(240)] + [(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(LONG)] + [(2000, LONG[0] + "blockhead", None, None, None)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(240)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    spark.createDataFrame([(1, prose(rng, 20))], "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}"


def test_scores_read_whole_texts(spark, corpus):
    """The insult that ends three million characters counts; every long text has a score."""
    toxic = {r.doc_id: r for r in string_kernel.op8_string_kernel(spark, corpus).collect()}
    assert toxic[2000].predicted == 1 and toxic[1000].predicted == 0 and len(toxic) == 245
    quality = {r.doc_id: r.score for r in positive_unlabelled.op2_positive_unlabelled(spark, corpus).collect()}
    assert len(quality) == 245 and all(0 <= x <= 1 for x in quality.values())


def test_stored_ids_of_long_texts(spark, corpus):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in chunk_store.op3_chunk_store(spark, corpus).collect()}
    for i, t in enumerate(LONG):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (got[1000 + i].n_tokens, got[1000 + i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_long_texts_pass_the_stages(spark, corpus):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, corpus).collect()}
    assert 2000 not in got  # toxic
    for i, t in enumerate(LONG):
        if 1000 + i in got:  # what the quality of so odd a text is, labels decide
            assert got[1000 + i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
