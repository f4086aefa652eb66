"""The queries themselves on the smallest tables: columns, types, rows, and the SQL of those that have one."""

import hashlib
import zlib
from collections import defaultdict
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from sparkloom.llm import bpe, hilbert, positive_unlabelled, registry, string_kernel

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the tables are not here")

CONTRACT = {
    "op1_style_tree": ("pages", "page_id long, url string, text string, n_chars long"),
    "op2_positive_unlabelled": ("documents", "doc_id long, held_out boolean, score double, predicted int"),
    "op3_chunk_store": ("documents", "doc_id long, start long, n_tokens long, ids_crc32 long"),
    "op4_byte_bpe": ("documents", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"),
    "op5_revisit": (None, "record_id long, canonical_url string, state string, resolved_id long, headers string"),
    "op6_hilbert_shards": ("documents", "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"),
    "op7_winnowing": ("documents", "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"),
    "op8_string_kernel": ("documents", "doc_id long, held_out boolean, score double, predicted int"),
    "op9_hilbert_search": (None, "query_id long, rank int, vec_id long, score double"),
    "op10_prefix_tree_join": ("documents", "doc_id long, n_shingles long, component_id long"),
    "op11_merkle_manifest": ("documents", "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"),
    "op12_vector_codes": ("embeddings", "vec_id long, code string, error long, label_error long, codebooks_sha256 string"),
    "op13_chat_format": (None, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"),
}


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from '{p}'")
    return db


@pytest.fixture(scope="module")
def results(spark):
    got = {}

    def of(name):
        if name not in got:
            df = registry.QUERIES[name](spark, str(DATA))
            got[name] = ({f.name: f.dataType.simpleString().replace("bigint", "long") for f in df.schema.fields}, df.collect())
        return got[name]

    return of


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_columns_and_rows(results, duck, name):
    table, columns = CONTRACT[name]
    kinds, rows = results(name)
    assert kinds == dict(c.split(" ") for c in columns.split(", "))
    if table:
        key = columns.split(" ")[0]
        assert sorted(r[key] for r in rows) == sorted(x[0] for x in duck.execute(f"select {key} from {table}").fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(results, duck, name):
    found = duck.execute(registry.ORACLE_SQL[name])
    names = sorted(c[0] for c in found.description)
    at = [[c[0] for c in found.description].index(n) for n in names]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[n] for n in names) for r in results(name)[1]), key=repr) == want


def test_scores_are_learnt_without_held_out_labels(results, duck):
    for name, label, least in (("op2_positive_unlabelled", "quality", 0.3), ("op8_string_kernel", "toxic", 0.5)):
        rows = results(name)[1]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= least) for r in rows)


def test_ids_equal_the_libraries(results, duck):
    docs = dict(duck.execute("select doc_id, coalesce(text, '') from documents").fetchall())
    json_file, ranks = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    at = 0
    for r in sorted(results("op3_chunk_store")[1], key=lambda r: r.doc_id):
        ids = np.array([*json_file.encode(docs[r.doc_id], add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in results("op4_byte_bpe")[1]:
        ids = np.array(other.encode_ordinary(docs[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())


def test_shards_equal_a_sort(spark, results, duck):
    docs = {d: (t or "").encode() for d, t in duck.execute("select doc_id, text from documents").fetchall()}
    rows = results("op6_hilbert_shards")[1]
    assert all((r.size, r.text_crc32) == (len(docs[r.doc_id]) + 8, zlib.crc32(docs[r.doc_id])) and r.law == "rows" and r.grown_shard is None for r in rows)
    table = spark.read.parquet(str(DATA / "documents.parquet"))
    for law in ("rows", "bytes"):
        got = hilbert.hilbert_shards(table, ["source", "lang", "n_chars", "doc_id"], 24, law).collect()
        order = sorted(got, key=lambda r: (r.curve, r.doc_id, r.size, r.text_crc32))
        total, before, slots = sum(r.size for r in order), 0, defaultdict(int)
        for i, r in enumerate(order):
            shard = ((i + 1) * 24 - 1) // len(order) if law == "rows" else min(23, (2 * before + r.size) * 24 // (2 * total))
            assert (r.shard, r.slot) == (shard, slots[shard])
            slots[shard] += 1
            before += r.size


def plain_kernel(a, b):
    """The subsequence kernel by enumeration."""
    def occurrences(word):
        codes = [1, *(int(string_kernel.alphabet()[ord(c)]) for c in word), 1]
        out = defaultdict(float)
        squares = 0.0
        for at in combinations(range(len(codes)), string_kernel.ORDER):
            gaps = at[-1] - at[0] - string_kernel.ORDER + 1
            if gaps <= string_kernel.GAPS:
                out[tuple(codes[i] for i in at)] += string_kernel.DECAY**gaps
                squares += string_kernel.DECAY ** (2 * gaps)
        return out, max(squares, 1e-12) ** 0.5

    (x, n), (y, m) = occurrences(a), occurrences(b)
    return sum(w * y[k] for k, w in x.items() if k in y) / n / m


def test_kernel_equals_enumeration():
    words, marks = ["blockhead", "blokhead", "b1ockhaed", "été", "aaaa", "ab", "blockheadedness"], ["blockhead", "aaaaa", "étés"]
    got = string_kernel._kernel(words, marks)
    assert np.allclose(got, [[plain_kernel(a, b) for b in marks] for a in words], atol=1e-3)
    table = np.zeros(1 << string_kernel.TABLE_BITS)
    entries, values = string_kernel.features("blockhead")
    np.add.at(table, entries, values)
    assert np.allclose(string_kernel.against(words, table), got[:, 0], atol=1e-3)


def test_risk_is_minimised():
    """The fitted model has a lower non-negative risk than models around it."""
    rng = np.random.default_rng(3)
    good, bad = rng.normal(1, 1, (300, 4)), rng.normal(-1, 1, (200, 4))
    positive, unlabelled, prior = good[:150], np.concatenate((good[150:], bad)), 150 / 350
    model = positive_unlabelled.train(positive, unlabelled, prior, steps=1500, strength=1e-6)

    def risk(w):
        m = positive_unlabelled.Model(model.mean, model.scale, w)
        p, u = m.margin(positive), m.margin(unlabelled)
        return prior * np.logaddexp(0, -p).mean() + max(0, np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean())

    least = risk(model.weights)
    assert all(risk(model.weights + d) >= least - 0.02 for d in rng.normal(0, 0.5, (200, 5)))
    assert (model.probability(good) > 0.5).mean() > 0.85 and (model.probability(bad) < 0.5).mean() > 0.85


def test_stages_on_odd_rows(spark, tmp_path):
    """Null texts and ids, repeated rows, columns with the stages' own names, and empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __score double, __contaminated boolean, __key string, y int, rep long"
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(i, text + f" v{(i or 5) % 7}", None, "s", None, 0.5, True, "k", i, 9) for i in (1, 1, 2, None)] + [(3, None, None, None, None, None, None, None, None, None), (4, "", "en", "s", 0, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    for name, of in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], of).write.parquet(f"file://{tmp_path}/{name}.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, f"file://{tmp_path}")
            kept = out.collect()
            assert name == "encoding" or out.columns == docs.columns
            assert len(kept) == table.count() or name == "near_copies" and len(kept) < table.count()
