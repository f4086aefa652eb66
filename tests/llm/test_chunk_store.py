"""The store against the library alone, and its own round trip."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparkloom.llm import chunk_store as store
from sparkloom.llm import slices
from sparkloom.llm.common import text_buffers
from tests.llm.test_bpe import HAND


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(store.tokenizer_file())


def encoded(own, texts):
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    counts, ids = own.encode(data, offsets)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.mark.parametrize("most", [1, 1_000_000])  # at most one block of slices kept, or all
def test_ids_equal_the_library(library, most, monkeypatch):
    monkeypatch.setattr(slices, "BLOCK", 50 if most == 1 else slices.BLOCK)
    rng = np.random.default_rng(5)
    alphabet = [*"abcdeorthenst'’ \n\n1é,.;!?) \t\r\u00a0\u2003\u3000\u0085ß×÷Ω中\0\x1c", "'s", "'ll", " a", "  ", "\n\n", "<|endoftext|>", " the", "x" * 40]
    texts = HAND + ["", "<|endoftext|> a <|endoftext|>", "a<|endoftext|>", "plain"] + ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 60, 3000)]
    own = slices.SliceEncoder(store.tokenizer_file(), most)
    for _ in range(2):
        for text, ids in zip(texts, encoded(own, texts)):
            assert ids == library.encode(text, add_special_tokens=False).ids, text
    assert encoded(own, ["<|endoftext|> a"]) == [[50256, 257]]
    plain = slices.SliceEncoder(store.tokenizer_file(), most, special_as_text=True)
    assert 50256 not in encoded(plain, ["<|endoftext|> a"])[0]


def parts(*streams):
    ids = np.concatenate(streams)
    marks, out, start, at = store.marks_of(ids).tolist(), [], 0, 0
    for x in streams:
        end = start + len(x)
        stops, at = store.cuts(marks, start, end, at)
        out.append([ids[i:j].tobytes() for i, j in zip([start, *stops[:-1]], stops)])
        start = end
    return out


def test_chunks_follow_content_and_crcs_combine():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 50000, 20_000).astype("<u4"), rng.integers(0, 50000, 333).astype("<u4")
    assert b"".join(parts(a)[0]) == a.tobytes()
    sizes = [len(p) // 4 for p in parts(a)[0]]
    assert max(sizes) <= store.MOST and min(sizes[:-1]) >= store.LEAST
    shared = set(parts(a)[0]) & set(parts(np.concatenate((b, a)))[0])
    assert len(shared) > 0.9 * len(sizes)
    assert parts(b, a, b[:5], a[:70]) == [*parts(b), *parts(a), *parts(b[:5]), *parts(a[:70])]  # what stands before has no influence
    pieces = [[rng.bytes(n) for n in sizes] for sizes in ([5], [1, 70000], [3, 2, 1, 9], [4])]
    flat = [x for run in pieces for x in run]
    edges = np.cumsum([0] + [len(x) for x in pieces])
    got = store.crcs_of_runs(np.array([zlib.crc32(x) for x in flat]), np.array([len(x) for x in flat]), edges)
    assert got.tolist() == [zlib.crc32(b"".join(x)) for x in pieces]
    for v in (a, b, np.array([1 << 20], "<u4")):
        small = int(v.max()) < 1 << 16
        assert (store.unpack(store.pack(v.astype("<u2" if small else "<u4").tobytes(), small)) == v).all()


def test_round_trip(spark, tmp_path, library):
    long = "Passages that repeat are stored once. " * 300
    rows = [(5, long, 1), (2, long + "end", 2), (9, None, 3), (9, None, 4), (None, "x", 5), (7, "", 6), (1, "<|endoftext|>", 7), (5, long, 8)]
    path = f"file://{tmp_path}/store"
    store.write_store(spark.createDataFrame(rows, "doc_id long, text string, start int"), store.tokenizer_file(), path)
    want = {d: [*library.encode(t or "", add_special_tokens=False).ids, store.END] for d, t, _ in rows}
    got = sorted(store.verify(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 5, 5, 7, 9, 9]
    at = 0
    for r in got:
        raw = np.array(want[r.doc_id], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want[r.doc_id]), zlib.crc32(raw))
        at += r.n_tokens
    assert {(r.doc_id, bytes(r.ids)) for r in store.restore(spark, path).collect()} == {(d, np.array(x, "<u4").tobytes()) for d, x in want.items()}
    assert store.check_manifest(spark, path)
    n = store.read_chunks(spark, path).count()
    assert n == store.read_chunks(spark, path).select("address").distinct().count()


def damaged(spark, path, chunks):
    spark.createDataFrame(chunks, "address binary, n long, body binary, kind int").write.mode("overwrite").partitionBy("kind").parquet(f"{path}/objects")


def test_damage_is_noticed(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store.write_store(spark.createDataFrame([(1, "some text"), (2, "other text")], "doc_id long, text string"), store.tokenizer_file(), path)
    a, b = store.read_chunks(spark, path).collect()
    damaged(spark, path, [(a.address, a.n, bytearray(store.pack(np.arange(a.n, dtype="<u2").tobytes(), True)), 0), (b.address, b.n, b.body, 0)])
    with pytest.raises(Exception, match="damaged"):
        store.verify(spark, path).collect()
    damaged(spark, path, [(b.address, b.n, b.body, 0)])
    with pytest.raises(Exception, match="missing"):
        store.verify(spark, path).collect()
    store.read_recipes(spark, path).limit(1).write.mode("overwrite").partitionBy("part").parquet(f"{path}/other")
    spark.read.schema("doc_id long, start long, n_tokens long, chunks binary, root binary, part int").parquet(f"{path}/other").write.mode("overwrite").partitionBy("part").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        store.verify(spark, path)


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store.write_store(spark.createDataFrame([], "doc_id long, text string"), store.tokenizer_file(), path)
    assert store.verify(spark, path).count() == 0
