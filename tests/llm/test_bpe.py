"""Slices and ids against the public library, on random and hand-made texts."""

import hashlib

import numpy as np
import pytest
import public_tokenizers
import regex
import tiktoken

from sparkloom.llm import bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
HAND = [
    "", " ", "  ", "\n", " \n ", "a", "it's", "it 's", "I'll'll", "''s", "'s's't", "'sfoo", "\n're", "don't  stop\t\tnow ", "x'  'm", "x y", "　'd",
    "a" * 5000, "=" * 3000, " " * 400 + "z", "été 12٣ ²x", "日本語 テキスト", "😀😀 'll", "​z", "a\0b", "\0", "'", "'l", "'r e", "́a", "\x1c\x1d a", "'S'T", "x 'ſ",
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_slices_equal_the_pattern():
    rng = np.random.default_rng(3)
    alphabet = list("ab'strevlmd'  \n\t1²é,! 日😀́")
    texts = HAND + ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 700, 400)]
    want = [regex.findall(public_tokenizers.PATTERN, t) for t in texts]
    assert bpe.split_texts(texts) == want
    assert [bpe.split_texts([t])[0] for t in texts[:60]] == want[:60]


def test_ids_equal_the_library(library):
    rng = np.random.default_rng(4)
    alphabet = list("abcdeorthen'  \n1é,")
    texts = HAND + ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 900, 100)]
    own = bpe.Codec(RANKS)
    for text, (ids, widths) in zip(texts, own.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()
        assert bpe.offsets(widths)[-1] == len(text.encode()) and own.digest(ids, widths, 7) == hashlib.sha256(text.encode()).hexdigest()


def test_any_run_decodes_alone():
    rng = np.random.default_rng(5)
    own = bpe.Codec(RANKS)
    texts = [t for t in HAND if t] + ["".join(rng.choice(list("abcdeorthen'  \n1é,日😀"), n)) for n in rng.integers(1, 400, 60)]
    for text, (ids, widths) in zip(texts, own.encode_batch(texts)):
        n, whole = len(ids) // 4, text.encode()
        for first, last in [(0, n), (n, n), *(sorted(rng.integers(0, n + 1, 2)) for _ in range(20))]:
            at, part = own.decode_run(ids, widths, int(first), int(last))
            assert whole[at : at + len(part)] == part and len(part) == bpe.offsets(widths)[last] - at
    ids, widths = own.encode_batch(["hello world, hello"])[0]
    with pytest.raises(ValueError, match="byte"):
        own.digest(ids, widths[2:] + widths[:2], 1)


def test_very_long_texts(spark):
    """One word of a million letters, a million words, and a million spaces."""
    texts = ["ab" * 500_000, "word " * 1_000_000, " " * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.encode(df, RANKS).collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and bpe.offsets(got[i].widths)[-1] == len(t) and len(got[i].ids) == 4 * got[i].n_tokens


def test_digests_of_odd_tables(spark):
    rows = [(1, "it's", 5), (1, "it's", 6), (None, "x", 7), (2, None, None), (3, "", 8)]
    out = bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), RANKS).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out) == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0)]
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string"), RANKS).count() == 0
