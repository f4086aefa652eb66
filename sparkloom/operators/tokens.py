"""Tokenizer backends: bytes as native expressions, or a tokenizer file by the tokenizers library.

A backend adds a struct (ids, offsets) for a text column; offsets count characters.  Null texts have no tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkloom.functions.text import FIRST_ID, byte_ids
from sparkloom.operators.storage import small_batches

# Names of the special tokens, in the order of their ids.
SPECIAL = ["<pad>", "<mask>", "<cls>", "<sep>", "<unk>"] + [f"<reserved_{i}>" for i in range(5, 16)]
TOKENS = "struct<ids:array<int>,offsets:array<struct<start:int,end:int>>>"


def byte_offsets(text: Column) -> Column:
    """(start, end) character offsets of each byte token: those of its character."""
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.array_repeat(F.struct(i.alias("start"), (i + 1).alias("end")), F.octet_length(c)))
    plain = F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda i: F.struct(i.alias("start"), (i + 1).alias("end")))
    return F.when((F.length(text) > 0) & (F.octet_length(text) == F.length(text)), plain).otherwise(F.flatten(chars))


class Bytes:
    """A token for each byte: its value above the special ids."""

    diagnostic = True
    vocab_size = random_vocab_size = FIRST_ID + 256
    sha256 = hashlib.sha256(b"byte-diagnostic").hexdigest()

    def tokens(self, df: DataFrame, texts: dict[str, Column]) -> DataFrame:
        """``df`` with a column of tokens for each text."""
        return df.withColumns({n: F.struct(byte_ids(c).alias("ids"), byte_offsets(c).alias("offsets")) for n, c in texts.items()})


class Library:
    """A tokenizer file.  Its special tokens must have the given ids (``specials`` in order of ids; none for files of others)."""

    diagnostic = False

    def __init__(self, path: str, specials: list[str] | None = None):
        from tokenizers import Tokenizer

        self.path = path
        own = Tokenizer.from_file(path)
        for i, token in enumerate(SPECIAL if specials is None else specials):
            if own.token_to_id(token) != i:
                raise ValueError(f"{path}: {token} must have id {i}")
        self.vocab_size = self.random_vocab_size = own.get_vocab_size()
        if os.path.exists(path + ".meta.json"):  # a padded vocabulary: only so many ids are words
            with open(path + ".meta.json", encoding="utf-8") as f:
                self.random_vocab_size = json.load(f).get("effective_vocab_size", self.vocab_size)
        with open(path, "rb") as f:
            self.sha256 = hashlib.sha256(f.read()).hexdigest()

    def tokens(self, df: DataFrame, texts: dict[str, Column]) -> DataFrame:
        """``df`` with a column of tokens for each text; the file must be at ``path`` on every executor."""
        path, names = self.path, list(texts)
        wide = df.withColumns({n: c.cast("string") for n, c in texts.items()})
        at = [wide.columns.index(n) for n in names]
        kind = T._parse_datatype_string(TOKENS)
        schema = T.StructType([T.StructField(f.name, kind) if f.name in names else f for f in wide.schema.fields])

        small_batches(df.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _tokenizer(path)
            for batch in batches:
                sizes = sum(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy().astype(np.int64) for i in at)
                for a, b in _ranges(sizes):
                    columns = [c.slice(a, b - a) for c in batch.columns]
                    for i in at:
                        columns[i] = _token_array(own.encode_batch([t or "" for t in columns[i].to_pylist()], add_special_tokens=False))
                    yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return wide.mapInArrow(run, schema)


#: bytes of text whose tokens are held at a time, but for one longer text
HELD = 500_000


def _ranges(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``HELD`` bytes together."""
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > HELD:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes):
        yield start, len(sizes)


def _token_array(found: list) -> pa.Array:
    """The library's encodings as structs of ids and offsets, without an object per token."""
    at = pa.array(np.concatenate(([0], np.cumsum([len(e) for e in found]))), pa.int32())
    n = at[-1].as_py()
    ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int32, n)
    ends = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int32, 2 * n).reshape(-1, 2)
    offsets = pa.StructArray.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["start", "end"])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(ids)), pa.ListArray.from_arrays(at, offsets)], names=["ids", "offsets"])


_loaded: dict = {}


def _tokenizer(path: str):
    """One tokenizer per worker process and file; a task keeps to its own core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _loaded:
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


#: fixed value: pieces in which a vocabulary is counted
PIECE = r"[A-Za-z_][A-Za-z_0-9]*|[0-9]+|[^\w\s]|\s+"


def training_texts(records: DataFrame) -> DataFrame:
    """Records that a vocabulary may be counted on; one of another partition than train is an error."""
    wrong = records.where(F.col("split").isNotNull() & (F.col("split") != "train")).select("id", "split").first() if "split" in records.columns else None
    if wrong:
        raise ValueError(f"record {wrong['id']} is of partition {wrong['split']}, a vocabulary may see train only")
    return records


def vocabulary(records: DataFrame, column: str = "code", pattern: str = PIECE, least: int = 2) -> DataFrame:
    """word, n of pieces that occur ``least`` times."""
    words = records.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def byte_pairs(words: DataFrame) -> DataFrame:
    """first, second, n of neighbouring bytes of counted words (word, n): the first counts of a merge table."""
    ids = words.select("n", byte_ids(F.col("word")).alias("ids"))
    pairs = ids.select("n", F.explode(F.zip_with(F.slice("ids", F.lit(1), F.greatest(F.size("ids") - 1, F.lit(0))), F.slice("ids", F.lit(2), F.greatest(F.size("ids") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("first"), b.alias("second")))).alias("p"))
    return pairs.groupBy("p.first", "p.second").agg(F.sum("n").alias("n"))
