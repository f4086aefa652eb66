"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Boundaries.  Every code point gets a symbol: letter, number, other, an apostrophe that begins a contraction of two or
three characters, a space that belongs to what follows, a lone white space before something else, or other white space.  A
finite automaton reads the symbols; each symbol is a transition function over its states, functions compose
associatively, and the closure of these functions is a small table.  A two-level scan composes them over a whole batch
of texts at once (per block, over the blocks, then inside the blocks); a boundary is a function of the state
before a character and its symbol.  No regular expression is used.

Merging.  The slices between boundaries are looked up in a cache; a new one is merged by ranks, lowest first and leftmost
on ties (by a heap where it is long).  Each id's number of bytes is kept with it from the merge on; their sums are the offsets of ids in the text, so any run of ids can be decoded alone and put in its place.

Defined cases: a null text is an empty text: no ids, both digests those of no bytes; repeated rows give repeated results;
an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm.common import batch_of, read_table, small_batches

#: symbols
LETTER, NUMBER, OTHER, SHORT, LONG, PREFIX, LONE, WHITE, RESET = range(9)
#: states: what the character before belongs to
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_PREFIX, IN_WHITE, NEED_ONE, NEED_TWO = range(8)
STATES = 8
#: White_Space of Unicode (fixed values)
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice begins at this character."""
    if symbol == RESET:
        return START, False
    if symbol == LETTER:
        if state == NEED_TWO:
            return NEED_ONE, False
        if state == NEED_ONE:
            return START, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_PREFIX)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_PREFIX)
    if symbol in (OTHER, SHORT, LONG):
        if state in (IN_OTHER, AFTER_PREFIX):
            return IN_OTHER, False
        return {OTHER: IN_OTHER, SHORT: NEED_ONE, LONG: NEED_TWO}[symbol], True
    if symbol == PREFIX:
        return AFTER_PREFIX, True
    if symbol == LONE:
        return START, True
    return IN_WHITE, state != IN_WHITE


def _closure() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the symbols' functions, the composition table, each function's image of START, and boundaries by (state, symbol)."""
    functions = [tuple(range(STATES))]
    ids = {functions[0]: 0}
    symbols = []
    for symbol in range(RESET + 1):
        f = tuple(_step(s, symbol)[0] for s in range(STATES))
        if f not in ids:
            ids[f] = len(functions)
            functions.append(f)
        symbols.append(ids[f])
    table: dict[tuple[int, int], int] = {}
    done = 0
    while done < len(functions):
        for i in range(len(functions)):
            for a, b in ((i, done), (done, i)):
                f = tuple(functions[b][functions[a][s]] for s in range(STATES))
                if f not in ids:
                    ids[f] = len(functions)
                    functions.append(f)
                table[a, b] = ids[f]
        done += 1
    n = len(functions)
    compose = np.zeros((n, n), np.uint16)
    for (a, b), c in table.items():
        compose[a, b] = c
    begins = np.array([[_step(s, x)[1] for x in range(RESET + 1)] for s in range(STATES)])
    return np.array(symbols, np.uint16), compose, np.array([f[START] for f in functions], np.uint8), begins


@lru_cache(None)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _closure()


@lru_cache(None)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE for each code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    first = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], np.uint8)
    out[first == ord("L")] = LETTER
    out[first == ord("N")] = NUMBER
    out[SPACES] = WHITE
    return out


def symbols_of(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``resets`` marks separators between texts."""
    kind = code_point_classes()[points]
    kind[resets] = RESET
    n = len(points)
    after = np.full(n, RESET, np.uint8)
    after[:-1] = kind[1:]
    white = kind == WHITE
    visible = white & (after != WHITE) & (after != RESET)
    kind = kind.copy()
    kind[visible] = LONE
    kind[visible & (points == 32)] = PREFIX
    quotes = np.flatnonzero((points == 39) & (after == LETTER))
    if len(quotes):
        one = points[quotes + 1]
        kind[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        inside = quotes + 2 < n
        two = points[np.minimum(quotes + 2, n - 1)]
        for a, b in ("re", "ve", "ll"):
            kind[quotes[inside & (one == ord(a)) & (two == ord(b))]] = LONG
    return kind


def states_before(symbols: np.ndarray, block: int = 256) -> np.ndarray:
    """The automaton's state before each symbol, by a two-level scan of transition functions."""
    ids, compose, start, _ = automaton()
    n = len(symbols)
    rows = -(-n // block)
    f = np.zeros((block, rows), np.uint16)  # the identity pads the end
    padded = np.zeros(rows * block, np.uint16)
    padded[:n] = ids[symbols]
    f[:] = padded.reshape(rows, block).T
    for i in range(1, block):  # inclusive scan of every block, all blocks at once
        f[i] = compose[f[i - 1], f[i]]
    carry = np.zeros(rows, np.uint16)
    total = 0
    for r in range(1, rows):  # scan of the blocks' totals
        total = int(compose[total, f[-1, r - 1]])
        carry[r] = total
    before = np.empty((rows, block), np.uint16)
    before[:, 0] = carry
    before[:, 1:] = compose[carry[None, :], f[:-1]].T
    return start[before.reshape(-1)[:n]]


def boundaries(texts: list[str]) -> tuple[str, np.ndarray]:
    """The texts joined by separators, and where slices begin in that; separators are slices too (a begin at each, and after)."""
    joined = "\0".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts])
    resets = (np.cumsum(lengths[:-1] + 1) - 1).astype(np.int64)
    if not len(points):
        return joined, np.zeros(0, np.int64)
    symbols = symbols_of(points, resets)
    begins = automaton()[3][states_before(symbols), symbols]
    begins[resets] = True
    begins[0] = True
    return joined, np.flatnonzero(begins)


def split_texts(texts: list[str]) -> list[list[str]]:
    """The slices of each text."""
    joined, begins = boundaries(texts)
    ends = np.append(begins[1:], len(joined)).tolist()
    begins = begins.tolist()
    pieces = [joined[a:b] for a, b in zip(begins, ends)]
    out, at = [], 0
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    marks = np.searchsorted(begins, starts[1:] - 1) if begins else np.zeros(len(texts), np.int64)
    for mark in marks.tolist():
        out.append(pieces[at:mark])
        at = mark + 1  # the separator
    return out


class Merges(dict):
    """slice -> ids as little-endian unsigned 32-bit integers, and the bytes that each stands for as 16-bit ones; new slices are merged and kept; of a full cache those stay that are met again, as one half takes over from the other."""

    def __init__(self, ranks: dict[bytes, int], most: int = 200_000):
        super().__init__()
        self.ranks, self.half = ranks, most // 2
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def __missing__(self, piece: str) -> tuple[bytes, bytes]:
        out = self.older.pop(piece, None)
        if out is None:
            parts = self.merge(piece.encode())
            out = struct.pack(f"<{len(parts)}I", *[self.ranks[p] for p in parts]), struct.pack(f"<{len(parts)}H", *map(len, parts))
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = out
        return out

    def merge(self, piece: bytes) -> list[bytes]:
        """The parts of a slice that ids stand for."""
        ranks = self.ranks
        if piece in ranks:
            return [piece]
        if len(piece) > 100:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = ranks.get
        pairs = [get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
        while pairs:
            least = min(pairs)
            if least == 1 << 30:
                break
            i = pairs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], 1 << 30)
        return parts

    def _merge_long(self, piece: bytes) -> list[bytes]:
        """The same by a heap of pairs over a linked list."""
        n, get = len(piece), self.ranks.get
        part = [piece[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if part[i] is not None else n
            if j >= n or part[i] != a or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := get(part[x] + part[y])) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return [p for p in part if p is not None]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.merges = Merges(self.ranks)
        n = max(self.ranks.values()) + 1
        self.bytes = [b""] * n
        for b, i in self.ranks.items():
            self.bytes[i] = b

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of each text as little-endian unsigned 32-bit integers, and their numbers of bytes as 16-bit ones."""
        get, out = self.merges.__getitem__, []
        for pieces in split_texts(texts):
            ids, widths = zip(*map(get, pieces)) if pieces else ((), ())
            out.append((b"".join(ids), b"".join(widths)))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_run(self, ids: bytes, widths: bytes, first: int, last: int) -> tuple[int, bytes]:
        """Where the text of the ids from ``first`` up to ``last`` begins, and its bytes."""
        return int(offsets(widths[: 2 * first])[-1]), self.decode(ids[4 * first : 4 * last])

    def digest(self, ids: bytes, widths: bytes, run: int = 4096) -> str:
        """SHA-256 of the decoded text, in runs of ids; an error unless each has its place by the widths."""
        out, at, begins = hashlib.sha256(), 0, offsets(widths)
        for i in range(0, len(ids) // 4, run):
            text = self.decode(ids[4 * i : 4 * (i + run)])
            if begins[i] != at:
                raise ValueError(f"id {i} begins at byte {begins[i]}, not {at}")
            out.update(text)
            at += len(text)
        if begins[-1] != at:
            raise ValueError(f"the text ends at byte {begins[-1]}, not {at}")
        return out.hexdigest()


def offsets(widths: bytes) -> np.ndarray:
    """Where the bytes of each id begin in the text, and the text's length."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(widths, "<u2"), dtype=np.int64)))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def text_groups(texts: list[str], most: int = 500_000) -> Iterator[list[str]]:
    """Consecutive texts of about ``most`` characters together."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), widths (each id's number of bytes, 16-bit; ``offsets`` sums them) and decoded_sha256 for each row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for group in text_groups([t or "" for t in batch.column(1).to_pylist()]):
                found += own.encode_batch(group)
            n, shas = [len(ids) // 4 for ids, _ in found], [own.digest(*x) for x in found]
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary()), pa.array(shas, pa.string())]
            yield batch_of(["doc_id", "n_tokens", "ids", "widths", "decoded_sha256"], columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, widths binary, decoded_sha256 string")


def digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as ``encode``, hashed where the ids are made."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path)
        for batch in batches:
            n, a, b = [], [], []
            for group in text_groups([t or "" for t in batch.column(1).to_pylist()]):
                for ids, widths in own.encode_batch(group):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(own.digest(ids, widths))
            yield batch_of(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def ranks_file() -> str:
    """Default of the ``ranks_path`` parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded again."""
    return digests(read_table(spark, sf_dir, "documents"), ranks_file())
