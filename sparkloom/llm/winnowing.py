"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and cut into words.  Each text keeps the minimum hash (the rightmost one on
ties) of every ``w`` consecutive ``k``-grams, where w + k - 1 = window, so that any shared span of
``window`` words leaves at least one common fingerprint at the same place in both texts.  Fingerprints
of documents are joined with those of the benchmark and hits extended to whole windows, which are compared
word by word.  Items of fewer words than a window are one window of their own length, fingerprinted with the
same rule for that length.

The benchmark's fingerprints and windows go to all executors, as flat arrays of about five times its texts, while these texts are within ``broadcast_bytes``
(checked by a sum).  Beyond that ``contaminate`` joins fingerprints by a shuffle, then the windows around the hits: only windows are compared, never texts with items,
and each distinct text is judged once.  Both forms give the same rows.

Defined cases: a null or word-less document has no words and no hits; null or word-less items never occur; items with
a null id never occur; each document row is judged by its own text, whatever other rows have its doc_id, and repeated rows give repeated result rows; repeated item rows count once by id;
an empty benchmark gives no hits; other columns are never read, but pass through ``without_contaminated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.llm.common import append, batch_of, free_name, read_table, slices_by_bytes, small_batches, text_buffers
from sparkloom.llm.words import ALNUM, Words, grams

WINDOW = 13
#: bytes of benchmark texts up to which their index goes to all executors: it is about five times as large, and 45 times as large while it is made
BROADCAST = 8 << 20
NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def shape(window: int) -> tuple[int, int]:
    """k and w for a guaranteed span of ``window`` words."""
    k = (window + 1) // 2
    return k, window - k + 1


def winnow(words: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints; ``rows`` tells which text each word is of."""
    k, w = shape(window)
    h = grams(words, k)
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least, at = h[:n].copy(), np.arange(n)
    for i in range(1, w):
        new = h[i : i + n]
        take = new <= least  # the rightmost minimum
        least[take] = new[take]
        at[take] = (np.arange(n) + i)[take]
    whole = rows[:n] == rows[window - 1 : window - 1 + n]
    at = np.unique(at[whole])
    return at, h[at]


def canonical(words: Words) -> tuple[bytes, np.ndarray]:
    """The words of all rows, each followed by one blank, and where they begin."""
    sizes = words.ends - words.starts
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    total = np.arange(int(sizes.sum()))
    shift = np.cumsum(sizes) - sizes
    out[np.repeat(begins - shift, sizes) + total] = words.low[np.repeat(words.starts - shift, sizes) + total]
    return out.tobytes(), np.append(begins, ends[-1] if len(ends) else 0)


def window_places(words: Words, length: int, rows: np.ndarray) -> np.ndarray:
    """Words at which a window of ``length`` words of one of ``rows`` (a mask) begins."""
    own = rows & (words.counts >= length)
    n = np.where(own, words.counts - length + 1, 0)
    shift = np.cumsum(n) - n
    return np.repeat(words.first[:-1] - shift, n) + np.arange(int(n.sum()))


class Index:
    """Fingerprints and windows of the benchmark in flat arrays; ``names`` are the items' ids as strings, in order."""

    def __init__(self, ids: list[str], data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
        self.window = window
        words = Words(data, offsets, ALNUM)
        h, rows = words.hashes(), words.row_of_word()
        names, item = np.unique(np.array(ids, dtype=object).astype(str) if len(ids) else np.zeros(0, str), return_inverse=True)
        self.names = names.tolist()
        self.text, at = canonical(words)
        self.by_length: dict[int, dict[str, np.ndarray]] = {}
        lengths = np.minimum(words.counts, window)
        for length in np.unique(lengths[lengths > 0]).tolist():
            own = lengths == length
            starts = window_places(words, length, own)
            hashes = grams(h, length, starts)
            order = np.argsort(hashes, kind="stable")
            starts, hashes = starts[order], hashes[order]
            begins, ends = at[starts], at[starts + length] - 1
            new = np.ones(len(starts), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            group = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            others: dict[bytes, int] = {}  # windows that share a hash with another one
            for i in np.flatnonzero(~new).tolist():
                j = heads[group[i]]
                if self.text[begins[i] : ends[i]] != self.text[begins[j] : ends[j]]:
                    group[i] = others.setdefault(self.text[begins[i] : ends[i]], len(heads) + len(others))
            size = len(heads) + len(others)
            first = np.full(size, len(starts))
            np.minimum.at(first, group, np.arange(len(starts)))
            pairs = np.unique(group.astype(np.int64) * len(self.names) + item[rows[starts]])
            place = np.argsort(hashes[first], kind="stable")
            self.by_length[length] = {
                "prints": np.unique(winnow(h[own[rows]], rows[own[rows]], length)[1]), "hashes": hashes[first][place], "group": place.astype(np.int32),
                "begins": begins[first].astype(np.uint32), "ends": ends[first].astype(np.uint32),
                "heads": np.searchsorted(pairs, np.arange(size + 1) * len(self.names)).astype(np.uint32), "items": (pairs % max(len(self.names), 1)).astype(np.int32),
            }

    def hits(self, words: Words, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Which words are hit, and the numbers of the items found in each row."""
        delta = np.zeros(len(h) + 1, np.int64)
        groups: dict[int, dict[int, set[int]]] = {}
        low = None
        for length, own in self.by_length.items():
            starts = near(own["prints"], h, rows, length)
            if not len(starts):
                continue
            hashes = grams(h, length, starts)
            first = np.searchsorted(own["hashes"], hashes, side="left")
            last = np.searchsorted(own["hashes"], hashes, side="right")
            low = words.low.tobytes() if low is None else low
            for i, a, b in zip(*(x[first < last].tolist() for x in (starts, first, last))):
                text = b" ".join(low[x:y] for x, y in zip(words.starts[i : i + length].tolist(), words.ends[i : i + length].tolist()))
                for j in own["group"][a:b].tolist():
                    if self.text[own["begins"][j] : own["ends"][j]] == text:
                        delta[i] += 1
                        delta[i + length] -= 1
                        groups.setdefault(int(rows[i]), {}).setdefault(length, set()).add(j)
        items = {}
        for row, found in groups.items():
            lists = [own["items"][own["heads"][j] : own["heads"][j + 1]] for length, js in found.items() for own in (self.by_length[length],) for j in js]
            items[row] = np.unique(np.concatenate(lists))
        return np.cumsum(delta[:-1]) > 0, items


def near(prints: np.ndarray, h: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """Starts of all windows that hold a k-gram whose fingerprint is among ``prints``."""
    at, own = winnow(h, rows, length)
    if not len(at) or not len(prints):
        return np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(prints, own), len(prints) - 1)
    return around(at[prints[place] == own], rows, length)


def around(at: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of one text that hold the k-gram at one of the places."""
    _, w = shape(length)
    starts = np.unique((at[:, None] - np.arange(w)[None, :]).ravel())
    starts = starts[(starts >= 0) & (starts + length <= len(rows))]
    return starts[rows[starts] == rows[starts + length - 1]]


def digest(items: list[str]) -> str:
    """Of ids in order."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _measure(index: Index, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Words, hit words, items and the items' digest of each text."""
    none = digest([])
    data, offsets = text_buffers(column)
    n = len(column)
    n_words, n_hit, n_items, sha = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [none] * n
    for a, b in slices_by_bytes(offsets):
        words = Words(data, offsets[a : b + 1], ALNUM)
        n_words[a:b] = words.counts
        rows = words.row_of_word()
        hit, items = index.hits(words, words.hashes(), rows)
        n_hit[a:b] = np.bincount(rows[hit], minlength=b - a)
        for row, found in items.items():
            n_items[a + row], sha[a + row] = len(found), digest([index.names[i] for i in found.tolist()])
    return n_words, n_hit, n_items, sha


def bad(n_words, n_hit):
    """The rule of contamination."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _scan(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_hit, n_items, sha = _measure(index, batch.column(1))
        yield batch_of(NAMES, [batch.column(0), n_words, n_hit, n_items, sha, bad(n_words, n_hit)])


def index_of(items: pa.Table, window: int = WINDOW) -> Index:
    """Of a table of ids (strings) and texts."""
    return Index(items.column(0).to_pylist(), *text_buffers(items.column(1)), window)


def _index(benchmark: DataFrame, window: int, broadcast_bytes: int) -> Index | None:
    """The benchmark's index, if its texts are within the bound."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return index_of(benchmark.select(F.col("item_id").cast("string"), "text").toArrow(), window) if size <= broadcast_bytes else None


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    small_batches(docs.sparkSession)
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    index = _index(items, window, broadcast_bytes)
    if index is None:
        key = free_name(docs, "__key")
        keyed = docs.withColumn(key, _key())
        own = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(key).alias("__key"))
        gone = _contaminate_shuffled(own, items, window).where("contaminated").select(F.col("__key").alias(key)).distinct()
        return keyed.join(gone, key, "left_anti").drop(key)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    name = free_name(docs, "__contaminated")
    flagged = append(docs, "text", lambda column: bad(*_measure(shared.value, column)[:2]), name, "boolean")
    return flagged.where(~F.col(name)).drop(name)


def contaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): words, hit words, items, contaminated or not."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    benchmark = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    index = _index(benchmark, window, broadcast_bytes)
    if index is None:
        return _contaminate_shuffled(docs.withColumn("__key", _key()), benchmark, window).drop("__key")
    shared = spark.sparkContext.broadcast(index)
    return docs.mapInArrow(lambda batches: _scan(shared.value, batches), SCHEMA)


def _prints(window: int, lengths: list[int] | None):
    """Fingerprints (length, print, at) of texts, for some lengths or (None) for each text only that of its own windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices_by_bytes(offsets):
                words = Words(data, offsets[a : b + 1], ALNUM)
                h, rows = words.hashes(), words.row_of_word()
                for length in lengths or range(1, window + 1):
                    keep = np.ones(len(h), bool) if lengths else (np.minimum(words.counts, window) == length)[rows]
                    at, prints = winnow(h[keep], rows[keep], length)
                    if len(at):
                        at = np.flatnonzero(keep)[at]
                        ids = batch.column(0).take(pa.array(rows[at] + a))
                        yield batch_of(["id", "length", "print", "at"], [ids, np.full(len(at), length, np.int32), prints.view(np.int64), at - words.first[rows[at]]])

    return run


def _windows_of_items(window: int):
    """Windows (length, text) of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices_by_bytes(offsets):
                words = Words(data, offsets[a : b + 1], ALNUM)
                rows, lengths = words.row_of_word(), np.minimum(words.counts, window)
                for length in np.unique(lengths[lengths > 0]).tolist():
                    starts = window_places(words, length, lengths == length)
                    yield _window_batch(batch.column(0), words, rows, starts, length, a)

    return run


def _window_batch(ids: pa.Array, words: Words, rows: np.ndarray, starts: np.ndarray, length: int, base: int) -> pa.RecordBatch:
    text, at = canonical(words)
    begins, ends = at[starts].tolist(), (at[starts + length] - 1).tolist()
    own = pa.array([text[x:y] for x, y in zip(begins, ends)], pa.binary())
    return batch_of(["id", "length", "window", "at"], [ids.take(pa.array(rows[starts] + base)), np.full(len(starts), length, np.int32), own, starts - words.first[rows[starts]]])


def _windows_at_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around the fingerprints of each text that the benchmark has too: a row per text, with lists of lengths and places."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        lengths, places = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        for i in range(batch.num_rows):
            words = Words(data, offsets[i : i + 2], ALNUM)
            rows = words.row_of_word()
            of, at = np.array(lengths[i]), np.array(places[i])
            for length in np.unique(of).tolist():
                starts = around(at[of == length], rows, length)
                if len(starts):
                    yield _window_batch(batch.column(0), words, rows, starts, length, i)


def _key() -> Column:
    """Equal texts have one key, whatever their doc_id."""
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def _contaminate_shuffled(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """The same result by shuffles: fingerprints are joined, then the windows around those in common.

    ``docs``: doc_id, text, __key; the result has __key besides.  Texts are judged once each, by key.
    """
    prints, windows = "id string, length int, print long, at long", "id string, length int, window binary, at long"
    texts = docs.select("__key", "text").where("text is not null").dropDuplicates(["__key"])
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    item_prints = items.mapInArrow(_prints(window, None), prints).select("length", "print").distinct()
    lengths = sorted(r[0] for r in item_prints.select("length").distinct().collect())  # at most ``window`` values
    # a row per fingerprint of a document: a common one is split by the join (left semi), not gathered
    common = texts.mapInArrow(_prints(window, lengths or [window]), prints).join(item_prints, ["length", "print"], "left_semi")
    places = common.groupBy(F.col("id").alias("__key")).agg(F.collect_list("length").alias("lengths"), F.collect_list("at").alias("places"))  # at most the text's own
    at_hits = texts.join(places, "__key").select("__key", "text", "lengths", "places").mapInArrow(_windows_at_hits, windows)
    in_items = items.mapInArrow(_windows_of_items(window), windows).groupBy("length", "window").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    found = at_hits.join(in_items, ["length", "window"]).groupBy(F.col("id").alias("__key")).agg(
        F.array_sort(F.collect_set(F.struct(F.col("at").alias("a"), (F.col("at") + F.col("length")).alias("b")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("ids")
    )
    # words hit: the length of the union of spans, by a running maximum of their ends
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n")),
        lambda acc: acc["n"],
    )
    words = docs.select("doc_id", "text", "__key").mapInArrow(_count, "doc_id long, n_words long, __key string")
    out = words.join(found.select("__key", union.alias("n_hit"), "ids"), "__key", "left")
    n_hit, ids = F.coalesce("n_hit", F.lit(0)), F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        "__key", "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        counts = [Words(data, offsets[a : b + 1], ALNUM).counts for a, b in slices_by_bytes(offsets)]
        yield batch_of(["doc_id", "n_words", "__key"], [batch.column(0).cast(pa.int64()), np.concatenate(counts) if counts else np.zeros(0, np.int64), batch.column(2)])


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    return contaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
passages AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, w[i : i + least(13, len(w)) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM passages WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT doc_id, m, i, w[i : i + m - 1] AS win
  FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM lowered, lengths WHERE len(w) >= m)),
found AS (SELECT p.doc_id, p.m, p.i, v.item_id FROM places p JOIN windows v ON p.m = v.m AND p.win = v.win),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lowered LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
