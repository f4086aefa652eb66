"""Product codes of vectors: a codebook for each part position, found through a ball tree over its entries.

Components become integers floor(scale * x); vectors are cut into equal consecutive parts, and each part position has a codebook of integer entries, started from the vectors of the least keys and moved
in rounds: parts are assigned to their nearest entry (ties to the lower index), entries become the floors of their parts' means.

Search.  Entries are halved along their widest component until a leaf holds LEAF of them.  A query goes to the leaf whose balls are nearest, which gives a first bound; then every ball is visited whose
distance, less its radius, isn't above the bound.  Radii are rounded up and the tests leave a margin (SLACK) beyond the error of double precision, and equality visits, so no entry that is nearest or ties with it is missed; what
decides are squared distances in 64-bit integers (``integers`` refuses numbers for which these could overflow).

Scale.  A round reads the vectors once; a task adds up its own parts and returns a row for each entry and component at most.  Only codebooks (parts x entries x width numbers, whatever the table's
size) go to the driver and to tasks.  Codes are written once, narrow; the sums over labels are partial aggregates, broadcast when they are few and joined in salted shares otherwise.

Defined cases: vectors that are null or hold a null, NaN or infinite component are dropped; null labels are one label; null keys are last when codebooks start, equal keys are ordered by their vectors;
repeated rows count each; with fewer kept vectors than entries there are fewer entries; an empty table gives no rows; empty vectors have empty parts and error 0.  Kept vectors must agree in length, the
parts must divide it, and |scale * x| must be below 2**26: else an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.llm.common import batch_of, cut, read_table, small_batches

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF = 8
SLACK = 1e-9
LIMIT = 1 << 26
#: so many sums over labels are broadcast at most; beyond, rows and sums meet in so many shares
FEW, SHARES = 100_000, 16


@dataclass
class Ball:
    """Some entries of a codebook: all of them are within ``radius`` of ``center``."""

    entries: np.ndarray
    center: np.ndarray
    radius: float
    children: list[Ball] = field(default_factory=list)


def tree(book: np.ndarray, own: np.ndarray | None = None) -> Ball:
    own = np.arange(len(book)) if own is None else own
    points = book[own].astype(float)
    center = points.mean(0)
    radius = float(np.sqrt(((points - center) ** 2).sum(1)).max()) * (1 + SLACK) + SLACK
    ball = Ball(own, center, radius)
    spread = np.ptp(points, axis=0) if points.shape[1] else np.zeros(1)
    if len(own) > LEAF and spread.max() > 0:
        order = np.argsort(points[:, spread.argmax()], kind="stable")
        half = len(own) // 2
        ball.children = [tree(book, np.sort(own[order[:half]])), tree(book, np.sort(own[order[half:]]))]
    return ball


class Searcher:
    """Nearest entries of one codebook."""

    def __init__(self, book: np.ndarray):
        self.book, self.root, self.leaves = book, tree(book), []
        self._number(self.root)

    def _number(self, ball: Ball) -> None:
        if not ball.children:
            ball.leaf = len(self.leaves)
            self.leaves.append(ball)
        for child in ball.children:
            self._number(child)

    def _compare(self, parts: np.ndarray, rows: np.ndarray, ball: Ball, best: np.ndarray, index: np.ndarray) -> None:
        """Integer squared distances of some rows to a leaf's entries; entries ascend, so the first least one has the lowest index."""
        d = ((parts[rows, None, :] - self.book[ball.entries][None]) ** 2).sum(2)
        at = d.argmin(1)
        d, entry = d[np.arange(len(rows)), at], ball.entries[at]
        better = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], entry[better]

    def __call__(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """index and squared distance of each part's nearest entry, and how many entries were compared in all."""
        n, floats = len(parts), parts.astype(float)
        best, index, compared = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.book)), 0
        apart = lambda rows, ball: np.sqrt(((floats[rows] - ball.center) ** 2).sum(1))
        first = np.zeros(n, np.int64)
        stack = [(self.root, np.arange(n))]
        while stack:  # down to the leaf of the nearer balls
            ball, rows = stack.pop()
            if not len(rows):
                continue
            if not ball.children:
                first[rows] = ball.leaf
                self._compare(parts, rows, ball, best, index)
                compared += len(rows) * len(ball.entries)
                continue
            left, right = ball.children
            near = apart(rows, left) - left.radius <= apart(rows, right) - right.radius
            stack += [(left, rows[near]), (right, rows[~near])]
        stack = [(self.root, np.arange(n))]
        while stack:  # and to all balls that the bound can't rule out
            ball, rows = stack.pop()
            rows = rows[(apart(rows, ball) - ball.radius) * (1 - SLACK) - SLACK <= np.sqrt(best[rows].astype(float)) * (1 + SLACK)]
            if not len(rows):
                continue
            if ball.children:
                stack += [(child, rows) for child in ball.children]
            elif len(rows := rows[first[rows] != ball.leaf]):
                self._compare(parts, rows, ball, best, index)
                compared += len(rows) * len(ball.entries)
        return index, best, compared


@dataclass
class Codebooks:
    """Entries by part position: integers of shape (parts, entries, width)."""

    entries: np.ndarray
    scale: int = SCALE

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def searchers(self) -> list[Searcher]:
        return [Searcher(book) for book in self.entries]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Vectors that stand for codes (rows of indexes): the middles of the entries' cells."""
        parts = [book[codes[:, p]] for p, book in enumerate(self.entries)]
        return (np.concatenate(parts, axis=1) + 0.5) / self.scale


def kept(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integers(column: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of a column of vectors without nulls, in rows of ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError(f"vectors have {width} components, one has {lengths[lengths != width][0]}")
    found = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(float) * scale)
    if len(found) and np.abs(found).max() >= LIMIT:
        raise ValueError(f"components of {LIMIT / scale:g} or more can't be coded")
    return found.astype(np.int64).reshape(len(column), width)


def _vectors(df: DataFrame, vector: str, *others: str) -> DataFrame:
    """Kept vectors as ``v``, then other columns as c0, c1, ..."""
    return df.where(kept(F.col(vector))).select(F.col(vector).alias("v"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])


def first_entries(df: DataFrame, key: str, vector: str, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The parts of the kept vectors with the least keys: ``entries`` rows go to the driver."""
    rows = _vectors(df, vector, key).orderBy(F.col("c0").asc_nulls_last(), "v").limit(entries).collect()
    if not rows:
        return None
    width = len(rows[0]["v"])
    if width % parts:
        raise ValueError(f"{parts} parts don't divide {width} components")
    start = integers(pa.array([r["v"] for r in rows], pa.list_(pa.float64())), scale, width)
    return Codebooks(np.ascontiguousarray(start.reshape(len(rows), parts, width // parts).transpose(1, 0, 2)), scale)


def moved(df: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """One round: the entries become the floors of the means of the parts assigned to them; unused entries stay."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers, counts, sums = books.searchers(), np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            rows = integers(batch.column(0), books.scale, parts * width).reshape(batch.num_rows, parts, width)
            for p, search in enumerate(searchers):
                index = search(rows[:, p])[0] + p * entries
                counts += np.bincount(index, minlength=parts * entries)
                np.add.at(sums, index, rows[:, p])
        used = np.flatnonzero(counts)
        if len(used):
            yield batch_of(["slot", "n", "j", "s"], [np.repeat(used, width), np.repeat(counts[used], width), np.tile(np.arange(width), len(used)), sums[used].reshape(-1)])

    if not width:
        return books
    total = _vectors(df, vector).mapInArrow(run, "slot long, n long, j long, s long").groupBy("slot", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = books.entries.copy()
    for r in total.collect():  # a row for each number of the codebooks at most
        out[r["slot"] // entries, r["slot"] % entries, r["j"]] = int(r["s"]) // r["n"]
    return Codebooks(out, books.scale)


def fitted(df: DataFrame, key: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of all kept vectors; None without any."""
    if entries > 256:
        raise ValueError("a code has a byte for each part")
    small_batches(df.sparkSession)
    books = first_entries(df, key, vector, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = moved(df, vector, books)
    return books


def coded(df: DataFrame, books: Codebooks, key: str, vector: str, *others: str) -> DataFrame:
    """key, the other columns, code (two hex digits a part) and error (squared distances summed over parts) of each kept vector."""
    parts, entries, width = books.entries.shape
    kinds = dict(df.dtypes)
    carried = [key, *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = books.searchers()
        for batch in batches:
            n = batch.num_rows
            rows = integers(batch.column(0), books.scale, parts * width).reshape(n, parts, width)
            codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            for p, search in enumerate(searchers if width else []):
                codes[:, p], d, _ = search(rows[:, p])
                error += d
            text = codes.tobytes().hex()
            hexes = [text[i * 2 * parts : (i + 1) * 2 * parts] for i in range(n)]
            yield batch_of([f"c{i}" for i in range(len(carried))] + ["code", "error"], [*batch.columns[1:], pa.array(hexes, pa.string()), error])

    schema = ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(carried)) + ", code string, error long"
    return _vectors(df, vector, *carried).mapInArrow(run, schema)


def with_label_error(df: DataFrame, label: str, few: int = FEW) -> DataFrame:
    """``label_error``: the errors of all rows of one label, nulls together."""
    sums = df.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error"))
    sums, _ = cut(sums, "label-errors")
    same = F.col(label).eqNullSafe(F.col("__label"))
    if sums.limit(few + 1).count() <= few:
        return df.join(F.broadcast(sums), same).drop("__label")
    df = df.withColumn("__share", F.pmod(F.xxhash64("code", "error"), F.lit(SHARES)))
    sums = sums.withColumn("__own", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return df.join(sums, same & (F.col("__share") == F.col("__own"))).drop("__label", "__share", "__own")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings that can be coded."""
    df = read_table(spark, sf_dir, "embeddings")
    books = fitted(df, "vec_id", "embedding")
    if books is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    codes, _ = cut(coded(df, books, "vec_id", "embedding", "label"), "codes")
    out = with_label_error(codes, "c1")
    return out.select(F.col("c0").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    near = """d{r} AS (SELECT k, vec_id, label, p.part, v, e, list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{r} b ON p.part = b.part),
a{r} AS (SELECT k, vec_id, label, part, any_value(v) AS v, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM d{r} GROUP BY k, vec_id, label, part)"""
    move = """m{r} AS (SELECT part, e, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(v)) + 1 FROM p))) AS j) GROUP BY part, e, j),
f{r} AS (SELECT part, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS w FROM m{r} GROUP BY part, e),
b{s} AS (SELECT b.part, b.e, coalesce(f.w, b.w) AS w FROM b{r} b LEFT JOIN f{r} f ON b.part = f.part AND b.e = f.e)"""
    steps = [near.format(r=0), move.format(r=0, s=1), near.format(r=1), move.format(r=1, s=2), near.format(r=2)]
    return (
        """WITH g AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS k, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT k, vec_id, label, part, q[part * (len(q) // 16) + 1 : (part + 1) * (len(q) // 16)] AS v FROM g, (SELECT unnest(range(16)) AS part)),
b0 AS (SELECT part, k - 1 AS e, v AS w FROM p WHERE k <= 64),
"""
        + ",\n".join(steps)
        + """,
o AS (SELECT k, vec_id, label, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY k, vec_id, label)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY part, e)) FROM b2) AS codebooks_sha256 FROM o"""
    )


ORACLE_SQL = _sql()
