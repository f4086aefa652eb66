"""Hilbert curve indices of integer points, and sharding along the curve.

Sharding.  Metadata dimensions are quantised to 2**bits cells that keep their order (numbers and the first bytes of strings, by
approximate quantiles of the whole table), a row's cells give its index on the Hilbert curve, rows are sorted by
(index, key) and the order is cut into runs.  Near rows of a run are near in every dimension, so min/max statistics
of a shard's files prune on any of them.

Laws.  ``rows``: counts of shards differ by one at most.  ``bytes``: a row goes to the shard that the middle of its bytes falls in, so
each shard's sum is within one row of an equal part.  Equal index values are cut like any others (by key), so a hot
source spreads over as many shards as it needs.

Ranks come from a range partitioning: counts per partition go to the driver (one number per partition), row numbers
inside partitions and these offsets give each row's place.

Defined cases: a null text has size 8 and the checksum of no bytes; null dimensions are a cell of their own, below all
others; null keys sort first; repeated rows keep distinct slots; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import batch_of, cut, read_table

SHARDS = 24
BITS = 8


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each point (rows of ``points``: unsigned coordinates of ``bits`` bits; 64 bits in all at most)."""
    x = np.ascontiguousarray(points.T).astype(np.uint64)
    dims = len(x)
    if bits * dims > 64:
        raise ValueError("an index has 64 bits at most")
    # undo excess work from the highest bit down: exchange or invert lower bits
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        low = np.uint64((1 << b) - 1)
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(up, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    # Gray code
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[dims - 1] & np.uint64(1 << b)) != 0, flip ^ np.uint64((1 << b) - 1), flip)
    x ^= flip
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out


def ordinal(column: Column, kind: str) -> Column:
    """An order-keeping number of a value: strings by their first six bytes."""
    if kind == "string":
        return F.conv(F.hex(F.rpad(F.substring(column.cast("binary"), 1, 6), 6, b"\0")), 16, 10).cast("double")
    return column.cast("double")


def quantile_cuts(numbers: DataFrame, columns: list[str], bits: int) -> list[np.ndarray]:
    """Cuts of each column between its cells 1 .. 2**bits - 1 (cell 0 is for nulls), over all rows."""
    n = 1 << bits
    shares = F.array(*[F.lit(k / (n - 1)) for k in range(1, n - 1)])
    cuts = numbers.agg(*[F.percentile_approx(c, shares, 20 * n).alias(c) for c in columns]).first()  # columns x cells numbers
    return [np.unique(np.array(cuts[c] or [], float)) for c in columns]


def with_curve(df: DataFrame, dims: list[str], bits: int, carry: list[str]) -> DataFrame:
    """Columns ``carry`` and ``curve``: the Hilbert index, as a long, of the cells of ``dims``."""
    kinds = dict(df.dtypes)
    names = [f"o{i}" for i in range(len(dims))]
    numbers = df.select(*[ordinal(F.col(d), kinds[d]).alias(o) for d, o in zip(dims, names)], *carry)
    cuts = quantile_cuts(numbers, names, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.zeros((batch.num_rows, len(cuts)), np.uint64)
            for i, own in enumerate(cuts):
                values = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                place = np.searchsorted(own, values, side="left") * ((1 << bits) - 2) // max(len(own), 1)  # few values are spread over the whole range
                points[:, i] = np.where(np.isnan(values), 0, 1 + place)
            yield batch_of([*carry, "curve"], [*batch.columns[len(cuts) :], hilbert_index(points, bits).astype(np.int64)])

    schema = ", ".join(f"{c} {kinds[c]}" for c in carry)
    return numbers.mapInArrow(run, f"{schema}, curve long")


def place(df: DataFrame, order: list[str], size: str, partitions: int) -> tuple[DataFrame, int, int]:
    """``df`` with ``place`` (rank from 0) and ``before`` (sum of ``size`` of lesser ranks) in the order of the columns, and both totals."""
    # the written table fixes which partition each row is of
    ranged, _ = cut(df.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("s")).orderBy("part").collect()  # a row per partition
    rows = bytes_ = 0
    offsets = {}
    for r in sums:
        offsets[r["part"]] = (rows, bytes_)
        rows, bytes_ = rows + r["n"], bytes_ + r["s"]
    spark = df.sparkSession
    starts = F.broadcast(spark.createDataFrame([(p, a, b) for p, (a, b) in offsets.items()], "part int, rows_before long, bytes_before long"))  # a row per partition
    w = Window.partitionBy("part").orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("own", F.row_number().over(w) - 1).withColumn("own_bytes", F.coalesce(F.sum(size).over(running), F.lit(0)))
    placed = ranked.join(starts, "part").withColumn("place", F.col("rows_before") + F.col("own")).withColumn("before", F.col("bytes_before") + F.col("own_bytes"))
    return placed.drop("rows_before", "bytes_before", "own", "own_bytes", "part"), rows, bytes_


def hilbert_shards(docs: DataFrame, dims: list[str], shards: int = SHARDS, law: str = "rows", bits: int = BITS, key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, curve, shard and slot (place in the shard) of each row of ``docs`` (key, text and the dims)."""
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    own = docs.select(
        F.col(key).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.col(d).alias(f"d{i}") for i, d in enumerate(dims)],
    )
    own, path = cut(own, "shard-input")
    indexed = with_curve(own, [f"d{i}" for i in range(len(dims))], bits, ["doc_id", "size", "text_crc32"])
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed, n, total = place(indexed, ["curve", "doc_id", "size", "text_crc32"], "size", partitions)
    if law == "rows":
        # shard s begins at rank floor(s * n / shards), so all counts are the floor or the ceiling of n / shards
        placed = placed.withColumn("shard", F.expr(f"((place + 1) * {shards}L - 1) div {max(n, 1)}L").cast("int"))
        return placed.select("doc_id", "size", "text_crc32", "curve", "shard", F.expr(f"place - (shard * {n}L) div {shards}L").alias("slot"))
    placed = placed.withColumn("shard", F.least(F.expr(f"((2 * before + size) * {shards}L) div (2 * {max(total, 1)}L)"), F.lit(shards - 1)).cast("int"))
    firsts = F.broadcast(placed.groupBy("shard").agg(F.min("place").alias("first")))  # a row per shard
    return placed.join(firsts, "shard").select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("place") - F.col("first")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """The rows of ``docs`` as one folder per shard, in curve order inside each file; keys must be unique here.  Large shards are dealt over tasks in ranges of slots."""
    placed = docs.join(assigned.select(F.col("doc_id").alias(key), "curve", "shard", "slot"), key)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def file_ranges(spark: SparkSession, path: str, dims: list[str]) -> DataFrame:
    """file, rows, and the least and greatest value of each dimension: what a reader can prune by."""
    sides = [f(d).alias(f"{n}_{d}") for d in dims for f, n in ((F.min, "min"), (F.max, "max"))]
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"), *sides)


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards along the curve of (source, lang, length, id), equal by rows."""
    docs = read_table(spark, sf_dir, "documents")
    out = hilbert_shards(docs, ["source", "lang", "n_chars", "doc_id"], SHARDS, "rows")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
