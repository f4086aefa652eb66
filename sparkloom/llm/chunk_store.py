"""Token ids in a content-addressed store.

Documents are encoded with the tokenizers library and an end id is appended.  A rolling hash over the last SPAN ids cuts each id stream into
chunks where its low bits are zero (between LEAST and MOST ids), so equal passages give equal chunks wherever they stand.  A chunk's
address is the first 16 bytes of the SHA-256 of its ids as little-endian unsigned 32-bit integers.

Files, all under one folder:

* ``objects/kind=0``: the chunks: address, n (ids), body (ids as little-endian unsigned 16- or 32-bit integers, zstd), each distinct chunk once, sorted by address inside files;
* ``recipes``: doc_id, start (ids of all documents before it), n_tokens, chunks (addresses in order, 16 bytes each), root (Merkle root
  over the addresses), in files of ascending doc_id, rows ascending inside them;
* ``manifest``: part, first and last doc_id, documents, tokens, root (Merkle root over the part's document roots), a row per recipe file.

Documents are encoded once, in one job that deals chunks out by address, keeps the first of equal ones and writes them beside the recipes, which are then put in order.

``verify`` reads the files back: every body is hashed against its address, the recipes' roots are recomputed and the parts' roots and numbers compared with the manifest, and each document's
number of ids and CRC-32 are put together from those of its chunks (CRCs of concatenations combine exactly).  ``restore`` gives the id arrays.

Defined cases: a null text is an empty text: the end id only; rows with equal doc_id are ordered by n_tokens and chunks, null doc_ids come first; repeated rows are
stored by one set of chunks and have a recipe each; a text with the string of an added token gets that token's id, as from the library; an empty table gives empty files; other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import batch_of, cut, new_path, read_table, remove, slices_by_bytes, small_batches, text_buffers
from sparkloom.llm.slices import SliceEncoder

END = 2
SPAN, LEAST, MOST, MASK_BITS = 16, 64, 2048, 8
ADDRESS = 16


_encoders: dict[str, SliceEncoder] = {}


def encoder(path: str) -> SliceEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = SliceEncoder(path)
    return _encoders[path]


@lru_cache(None)
def _gear(size: int = 1 << 16) -> np.ndarray:
    """A random 64-bit number for each id (modulo ``size``)."""
    return np.random.default_rng(20240229).integers(0, 1 << 63, size, dtype=np.uint64)


def marks_of(ids: np.ndarray) -> np.ndarray:
    """Where a rolling hash of the last SPAN ids lets a chunk end."""
    rolling = _gear()[ids & 0xFFFF]
    step = 1
    while step < SPAN:  # sums over 2, 4, 8, ... ids, each shifted by its distance
        wide = rolling.copy()
        wide[step:] += rolling[:-step] << np.uint64(step)
        rolling, step = wide, 2 * step
    return np.flatnonzero((rolling >> np.uint64(20)) & np.uint64((1 << MASK_BITS) - 1) == 0) + 1


def cuts(marks: list[int], start: int, end: int, at: int = 0) -> tuple[list[int], int]:
    """Ends of the chunks of the stream from ``start`` to ``end``, and the first mark not used.

    A chunk holds SPAN ids at least before a mark counts, so ids before ``start`` have no influence.
    """
    ends, n = [], len(marks)
    while end - start > LEAST:
        while at < n and marks[at] - start < LEAST:
            at += 1
        start = min(marks[at] if at < n else end, start + MOST, end)
        ends.append(start)
    if start < end:
        ends.append(end)
    while at < n and marks[at] < end:
        at += 1
    return ends, at


_press, _unpress = zstandard.ZstdCompressor(level=1, write_checksum=False), zstandard.ZstdDecompressor()


def pack(raw: bytes, small: bool) -> bytes:
    """A chunk's ids (16 or 32 bits each) as they are stored."""
    return (b"\2" if small else b"\4") + _press.compress(raw)


def unpack(body: bytes) -> np.ndarray:
    return np.frombuffer(_unpress.decompress(body[1:]), "<u2" if body[0] == 2 else "<u4").astype("<u4")


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of SHA-256; an odd node goes up unchanged; no leaves: the hash of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        up = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() for i in range(0, len(level) - 1, 2)]
        level = up + level[len(level) & ~1 :]
    return level[0] if level else hashlib.sha256(b"").digest()


def _times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


@lru_cache(None)
def _zeros(power: int) -> np.ndarray:
    """How 2**power zero bytes act on a CRC-32: a table for each of its four bytes."""
    if power:
        before = _zeros(power - 1)
        matrix = [int(x) for x in shifted(shifted(np.array([1 << i for i in range(32)], np.uint32), before), before)]
    else:
        matrix = one = [0xEDB88320] + [1 << i for i in range(31)]
        for _ in range(3):  # 1 bit to 8 bits
            matrix = one = [_times(one, x) for x in one]
    return np.array([[_times(matrix, v << 8 * k) for v in range(256)] for k in range(4)], np.uint32)


def shifted(crcs: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][crcs & 255] ^ tables[1][(crcs >> 8) & 255] ^ tables[2][(crcs >> 16) & 255] ^ tables[3][crcs >> 24]


def crcs_of_runs(crcs: np.ndarray, sizes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """CRC-32 of the concatenations of parts edges[i] to edges[i + 1] (at least one each), from the parts' CRCs and sizes in bytes."""
    ends = np.cumsum(sizes)
    after = np.repeat(ends[edges[1:] - 1], np.diff(edges)) - ends
    out = crcs.astype(np.uint32)
    for power in range(int(after.max()).bit_length() if len(after) else 0):
        on = (after >> power) & 1 == 1
        out[on] = shifted(out[on], _zeros(power))
    return np.bitwise_xor.reduceat(out, edges[:-1]) if len(out) else out


OBJECTS = "kind int, address binary, n long, body binary, doc_id long, chunks binary, root binary"


def _encode(path: str, most: int = 500_000):
    """Chunks (kind 0) that the task has not given out yet, and a recipe (kind 1) of each document, whose address only deals it out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        seen: set[bytes] = set()
        sha = hashlib.sha256
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for first, last in slices_by_bytes(offsets):
                counts, found = own.encode(data, offsets[first : last + 1])
                ends = np.cumsum(counts)
                ids = np.insert(found, ends, END).astype("<u4")
                ends = (ends + np.arange(1, len(ends) + 1)).tolist()
                whole = memoryview(ids.tobytes())
                half = memoryview(ids.astype("<u2").tobytes())
                wide = set(np.flatnonzero(np.maximum.reduceat(ids, [0, *ends[:-1]]) >> 16).tolist())  # documents with ids beyond 16 bits
                marks, at, start = marks_of(ids).tolist(), 0, 0
                rows: tuple[list, ...] = ([], [], [], [], [], [], [])
                kinds, addresses, ns, bodies, docs, recipes, roots = rows
                for row, end in enumerate(ends):
                    names, begin = [], start
                    steps, at = cuts(marks, start, end, at)
                    for stop in steps:
                        name = sha(whole[4 * begin : 4 * stop]).digest()[:ADDRESS]
                        names.append(name)
                        if name not in seen:
                            if len(seen) >= most:
                                seen.clear()
                            seen.add(name)
                            small = row not in wide
                            kinds.append(0)
                            addresses.append(name)
                            ns.append(stop - begin)
                            bodies.append(pack(half[2 * begin : 2 * stop] if small else whole[4 * begin : 4 * stop], small))
                            docs.append(None)
                            recipes.append(None)
                            roots.append(None)
                        begin = stop
                    doc_id, joined = doc_ids[first + row], b"".join(names)
                    kinds.append(1)
                    addresses.append(sha(b"%d" % doc_id + joined if doc_id is not None else joined).digest()[:ADDRESS])
                    ns.append(end - start)
                    bodies.append(None)
                    docs.append(doc_id)
                    recipes.append(joined)
                    roots.append(merkle(names))
                    start = end
                kinds_of = (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary())
                yield batch_of(["kind", "address", "n", "body", "doc_id", "chunks", "root"], [pa.array(x, t) for x, t in zip(rows, kinds_of)])

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows, the first chunk of each address and all recipes."""
    before = None
    for batch in batches:
        keep = []
        for i, (kind, address) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if kind or address != before:
                keep.append(i)
            before = None if kind else address
        yield batch.take(pa.array(keep, pa.int32()))


def write_store(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Encode ``docs`` (doc_id, text) and write the store's files."""
    spark = docs.sparkSession
    small_batches(spark)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    objects = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(tokenizer_path), OBJECTS)
    dealt = objects.repartition("address").sortWithinPartitions("kind", "address").mapInArrow(_once, OBJECTS)
    dealt.write.partitionBy("kind").option("compression", "none").parquet(f"{path}/objects")
    order = ["doc_id", "n_tokens", "chunks"]
    found = spark.read.schema("n long, doc_id long, chunks binary, root binary, kind int").parquet(f"{path}/objects").where("kind = 1")
    placed = found.select("doc_id", F.col("n").alias("n_tokens"), "chunks", "root")
    ranged, ranged_path = cut(placed.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()), "recipes")
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per partition
    before, offsets = 0, []
    for r in sums:
        offsets.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, tokens_before long"))  # a row per partition
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    recipes = ranged.withColumn("own", F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).join(starts, "part")
    recipes = recipes.select("part", "doc_id", (F.col("own") + F.col("tokens_before")).alias("start"), "n_tokens", "chunks", "root")
    recipes.sortWithinPartitions("part", "start").write.partitionBy("part").parquet(f"{path}/recipes")
    remove(spark, ranged_path, f"{path}/objects/kind=1")
    manifest_of(read_recipes(spark, path)).write.parquet(f"{path}/manifest")


def _roots(column: str):
    """Merkle roots of lists of (place, leaf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle([x[1] for x in leaves]) for leaves in (([tuple(y.values()) for y in x]) for x in batch.column(batch.schema.get_field_index(column)).to_pylist())]
            at = batch.schema.get_field_index(column)
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return run


def manifest_of(recipes: DataFrame, fan: int = 1024) -> DataFrame:
    """part, first, last, documents, tokens, root: a Merkle tree of fan ``fan`` over each part's document roots, by start."""
    w = Window.partitionBy("part").orderBy("start")
    rows = recipes.select("part", "doc_id", "start", "n_tokens", "root", F.floor((F.row_number().over(w) - 1) / fan).alias("block"))
    blocks = rows.groupBy("part", "block").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"),
        F.array_sort(F.collect_list(F.struct("start", "root"))).alias("root"),
    )
    hashed = blocks.mapInArrow(_roots("root"), "part int, block long, first long, last long, documents long, tokens long, root binary")
    parts = hashed.groupBy("part").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"),
        F.array_sort(F.collect_list(F.struct("block", "root"))).alias("root"),
    )
    return parts.mapInArrow(_roots("root"), "part int, first long, last long, documents long, tokens long, root binary")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, start long, n_tokens long, chunks binary, root binary, part int").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("address binary, n long, body binary, kind int").parquet(f"{path}/objects").where("kind = 0").drop("kind")


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Address, ids and CRC of every stored chunk; a body that does not match its address is an error."""
    for batch in batches:
        sizes, crcs = [], []
        for address, n, body in zip(*(c.to_pylist() for c in batch.columns)):
            raw = unpack(body).tobytes()
            if hashlib.sha256(raw).digest()[:ADDRESS] != address or len(raw) != 4 * n:
                raise ValueError(f"chunk {address.hex()} is damaged")
            sizes.append(n)
            crcs.append(zlib.crc32(raw))
        yield batch_of(["address", "size", "crc"], [batch.column(0), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (start, place, address) for each chunk of a recipe, whose root is recomputed."""
    for batch in batches:
        starts, places, names = [], [], []
        for start, chunks, root in zip(*(c.to_pylist() for c in batch.columns)):
            own = [chunks[i : i + ADDRESS] for i in range(0, len(chunks), ADDRESS)]
            if merkle(own) != root:
                raise ValueError(f"recipe at {start} is damaged")
            starts += [start] * len(own)
            places += range(len(own))
            names += own
        yield batch_of(["start", "place", "address"], [pa.array(starts, pa.int64()), pa.array(places, pa.int32()), pa.array(names, pa.binary())])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of ids and CRC of each document from its chunks' sizes and CRCs, in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes, crcs = batch.column(1), batch.column(2)
        edges = sizes.offsets.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        own = sizes.flatten().to_numpy()
        tokens = np.add.reduceat(own, edges[:-1])
        yield batch_of(["start", "tokens", "crc"], [batch.column(0), pa.array(tokens, pa.int64()), pa.array(crcs_of_runs(crcs.flatten().to_numpy(), 4 * own, edges), pa.int64())])


def verify(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; damage or loss is an error.

    Every document has an id of its own (its start), as each holds the end id at least.
    """
    if not check_manifest(spark, path):
        raise ValueError(f"the recipes of {path} do not agree with its manifest")
    bodies = read_chunks(spark, path).mapInArrow(_checked, "address binary, size long, crc long")
    recipes = read_recipes(spark, path)
    uses = recipes.select("start", "chunks", "root").mapInArrow(_split, "start long, place int, address binary")
    found = uses.join(bodies, "address", "left").select("start", F.struct("place", F.expr("assert_true(size is not null, 'a chunk is missing')").alias("ok"), "size", "crc").alias("c"))
    whole = found.groupBy("start").agg(F.array_sort(F.collect_list("c")).alias("c"))  # at most the document's own chunks
    read = whole.select("start", F.col("c.size").alias("sizes"), F.col("c.crc").alias("crcs")).mapInArrow(_joined, "start long, tokens long, crc long")
    good = F.expr("assert_true(tokens = n_tokens, 'a recipe has another number of ids')")
    return recipes.select("doc_id", "start", "n_tokens").join(read, "start").where(good.isNull()).select("doc_id", "start", "n_tokens", F.col("crc").alias("ids_crc32"))


def restore(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (little-endian unsigned 32-bit integers) of every document."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [b"".join(unpack(p["body"]).tobytes() for p in parts) for parts in batch.column(1).to_pylist()]
            yield batch_of(["start", "ids"], [batch.column(0), pa.array(ids, pa.binary())])

    recipes = read_recipes(spark, path)
    uses = recipes.select("start", "chunks", "root").mapInArrow(_split, "start long, place int, address binary")
    parts = uses.join(read_chunks(spark, path), "address").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("place", "body"))).alias("c"))
    return recipes.select("doc_id", "start").join(parts.mapInArrow(join, "start long, ids binary"), "start").select("doc_id", "start", "ids")


def check_manifest(spark: SparkSession, path: str) -> bool:
    """Whether the manifest agrees with the recipe files."""
    then = spark.read.schema("part int, first long, last long, documents long, tokens long, root binary").parquet(f"{path}/manifest")
    both = manifest_of(read_recipes(spark, path)).withColumn("now", F.lit(1)).unionByName(then.withColumn("now", F.lit(-1)))
    differ = both.groupBy("part", "first", "last", "documents", "tokens", "root").agg(F.sum("now").alias("n")).where("n != 0")
    return differ.isEmpty()


def tokenizer_file() -> str:
    """Default of the ``tokenizer_path`` parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a store and read back."""
    path = new_path(spark, "store")
    write_store(read_table(spark, sf_dir, "documents"), tokenizer_file(), path)
    return verify(spark, path)
