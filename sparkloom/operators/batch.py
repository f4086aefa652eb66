"""Deterministic batches: seeded shuffles by hash, length-homogeneous batches, padding, masking, resumption."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from sparkloom.operators.encode import FIRST_MASKABLE, MASK, PAD
from sparkloom.operators.ranks import with_rank


def drawn(seed: int, *of: Column | str) -> Column:
    """A number of 60 bits from the MD5 of the seed and some values, as other engines have it."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in of]).cast("binary")), 1, 15), 16, 10).cast("long")


def _shard(df: DataFrame, seed: int, key: str, shard_rows: int) -> Column:
    return F.pmod(drawn(seed, F.col(key), F.lit("shard")), F.lit(max(1, -(-df.count() // shard_rows))))


def epoch_length(df: DataFrame, size: int, seed: int, epoch: int, key: str = "id", shard_rows: int = 200_000) -> int:
    """The number of batches of ``epoch_batches``: each shard's last one may be short."""
    return df.groupBy(_shard(df, seed + epoch, key, shard_rows)).count().agg(F.sum(F.ceil(F.col("count") / size))).first()[0] or 0


def epoch_batches(df: DataFrame, length: str, size: int, seed: int, epoch: int, key: str = "id", block: int = 100, shard_rows: int = 200_000) -> DataFrame:
    """Each row once, with batch (a rank in the epoch's order) and slot.

    Rows are dealt by hash to as many shards as keep a shard at about ``shard_rows`` rows, shuffled inside them, sorted by length in blocks of
    ``block`` batches and cut into batches; batches are ordered by a hash of their name.  No step sorts the whole table in one task.
    """
    h = lambda *c: drawn(seed + epoch, *c)
    df = df.withColumn("__shard", _shard(df, seed + epoch, key, shard_rows))
    df = df.withColumn("__rn", F.row_number().over(Window.partitionBy("__shard").orderBy(h(F.col(key)), key)) - 1)
    df = df.withColumn("__block", F.floor(F.col("__rn") / (block * size)))
    df = df.withColumn("__at", F.row_number().over(Window.partitionBy("__shard", "__block").orderBy(length, "__rn")) - 1)
    df = df.withColumn("__name", F.concat_ws("-", "__shard", "__block", F.floor(F.col("__at") / size))).withColumn("slot", F.pmod("__at", F.lit(size)).cast("int"))
    names = df.select("__name").distinct()
    order = with_rank(names.withColumn("__hash", h(F.col("__name"))), ["__hash", "__name"], "batch").drop("__hash")
    return df.join(order, "__name").drop("__name", "__shard", "__rn", "__block", "__at")


def sampled(df: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """``n`` rows without replacement: those of the least hashes."""
    return df.orderBy(drawn(seed, key), key).limit(n)


def graphs_dropped(df: DataFrame, share: float, seed: int, batch: str = "batch", graph: str = "graph") -> DataFrame:
    """``df`` without the graphs of a share of its batches, drawn by a hash of the batch."""
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(batch)), 11).cast("double") / float(1 << 53)
    return df.withColumn(graph, F.when(unit >= share, F.col(graph)))


def collated_graphs(df: DataFrame, graph: str = "graph", batch: str = "batch", width: str = "width") -> DataFrame:
    """``df`` with ``collated``: the graph's parts filled up to the batch's largest (``width`` tokens), with masks; a batch without any graph has none.

    spans and node_mask (nodes); neighbors, relations and neighbor_mask (nodes by places); token_nodes and token_node_mask (tokens by fan); edge_index, edge_relations and edge_targets (edges, -1 unknown).
    """
    g, w = F.col(graph), Window.partitionBy(batch)
    longest = lambda xs: F.coalesce(F.array_max(F.transform(xs, lambda x: F.size(x))), F.lit(0))
    most = lambda c: F.greatest(F.lit(1), F.coalesce(F.max(F.when(g.isNotNull(), c)).over(w), F.lit(0)))
    df = df.withColumns({
        "__n": most(F.size(g["spans"])), "__k": most(longest(g["neighbors"])), "__f": most(longest(g["token_nodes"])), "__e": most(F.size(g["edges"])), "__any": F.count(g).over(w) > 0,
    })
    n, k, f, e, t = (F.col(c) for c in ("__n", "__k", "__f", "__e", width))

    def fill(xs: Column, size: Column, empty: Column) -> Column:
        own = F.coalesce(xs, F.slice(F.array(empty), 1, 0))
        return F.concat(own, F.array_repeat(empty, size - F.size(own)))

    zero, no = F.lit(0), F.lit(False)
    rows = lambda xs, size, inner, get, empty: fill(F.transform(xs, lambda x: fill(F.transform(x, get), inner, empty)), size, F.array_repeat(empty, inner))
    yes = lambda x: F.lit(True)
    parts = F.struct(
        fill(F.transform(g["spans"], lambda x: F.array(x["lo"], x["hi"])), n, F.array(zero, zero)).alias("spans"), fill(F.transform(g["spans"], yes), n, no).alias("node_mask"),
        rows(g["neighbors"], n, k, lambda x: x["node"], zero).alias("neighbors"), rows(g["neighbors"], n, k, lambda x: x["relation"], zero).alias("relations"), rows(g["neighbors"], n, k, yes, no).alias("neighbor_mask"),
        rows(g["token_nodes"], t, f, lambda x: x, zero).alias("token_nodes"), rows(g["token_nodes"], t, f, yes, no).alias("token_node_mask"),
        fill(F.transform(g["edges"], lambda x: F.array(x["src"], x["dst"])), e, F.array(zero, zero)).alias("edge_index"), fill(F.transform(g["edges"], lambda x: x["relation"]), e, zero).alias("edge_relations"),
        fill(F.transform(g["edges"], lambda x: x["evidence"].cast("double")), e, F.lit(-1.0)).alias("edge_targets"),
    )
    return df.withColumn("collated", F.when(F.col("__any"), parts)).drop("__n", "__k", "__f", "__e", "__any")


def resumed(batches: DataFrame, cursor: int) -> DataFrame:
    return batches.where(F.col("batch") >= cursor)


def padded(df: DataFrame, ids: str, batch: str = "batch", multiple: int = 8) -> DataFrame:
    """ids filled up to the batch's longest, rounded up to ``multiple``; and the attention mask."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    df = df.withColumn("width", (F.ceil(longest / multiple) * multiple).cast("int"))
    gap = F.col("width") - F.size(ids)
    mask = F.concat(F.array_repeat(F.lit(True), F.size(ids)), F.array_repeat(F.lit(False), gap))
    return df.withColumn("attention", mask).withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(PAD), gap)))


#: fixed values: lengths of masked spans and how often each is drawn
SPANS = {1: 0.45, 2: 0.25, 3: 0.15, 4: 0.10, 5: 0.05}


def _unit(seeds: np.ndarray, *salts: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) of a seed per element and salts, by mixing 64-bit integers."""
    x = seeds.astype(np.uint64)
    for s in salts:
        x = (x ^ np.asarray(s, np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def masked_places(ids: np.ndarray, owner: np.ndarray, seeds: np.ndarray, attended: np.ndarray, share: float) -> np.ndarray:
    """Which tokens of a whole batch (rows one after another, ``owner`` the row of each) are selected; a row's draws depend on its seed alone.

    In each round every row draws spans at random starts among its maskable tokens until its goal is reached; a span that would pass the goal is cut.
    """
    rows = len(seeds)
    able = np.flatnonzero((ids >= FIRST_MASKABLE) & attended)
    n = np.bincount(owner[able], minlength=rows)
    first = np.cumsum(n) - n
    goal = np.where(n > 0, np.maximum(1, np.rint(share * n).astype(np.int64)), 0)
    picked, have, bounds = np.zeros(len(able), bool), np.zeros(rows, np.int64), np.cumsum(list(SPANS.values()))
    turn = 0
    while len(todo := np.flatnonzero(have < goal)):
        start = (_unit(seeds[todo], 2 * turn) * n[todo]).astype(np.int64)
        size = 1 + np.searchsorted(bounds / bounds[-1], _unit(seeds[todo], 2 * turn + 1), side="right")
        size = np.minimum(np.minimum(size, goal[todo] - have[todo]), n[todo] - start)
        begin = first[todo] + start
        shift = np.cumsum(size) - size
        at = np.repeat(begin - shift, size) + np.arange(int(size.sum()))
        have += np.bincount(owner[able[at[~picked[at]]]], minlength=rows)
        picked[at] = True
        turn += 1
    out = np.zeros(len(ids), bool)
    out[able[picked]] = True
    return out


def span_masked(df: DataFrame, ids: str, vocabulary: int, seed: int, key: str | list[str] = "id", share: float = 0.15, attention: str | None = None, kinds: str | None = None) -> DataFrame:
    """masked_ids and selected: spans of 1 to 5 tokens until the share is reached; of these 80 % become the mask, 10 % a random id below ``vocabulary``, 10 % stay.

    Only attended tokens that are not special can be selected; the ``kinds`` of selected tokens become 0.  Random numbers depend on the seed and the key alone; a batch is drawn at once.
    """
    keys = [key] if isinstance(key, str) else key
    seeded = df.withColumn("__seed", F.xxhash64(F.lit(seed), *map(F.col, keys)))
    names = seeded.columns
    schema = T.StructType([*df.schema.fields, T.StructField("masked_ids", T.ArrayType(T.IntegerType())), T.StructField("selected", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(names.index(ids))
            column = pc.fill_null(column, []) if column.null_count else column
            sizes = np.diff(column.offsets.to_numpy()).astype(np.int64)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            seeds = batch.column(len(names) - 1).to_numpy().astype(np.int64).view(np.uint64)
            attended = batch.column(names.index(attention)).flatten().to_numpy(zero_copy_only=False).astype(bool) if attention else np.ones(len(flat), bool)
            chosen = masked_places(flat, owner, seeds, attended, share)
            place = np.arange(len(flat)) - starts[owner]
            what, other = _unit(seeds[owner], 1 << 40, place), _unit(seeds[owner], 1 << 41, place)
            random = FIRST_MASKABLE + (other * (vocabulary - FIRST_MASKABLE)).astype(np.int64)
            new = np.where(chosen, np.where(what < 0.8, MASK, np.where(what < 0.9, random, flat)), flat)
            counts = np.bincount(owner[chosen], minlength=len(sizes))
            offsets = lambda n: pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            out = list(batch.columns[:-1])
            if kinds:
                at = names.index(kinds)
                own = np.where(chosen, 0, out[at].flatten().to_numpy(zero_copy_only=False))
                out[at] = pa.ListArray.from_arrays(offsets(sizes), pa.array(own, pa.int32()))
            out += [pa.ListArray.from_arrays(offsets(sizes), pa.array(new, pa.int32())), pa.ListArray.from_arrays(offsets(counts), pa.array(place[chosen], pa.int32()))]
            yield pa.RecordBatch.from_arrays(out, names=[*names[:-1], "masked_ids", "selected"])

    return seeded.mapInArrow(run, schema)


def expand_pairs(df: DataFrame, own: Column, mate: Column, relation: str) -> DataFrame:
    """Each record and its mate as rows: side 0 or 1, and the pair's relation as 0 (higher) or 1 (invariant)."""
    kind = F.when(F.col(relation) == "higher", 0).when(F.col(relation) == "invariant", 1)
    return df.select("*", kind.alias("relation_id"), F.posexplode(F.when(mate.isNull(), F.array(own)).otherwise(F.array(own, mate))).alias("side", "item"))
