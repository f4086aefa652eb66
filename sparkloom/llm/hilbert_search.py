"""Approximate nearest neighbours by shifted Hilbert orderings of projected vectors.

Each ordering rotates the vectors by its own random rotation, keeps a few coordinates, maps them by the normal distribution function onto a shifted
grid and sorts by the Hilbert index of the cell.  The orderings are range-partitioned; a vector's rank in each is known from row
numbers inside partitions and one count per partition.  A query meets, in every ordering, the vectors whose ranks lie within a window around
its own; windows are cut into blocks of fixed size, blocks score all their queries at once, and the best of all blocks are merged and ranked by the
exact inner product in double precision.

Equal vectors are one node of the orderings, which stands for its smallest ids (as many as a result can show), so a very
common vector costs no more than another and ties are exact.

The window follows from the data at every size: SAMPLE queries (those of the least hashes) are compared with all nodes, the distance of ranks at which each of their true neighbours is first
met in any ordering is taken, and the window is the distance that holds the share TARGET of them.  Vectors in clusters are met in narrow windows.  Vectors without any structure (independent
directions in 64 dimensions, as in the test tables) are no nearer in an ordering than a fifth of all nodes, so a query then meets more nodes, over all orderings, than there are.

Defined cases: vectors that are null, all zero, of another length than most, or with null or non-finite components take no part, nor do
null ids; rows repeated with one id and vector count once; a query is never its own neighbour; fewer candidates than asked for give
fewer rows; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import batch_of, cut, read_table, small_batches
from sparkloom.llm.hilbert import hilbert_index, place

ORDERINGS = 8
#: queries whose true neighbours decide the window, and the share of these that it must hold
SAMPLE, TARGET = 300, 0.95
DIMS, BITS = 8, 8
BLOCK = 8192
SALTS = 64


def _valid(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            keep, out = [], []
            for i, v in enumerate(column):
                if v.is_valid and len(v) == length and v.values.null_count == 0 and ids[i].is_valid:
                    x = v.values.to_numpy().astype("<f8")
                    if np.isfinite(x).all() and x.any():
                        keep.append(i)
                        out.append((x + 0.0).tobytes())  # -0.0 becomes 0.0
            yield batch_of(["vec_id", "vec"], [ids.take(pa.array(keep, pa.int32())), pa.array(out, pa.binary())])

    return run


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """A logistic approximation of the normal distribution function; only its order and rough evenness matter."""
    return 1 / (1 + np.exp(-1.702 * np.clip(x, -20, 20)))


def orderings(length: int, count: int, seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """A projection onto random orthogonal directions and a shift for each ordering."""
    rng = np.random.default_rng(seed)
    dims = min(DIMS, length)
    return [(np.linalg.qr(rng.normal(size=(length, length)))[0][:, :dims], rng.random(dims)) for _ in range(count)]


def _keys(length: int, count: int, spread: np.ndarray, centre: np.ndarray):
    maps = orderings(length, count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([np.frombuffer(v.as_py(), "<f8") for v in batch.column(1)])
            for o, (turn, shift) in enumerate(maps):
                even = normal_cdf(((x - centre) @ turn) / np.sqrt((spread[:, None] * turn**2).sum(0) + 1e-30))
                cells = np.minimum((even + shift) / 2 * (1 << BITS), (1 << BITS) - 1).astype(np.uint64)
                curve = (hilbert_index(cells, BITS) ^ np.uint64(1 << 63)).view(np.int64)  # signed order is the curve's
                yield batch_of(["ordering", "curve", "node", "asks", "vec"], [np.full(len(x), o, np.int32), curve, batch.column(0), batch.column(2), batch.column(1)])

    return run


def _moments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(length), np.zeros(length)
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.frombuffer(v.as_py(), "<f8") for v in batch.column(0)])
                n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield batch_of(["n", "s", "q"], [np.array([n]), pa.array([s.tolist()]), pa.array([q.tolist()])])

    return run


def _block_best(k: int):
    """The k best nodes of a block for each query that meets it."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        asks = np.asarray(rows.column("asks").to_pylist(), bool)
        nodes = rows.column("node").to_numpy()
        empty = {"query": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if asks.all() or not asks.any():
            return pa.table(empty)
        vectors = np.stack([np.frombuffer(v.as_py(), "<f8") for v in rows.column("vec")])
        own, base = np.flatnonzero(asks), np.flatnonzero(~asks)
        base = base[np.argsort(nodes[base], kind="stable")]
        b, found = vectors[base], ([], [], [])
        # what a product can be off by, of vectors as long as these
        off = b.shape[1] * 2.0**-50 * np.sqrt((b * b).sum(1).max()) * np.sqrt((vectors[own] ** 2).sum(1))
        take = min(len(base), k + 11)  # some more than asked for, then the exact order
        for i in range(0, len(own), 256):
            q = own[i : i + 256]
            rough = vectors[q] @ b.T
            near = np.argpartition(-rough, take - 1, axis=1)[:, :take] if take < len(base) else np.tile(np.arange(len(base)), (len(q), 1))
            # ties at the edge of the rough choice: keep all of them in view
            edge = np.take_along_axis(rough, near, 1).min(1)
            for r in range(len(q)):
                mine = np.flatnonzero(rough[r] >= edge[r] - off[i + r])
                exact = np.einsum("ij,ij->i", b[mine], np.broadcast_to(vectors[q[r]], (len(mine), b.shape[1])))
                order = np.lexsort((nodes[base[mine]], -exact))[:k]
                found[0].append(np.full(len(order), nodes[q[r]]))
                found[1].append(nodes[base[mine[order]]])
                found[2].append(exact[order])
        return pa.table({n: pa.array(np.concatenate(x)) for n, x in zip(("query", "node", "score"), found)})

    return run


def _exact(sample: list[tuple[int, bytes]], k: int):
    """The k best nodes of a task's rows for each sampled query."""
    queries = np.array([q for q, _ in sample])
    own = np.stack([np.frombuffer(v, "<f8") for _, v in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids = np.full((len(own), k), -np.inf), np.full((len(own), k), -1)
        for batch in batches:
            if not batch.num_rows:
                continue
            nodes = batch.column(0).to_numpy()
            score = own @ np.stack([np.frombuffer(v.as_py(), "<f8") for v in batch.column(1)]).T
            score[nodes[None, :] == queries[:, None]] = -np.inf
            score, nodes = np.concatenate((best, score), 1), np.concatenate((ids, np.broadcast_to(nodes, (len(own), len(nodes)))), 1)
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            best, ids = np.take_along_axis(score, top, 1), np.take_along_axis(nodes, top, 1)
        keep = np.isfinite(best)
        yield batch_of(["query", "node", "score"], [np.repeat(queries, keep.sum(1)), ids[keep], best[keep]])

    return run


def window_for(nodes: DataFrame, ranked: DataFrame, k: int, sample: int, target: float) -> int:
    """The least distance of ranks that holds the share ``target`` of the true neighbours of sampled queries.  ``nodes``: node, vec, asks; ``ranked``: ordering, rank, node.

    At most ``sample`` queries, ``sample`` * k neighbours and their ranks go to the driver.
    """
    chosen = [(r["node"], bytes(r["vec"])) for r in nodes.where("asks").orderBy(F.xxhash64("node"), "node").limit(sample).collect()]
    if not chosen:
        return 1
    top = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    found = nodes.select("node", "vec").mapInArrow(_exact(chosen, k), "query long, node long, score double")
    pairs = [(r["query"], r["node"]) for r in found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k).select("query", "node").collect()]
    if not pairs:
        return 1
    needed = nodes.sparkSession.createDataFrame([(x,) for x in sorted({x for pair in pairs for x in pair})], "node long")
    places = {(r["ordering"], r["node"]): r["rank"] for r in ranked.select("ordering", "rank", "node").join(F.broadcast(needed), "node").collect()}
    orders = sorted({o for o, _ in places})
    apart = np.min([[abs(places[o, q] - places[o, x]) for q, x in pairs] for o in orders], axis=0)
    return max(1, int(np.quantile(apart, target, method="higher")))


def nearest(vectors: DataFrame, asks, k: int = 20, count: int = ORDERINGS, target: float = TARGET, sample: int = SAMPLE, block: int = BLOCK, window: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row of ``vectors`` (vec_id, embedding) that ``asks`` (a condition on vec_id) holds for.

    ``window``: ranks to look at on either side, by default what the sampled queries need.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sizes = own.where("embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = sizes["n"] if sizes else 0
    rows, _ = cut(own.mapInArrow(_valid(length), "vec_id long, vec binary").withColumn("hash", F.xxhash64("vec")), "vectors")
    # the smallest k + 1 ids of each distinct vector, in two steps so that a very common one is dealt over many tasks
    salted = Window.partitionBy("hash", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).orderBy("vec_id")
    one = Window.partitionBy("hash", "vec").orderBy("vec_id")
    some = rows.select("hash", "vec", "vec_id").dropDuplicates(["vec_id", "hash", "vec"]).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    some = some.withColumn("r", F.row_number().over(one)).where(F.col("r") <= k + 1).select("hash", "vec", "vec_id", "r", F.min("vec_id").over(one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("node"))
    some, _ = cut(some, "vector-ids")
    asked = rows.where(asks).select("hash", "vec", F.col("vec_id").alias("query_id")).distinct()
    asking = asked.select("hash", "vec").distinct().withColumn("asks", F.lit(True))
    nodes, _ = cut(some.where("r = 1").join(asking, ["hash", "vec"], "left").select("node", "vec", F.coalesce("asks", F.lit(False)).alias("asks")), "vector-nodes")
    n, s, q = 0, np.zeros(length), np.zeros(length)
    for r in nodes.select("vec").mapInArrow(_moments(length), "n long, s array<double>, q array<double>").collect():  # a row per task
        n, s, q = n + r["n"], s + np.array(r["s"]), q + np.array(r["q"])
    centre = s / max(n, 1)
    keyed = nodes.select("node", "vec", "asks").mapInArrow(_keys(length, count, np.maximum(q / max(n, 1) - centre**2, 0), centre), "ordering int, curve long, node long, asks boolean, vec binary")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed, _, _ = place(keyed.withColumn("zero", F.lit(0).cast("long")), ["ordering", "curve", "node"], "zero", partitions)
    ranked = placed.select("ordering", (F.col("place") - F.col("ordering").cast("long") * n).alias("rank"), "node", "asks", "vec")
    window = window_for(nodes, ranked, k, sample, target) if window is None else window
    size = int(min(block, max(64, window // 4)))
    last = max(n - 1, 0) // size
    # queries of a block are dealt over as many parts as keep a part's number of queries bounded
    parts = max(1, -(-(2 * window + size) // (8 * block)))
    base = ranked.select("ordering", F.floor(F.col("rank") / size).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "node", F.lit(False).alias("asks"), "vec")
    reach = F.sequence(F.greatest(F.floor((F.col("rank") - window) / size), F.lit(0)), F.least(F.floor((F.col("rank") + window) / size), F.lit(last)))
    questions = ranked.where("asks").select("ordering", F.explode(reach).alias("block"), F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int").alias("part"), "node", F.lit(True).alias("asks"), "vec")
    best = base.union(questions).groupBy("ordering", "block", "part").applyInArrow(_block_best(k + 1), "query long, node long, score double")
    merged = best.groupBy("query", "node").agg(F.max("score").alias("score"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    merged = merged.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1).select("query", "node", "score")
    # nodes become ids, then query vectors become query ids
    wide = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = merged.join(some.select("node", "vec_id"), "node").withColumn("r", F.row_number().over(wide)).where(F.col("r") <= k + 1)
    named, _ = cut(ids.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found")), "vector-answers")
    own_node = asked.join(some.where("r = 1").select("hash", "vec", "node"), ["hash", "vec"]).select("query_id", F.col("node").alias("query"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = own_node.join(named, "query").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x")["vec_id"].alias("vec_id"), F.col("x")["score"].alias("score"))


def op9_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product for every vec_id divisible by 20, among all rows."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
