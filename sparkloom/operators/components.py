"""Connected components of an edge table, without ever gathering a component in one place.

Each task first contracts its own edges to stars (union-find over a bounded number of nodes), so paths become short.  Then large-star and small-star steps
alternate, which keep connectivity and shrink every component to a star around its least node; each step is aggregations and joins by node.  The least
neighbours of hubs go to all executors, as there are few of them (a node is a hub with more than 1 / MOST_HUBS of all edges), so a hub's edges never meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.operators.storage import cut, remove

#: at most twice so many nodes can be hubs
MOST_HUBS, LEAST_HUB = 50_000, 1000


def _contract(most: int):
    """(u, v) of each node of a task's edges and the least node that it is known to be linked with; at most ``most`` nodes are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x):
            while (y := above.get(x, x)) != x:
                above[x] = above.get(y, y)
                x = y
            return x

        def stars(schema: pa.Schema) -> pa.RecordBatch:
            pairs = [(x, r) for x in above if (r := root(x)) != x]
            above.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], f.type) for i, f in enumerate(schema)], schema=schema)

        schema = None
        for batch in batches:
            schema = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(a), root(b)
                if x != y:
                    above[max(x, y)] = min(x, y)
            if len(above) > most:
                yield stars(schema)
        if schema is not None:
            yield stars(schema)

    return run


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, most_nodes: int = 500_000) -> DataFrame:
    """(node, root) for every node that has an edge to another; ``root`` is the component's least node.

    Nulls and self-loops are left out, repeated edges count once, an empty table gives an empty table.
    """
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    e = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    contract = lambda df: df.mapInArrow(_contract(most_nodes), df.schema)
    e, path = cut(contract(e).distinct(), "components")  # v < u in every row
    for _ in range(most_rounds):
        # settled: every node has one lesser neighbour, which has none
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up")).union(e.select("v", F.lit(0)))
        open_nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 or (up = 1 and low = 0)")
        if open_nodes.isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, large_path = cut(_to_least(both, both.where("v > u"), e.count(), lambda u, v, m: (v, F.least(u, m))).where("u != v").distinct(), "components")
        small = _to_least(large, large, large.count(), lambda u, v, m: (v, m)).where("u != v").union(large.groupBy("u").agg(F.min("v").alias("v")))
        new, new_path = cut(contract(small).distinct(), "components")
        remove(spark, path, large_path)
        e, path = new, new_path
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _to_least(neighbours: DataFrame, rows: DataFrame, n_edges: int, make) -> DataFrame:
    """(u, v) made of each of ``rows`` (u, v) and m, the least of u's neighbours."""
    hub = max(LEAST_HUB, 2 * n_edges // MOST_HUBS)
    least = neighbours.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", F.col("m").alias("hub_m")))  # at most MOST_HUBS rows
    marked = rows.join(hubs, "u", "left")
    met = marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).union(marked.where("hub_m is null").select("u", "v").join(least.where(F.col("n") <= hub), "u").select("u", "v", "m"))
    u, v = make(F.col("u"), F.col("v"), F.col("m"))
    return met.select(u.alias("u"), v.alias("v"))
