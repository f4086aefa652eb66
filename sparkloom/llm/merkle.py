"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and a proof for each row.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else its UTF-8 length, ``:`` and value.  Nodes are digests as lowercase hex text; a parent is the SHA-256 of ARITY consecutive children
(the last run: of fewer, even one), until one node is left.  Groups are ordered by name, null first.

Building.  Leaves get their places from a range partitioning by (group, key), so each task holds runs of neighbours.  Digests are events: a partial parent gathers its children by index, and when it
has as many as the size of its group and its own place call for, it becomes an event of its own (the root of a group is an event of the tree over groups).  What is incomplete at a task's end (the edges of
its ranges) is the frontier, which is dealt out anew: by aligned blocks of leaves that are as wide as the frontier is sparse, so that each block is again an event stream of bounded length; then by group,
then for the tree over groups.  A round leaves one node for each block, so rounds are few whatever the size.

Proofs.  Each parent's children were written as a link from parent to children.  From the top down, in tiers of TIER levels, the links of an aligned block of ARITY**TIER nodes (at most 73 rows) are gathered in
one row, which has the siblings of any node of the block at places that follow from numbers alone; joined with what the block's own root needs further up, it serves the block's nodes.  Blocks are equal in size, so no
group of rows, however large, is one task's.

Defined cases: any null field is ``-``; null keys stand first, rows with equal keys are ordered by their leaves (equal rows are interchangeable); repeated rows are leaves of their own; a group of one leaf
has that leaf as its root; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import batch_of, cut, read_table, small_batches
from sparkloom.operators.ranks import with_rank

BITS = 3
ARITY = 1 << BITS
TIER = 3
HEX = 64
#: the number of the tree over groups
TOP = -1
RUN, FRONTIER, ROOT = 0, 1, 2
EVENT = "kind int, g long, n long, level int, at long, digest string"
#: a block of frontier nodes has about so many
BLOCK = 256
#: blocks of the tree over groups are as many levels high
GROUPS_WIDE = 4
#: tables of groups or ranges are broadcast up to so many rows, else joined
FEW = 100_000


def encoded(fields: list[str]) -> Column:
    """The text that a leaf is the digest of."""
    parts = []
    for c in fields:
        text = F.col(c).cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.concat(*parts)


def leaf(fields: list[str]) -> Column:
    return F.sha2(encoded(fields), 256)


def node(children: str) -> str:
    return hashlib.sha256(children.encode()).hexdigest()


def cascade(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Events (g, n, level, at, digest) in; out: links of complete parents (their children's digests in one text), roots of groups, and the events whose parents stay partial."""
    partial: dict[tuple, dict] = {}
    out: list[tuple] = []
    for batch in batches:
        for g, n, level, at, digest in zip(*(batch.column(i).to_pylist() for i in range(5))):
            while True:
                width = (n + (1 << (BITS * level)) - 1) >> (BITS * level)
                if width == 1:
                    out.append((ROOT, g, n, level, 0, digest))
                    if g == TOP:
                        break
                    g, n, level, at = TOP, groups, 0, g
                    continue
                parent = at >> BITS
                children = partial.setdefault((g, n, level, parent), {})
                children[at & (ARITY - 1)] = digest
                if len(children) < min(ARITY, width - (parent << BITS)):
                    break
                del partial[(g, n, level, parent)]
                text = "".join(children[i] for i in range(len(children)))
                out.append((RUN, g, n, level, parent, text))
                level, at, digest = level + 1, parent, node(text)
        if len(out) >= 2000:
            yield _events(out)
            out = []
    out += [(FRONTIER, g, n, level, (parent << BITS) + i, d) for (g, n, level, parent), children in partial.items() for i, d in children.items()]
    if out:
        yield _events(out)


def _events(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    return batch_of(["kind", "g", "n", "level", "at", "digest"], [pa.array(c, k) for c, k in zip(zip(*rows), kinds)])


def _right(number: Column, bits: Column) -> Column:
    return F.call_function("shiftright", number, bits)


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def placed(leaves: DataFrame, carry: list[str]) -> tuple[DataFrame, int, int]:
    """g (rank of the group), n (rows of the group), at (place in it), group, leaf and ``carry`` of rows (group, key, leaf, ...); the numbers of rows and groups.

    Rows come in ranges of (group, key, leaf), one range a task.
    """
    spark = leaves.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    own, _ = cut(leaves.withColumn("salt", F.monotonically_increasing_id()), "leaves")  # texts are read once; equal rows are told apart
    order = ["group", "key", "leaf", "salt"]
    ranged, _ = cut(own.repartitionByRange(partitions, *order).withColumn("part", F.spark_partition_id()), "leaf-ranges")
    counts, _ = cut(ranged.groupBy("group", "part").count(), "range-counts")
    sizes, _ = cut(counts.groupBy("group").agg(F.sum("count").alias("n")), "groups")
    rows, groups = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # so few names are ordered at once, more of them in ranges
    sizes = sizes.withColumn("g", (F.row_number().over(Window.orderBy("group")) - 1).cast("long")) if groups <= FEW else with_rank(sizes, ["group"], "g")
    sizes = sizes.select("g", "n", F.col("group").alias("group_"))
    sizes = F.broadcast(sizes) if groups <= FEW else sizes
    before = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = counts.select(F.col("group").alias("group_"), F.col("part").alias("part_"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    starts = starts.join(sizes, starts["group_"].eqNullSafe(sizes["group_"])).select("g", "n", "before", "part_", starts["group_"])
    rank = F.row_number().over(Window.partitionBy("part", "group").orderBy("key", "leaf", "salt")) - 1
    ranked = ranged.withColumn("own", rank)
    out = ranked.join(_few(starts), (F.col("part") == F.col("part_")) & F.col("group").eqNullSafe(F.col("group_")))
    out, _ = cut(out.select("g", "n", (F.col("before") + F.col("own")).alias("at"), "group", "leaf", *carry), "placed")
    return out, rows, groups


def build(leaves: DataFrame, rows: int, groups: int) -> tuple[DataFrame, DataFrame]:
    """The links (g, n, level, at, digest: the children's digests in one text) and the roots (g, n, digest; g -1: of all) of rows (g, n, at, leaf)."""
    run = lambda batches: cascade(batches, groups)
    events = leaves.select("g", "n", F.lit(0).alias("level"), "at", F.col("leaf").alias("digest"))
    made = []
    while True:
        done, _ = cut(events.mapInArrow(run, EVENT), "merkle")
        made.append(done)
        left = done.where(F.col("kind") == FRONTIER)
        n = left.count()
        if not n:
            break
        width = 0  # in levels: blocks of 8**width leaves have about BLOCK nodes of the frontier
        while ARITY**width * n < BLOCK * rows and ARITY**width < rows:
            width += 1
        wide = F.when(F.col("g") == TOP, F.lit(GROUPS_WIDE)).otherwise(F.lit(width))
        high = F.greatest(wide, F.col("level") + 1)  # nodes above the blocks meet their neighbours under their parents
        events = left.repartition("g", high, _right(F.col("at"), (high - F.col("level")) * BITS)).select("g", "n", "level", "at", "digest")
    all_ = made[0]
    for d in made[1:]:
        all_ = all_.union(d)
    return all_.where(F.col("kind") == RUN).drop("kind"), all_.where(F.col("kind") == ROOT).select("g", "n", "digest")


def _levels(n: Column) -> Column:
    """How many levels a tree of n leaves has above them."""
    out = F.lit(0)
    for k in range(20):
        out = out + (n > F.lit(ARITY**k)).cast("int")
    return out


STEPS = "array<struct<left:string,right:string>>"


def paths(nodes: DataFrame, links: DataFrame, above: DataFrame, most: int) -> DataFrame:
    """``nodes`` (g, n, at and others) with ``steps``, the siblings on both sides level by level, and the further columns of ``above`` (g, size: leaves of the group, up: the steps that follow the group's own).

    ``most``: no group has more leaves.
    """
    levels = 0
    while ARITY**levels < most:
        levels += 1
    tiers = -(-levels // TIER)
    further = [c for c in above.columns if c not in ("g", "up", "size")]
    top = _few(above.drop("size").withColumnRenamed("g", "g_").withColumnRenamed("up", "top_up"))
    upper = None
    for t in reversed(range(max(tiers, 1))):
        base, last = t * TIER, BITS * TIER
        own = nodes if t == 0 else links.where(F.col("level") == base - 1).select("g", "n", "at")
        local = F.col("level") - base
        blocks = links.where(local.between(0, TIER - 1)).groupBy("g", _right(F.col("at"), (F.lit(TIER - 1) - local) * BITS).alias("block"))
        blocks = blocks.agg(F.first("n").alias("m"), F.transform(F.sort_array(F.collect_list(F.struct(local.alias("l"), "at", "digest"))), lambda x: x["digest"]).alias("runs"))
        if t == 0:  # also groups of one leaf, which have no links
            alone = above.where("size = 1")
            blocks = blocks.unionByName(alone.select("g", F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("m"), F.array().cast("array<string>").alias("runs")))
        blocks = blocks.join(top, F.col("g") == F.col("g_")).drop("g_")
        if upper is None:
            blocks = blocks.withColumn("up", F.col("top_up"))
        else:  # a block below the top of its tree goes on with what its own root needs
            more = upper.select(F.col("g").alias("g_"), F.col("at").alias("at_"), F.col("steps").alias("more"))
            blocks = blocks.join(more, (F.col("g") == F.col("g_")) & (F.col("block") == F.col("at_")), "left").withColumn("up", F.coalesce("more", "top_up")).drop("g_", "at_", "more")
        blocks = blocks.select(F.col("g").alias("g_"), "block", "m", "runs", "up", *(further if t == 0 else []))
        # the block's nodes at this tier's base, and the runs of each level before
        width = F.least(F.lit(1 << last), F.shiftright(F.col("m") + F.lit((1 << BITS * base) - 1), BITS * base) - F.shiftleft(F.col("block"), last))
        runs_at = lambda k: F.shiftright(F.col("width") + F.lit((1 << BITS * k) - 1), BITS * k)
        blocks = blocks.withColumn("width", width)
        before = [F.lit(0).cast("long")]
        for k in range(1, TIER):
            before.append(before[-1] + runs_at(k))
        blocks = blocks.withColumns({f"before{k}": c for k, c in enumerate(before)})
        blocks = blocks.withColumn("tall", F.least(F.greatest(_levels(F.col("m")) - base, F.lit(0)), F.lit(TIER)))
        joined = own.join(blocks, (F.col("g") == F.col("g_")) & (F.shiftright("at", last) == F.col("block")))
        steps = []
        for k in range(TIER):
            place = F.col(f"before{k}") + F.shiftright("at", BITS * (k + 1)) - F.shiftleft(F.col("block"), BITS * (TIER - 1 - k))
            text = F.get(F.col("runs"), place.cast("int"))
            i = (F.shiftright("at", BITS * k) % ARITY).cast("int")
            steps.append(F.when(F.col("tall") > k, F.struct(F.substring(text, F.lit(1), i * HEX).alias("left"), F.substring(text, i * HEX + HEX + 1, F.lit(HEX * ARITY)).alias("right"))))
        own_steps = F.filter(F.array(*steps), lambda s: s.isNotNull())
        upper = joined.withColumn("steps", F.concat(own_steps, "up").cast(STEPS)).select(*own.columns, "steps", *(further if t == 0 else []))
        if t:
            upper, _ = cut(upper.select("g", "at", "steps"), "paths")
    return upper


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(steps, leaf, lambda a, s: F.sha2(F.concat(s["left"], a, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(df: DataFrame, fields: list[str], group: str, key: str, **carried: Column) -> tuple[DataFrame, str | None]:
    """group, leaf, subroot, steps and the ``carried`` columns of each row of ``df``, and the root of all (None without rows)."""
    spark = df.sparkSession
    small_batches(spark)
    leaves, rows, groups = placed(df.select(F.col(group).alias("group"), F.col(key).alias("key"), leaf(fields).alias("leaf"), *[c.alias(n) for n, c in carried.items()]), list(carried))
    links, roots = build(leaves, rows, groups)
    if not rows:
        empty = leaves.withColumns({"subroot": F.lit(None).cast("string"), "steps": F.lit(None).cast(STEPS)})
        return empty.select("group", "leaf", "subroot", "steps", *carried), None
    roots, _ = cut(roots, "roots")
    root = roots.where(F.col("g") == TOP).first()["digest"]
    tops = roots.where(F.col("g") != TOP).select(F.lit(TOP).cast("long").alias("g"), F.lit(groups).cast("long").alias("n"), F.col("g").alias("at"), F.col("n").alias("size"), F.col("digest").alias("subroot"))
    nothing = spark.range(1).select(F.lit(TOP).cast("long").alias("g"), F.lit(groups).cast("long").alias("size"), F.array().cast(STEPS).alias("up"))
    above = paths(tops, links.where(F.col("g") == TOP), nothing, groups).select(F.col("at").alias("g"), "size", F.col("steps").alias("up"), "subroot")
    above, _ = cut(above, "tops")
    out = paths(leaves, links.where(F.col("g") != TOP), above, rows)
    return out.select("group", "leaf", "subroot", "steps", *carried), root


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof; texts of a third of the ids are changed to lower case before their proof is checked."""
    docs = read_table(spark, sf_dir, "documents").select(*FIELDS)
    changed = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0) & (F.col("text") != changed)
    docs = docs.withColumn("changed", F.when(hit, changed))
    other = F.when(F.col("changed").isNotNull(), leaf([c if c != "text" else "changed" for c in FIELDS]))
    rows, root = manifest(docs, FIELDS, "lang", "doc_id", doc_id=F.col("doc_id"), tampered=other)
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("steps")))
    return rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", F.col("folded_root").eqNullSafe(F.lit(root)).alias("verified"))


def _sql(levels: int = 7, above: int = 4) -> str:
    """SQL for groups of up to 8**levels rows and 8**above groups."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    digest = lambda text: "sha256(" + " || ".join(field.format(c if c != "text" else text) for c in FIELDS) + ")"
    bits = "list_reduce([xor(a, b), " + ", ".join(["0::UBIGINT"] * 8) + "], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))"
    crc = f"xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)), lambda a, b: {bits}))"
    out = [
        f"base AS (SELECT row_number() OVER () AS rid, doc_id, lang, {digest('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {digest('changed')} END AS tampered FROM (SELECT *, translate(text, {letters}) AS changed FROM documents))",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM base)",
        "n0 AS (SELECT g, n, p AS i, leaf AS d FROM placed)",
    ]

    def tree(node: str, link: str, high: int) -> None:
        for k in range(high):
            out.append(f"{link}{k} AS (SELECT g, n, i // 8 AS i, string_agg(d, '' ORDER BY i) AS t FROM {node}{k} WHERE (n + {8**k - 1}) // {8**k} > 1 GROUP BY g, n, i // 8)")
            out.append(f"{node}{k + 1} AS (SELECT g, n, i, sha256(t) AS d FROM {link}{k})")

    tree("n", "r", levels)
    roots = lambda node, high: " UNION ALL ".join(f"SELECT g, d FROM {node}{k} WHERE (n + {8**k - 1}) // {8**k} = 1" for k in range(high + 1))
    out.append(f"sub AS ({roots('n', levels)})")
    out.append("t0 AS (SELECT 0 AS g, count(*) OVER () AS n, g AS i, d FROM sub)")
    tree("t", "u", above)
    out.append(f"top AS ({roots('t', above)})")
    out.append("w0 AS (SELECT doc_id, leaf, g, p, coalesce(tampered, leaf) AS acc, '' AS proof FROM placed)")
    steps = [("r", k, f"l.g = w.g AND l.i = w.p // {8 ** (k + 1)}", f"(w.p // {8**k}) % 8") for k in range(levels)] + [("u", k, f"l.i = w.g // {8 ** (k + 1)}", f"(w.g // {8**k}) % 8") for k in range(above)]
    for i, (name, k, on, at) in enumerate(steps):
        left, right = f"substr(l.t, 1, 64 * ({at}))", f"substr(l.t, 64 * ({at}) + 65)"
        out.append(f"w{i + 1} AS (SELECT w.doc_id, w.leaf, w.g, w.p, CASE WHEN l.t IS NULL THEN w.acc ELSE sha256({left} || w.acc || {right}) END AS acc, w.proof || coalesce({left} || {right}, '') AS proof FROM w{i} w LEFT JOIN {name}{k} l ON {on})")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, sub.d AS subroot, top.d AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = top.d AS verified FROM w{len(steps)} w JOIN sub ON sub.g = w.g, top"


ORACLE_SQL = _sql()
