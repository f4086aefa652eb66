"""N-gram Jaccard join over a prefix tree of globally ordered shingle sets.

A document's set is its distinct 4-word shingles, as 64-bit hashes in ascending order: one global order for all sets.
Two sets link when 100 * intersection >= 85 * union.

Distribution.  Linked sets x, y differ in at most d = (|x| + |y|) * 15 / 185 elements.  The ordered hash range is cut into P > d runs
of equal width, the same ones for all sets of a size class, so linked sets agree on a whole run: they share the tree path
of that run.  A row (hash of class, run and path, document) is emitted per non-empty run; P leaves room for runs that are empty in both,
and a set with more empty runs than that room emits these too, so no link is lost.  Rows of one path form a bucket.

Of its paths a document needs only the rarest few (as in a prefix filter over runs), and paths of one document none.

Comparison.  Documents of equal sets are collapsed first.  In a bucket each member is compared with the bucket's most popular
member, best-supported pair first, and components are formed.  In buckets that still hold several components, sketches (the parity of
a set's elements in each of some bits, of which sets that differ in d elements differ in d at most) tell which members of different components can link
at all; components so tied make a family, whose members are compared block by block, all blocks with all: results are exact, while near copies
never expand into rows of pairs, and texts that only share a passage do not gather in families that grow with the table.
Comparison walks the prefix tree of a block's ordered sets depth first (sets in lexicographic order; the partial overlap of a shared
path is kept), and leaves a subtree as soon as the elements that remain cannot reach the required overlap.

Defined cases: null or word-less texts have an empty set and link with nothing; repeated rows of one doc_id are one node (their
texts' links are all its links) and each gives a result row; rows with null doc_id are counted but take no part in links
(component_id null); an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import batch_of, cut, read_table, remove, slices_by_bytes, small_batches, text_buffers
from sparkloom.llm.words import NON_SPACE, Words, grams, mix
from sparkloom.operators.components import connected_components

SHINGLE = 4
PERCENT = 85
#: members compared with one centre in one block, and the elements of all their sets (8 bytes each), but for one larger set
BLOCK = 256
ELEMENTS = 1 << 21
#: members of a bucket whose sketches are compared in one block
SKETCHES = 2048


def size_classes(most: int = 1 << 40) -> np.ndarray:
    """Least set size of each class; classes grow by 1.4."""
    low = [1]
    while low[-1] < most:
        low.append(max(low[-1] + 1, int(low[-1] * 1.4)))
    return np.array(low, np.int64)


CLASSES = size_classes()


def runs_of_class(c: int, percent: int = PERCENT) -> tuple[int, int]:
    """Runs P of a class and the number of empty runs that P leaves room for."""
    most = int(CLASSES[c + 1]) - 1
    larger = most * 100 // percent  # the largest set that can link with one of this class
    d = (most + larger) * (100 - percent) // (100 + percent)
    room = 0 if d == 0 else 2 + d * 8 // 100
    return d + 1 + room, room


def document_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The ascending distinct shingle hashes of each text."""
    words = Words(data, offsets, NON_SPACE)
    h = words.hashes()
    all_k = grams(h, k)
    out = []
    for first, n in zip(words.first[:-1].tolist(), words.counts.tolist()):
        if n >= k:
            s = np.sort(all_k[first : first + n - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif n:
            out.append(grams(h[first : first + n], n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


#: stands for the number of paths of a set that needs all of them
ALL = -(1 << 40)


def paths(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the tree paths of each set: one per non-empty run, for each class that a partner can be of; and how many by tag.

    The tag is the class's number modulo 4, which tells a set's classes apart; it is a hash's low two bits.
    """
    totals = np.zeros((len(sets), 4), np.int64)
    jobs: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        n = len(s)
        if n:
            c = int(np.searchsorted(CLASSES, n, side="right")) - 1
            least = -(-n * percent // 100)
            while c >= 0 and int(CLASSES[c + 1]) - 1 >= least:
                jobs.setdefault(c, []).append(i)
                c -= 1
    out: list[list[np.ndarray]] = [[] for _ in sets]
    for c, rows in jobs.items():
        p, room = runs_of_class(c, percent)
        lengths = np.array([len(sets[i]) for i in rows])
        h = np.concatenate([sets[i] for i in rows])
        owner = np.repeat(np.arange(len(rows)), lengths)
        run = ((h >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
        key = owner.astype(np.int64) * p + run.astype(np.int64)
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        path = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), head)
        seed = np.uint64((c + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        tag = np.uint64(c % 4)
        sig = mix(mix(path) + mix(run[head] + seed)) & ~np.uint64(3) | tag
        edges = np.searchsorted(owner[head], np.arange(len(rows) + 1))
        for j, i in enumerate(rows):
            own = sig[edges[j] : edges[j + 1]]
            out[i].append(own)
            totals[i, c % 4] = len(own)
            if p - len(own) > room:
                totals[i, c % 4] = ALL
                gone = np.setdiff1d(np.arange(p, dtype=np.uint64), run[head][edges[j] : edges[j + 1]])
                out[i].append(mix(mix(gone + seed) ^ np.uint64(0x2545F4914F6CDD1D)) & ~np.uint64(3) | tag)
    none = np.zeros(0, np.uint64)
    return [np.concatenate(x) if x else none for x in out], totals


def set_digest(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    a, b = mix(s + np.uint64(0x632BE59BD9B4E019)), mix(s ^ np.uint64(0xD1342543DE82EF95))
    return tuple(int(x) for x in np.array([a.sum(dtype=np.uint64), b.sum(dtype=np.uint64)]).view(np.int64))


def _describe(percent: int, k: int):
    """doc_id, set size, digest, and the number of paths by tag."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices_by_bytes(offsets):
                sets = document_sets(data, offsets[a : b + 1], k)
                d = np.array([set_digest(s) for s in sets], np.int64).reshape(-1, 2)
                totals = paths(sets, percent)[1]
                yield batch_of(
                    ["doc_id", "n", "d1", "d2", "totals"],
                    [batch.column(0).slice(a, b - a), np.array([len(s) for s in sets], np.int64), d[:, 0].copy(), d[:, 1].copy(), pa.array(totals.tolist(), pa.list_(pa.int64()))],
                )

    return run


def _paths_of(percent: int, k: int):
    """A row (path, digest) for each path; equal sets of a task give theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            known = batch.column(0).is_valid().to_pylist()
            for a, b in slices_by_bytes(offsets):
                new, nodes = [], []
                for i, s in enumerate(document_sets(data, offsets[a : b + 1], k)):
                    if len(s) and known[a + i] and (d := set_digest(s)) not in seen:
                        if len(seen) > 500_000:
                            seen.clear()  # only repeats paths, which are collapsed later
                        seen.add(d)
                        new.append(s)
                        nodes.append(d[0])
                sig = paths(new, percent)[0]
                if new:
                    yield batch_of(["path", "node"], [np.concatenate(sig).view(np.int64), np.repeat(np.array(nodes, np.int64), [len(x) for x in sig])])

    return run


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of a set's elements in each of as many bits as the set has elements, up to the next power of two (64 at least)."""
    words = 1 << max(0, (len(s) - 1) // 64).bit_length()
    odd = np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.uint64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches [row, word] of fewer bits."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _sets_of(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices_by_bytes(offsets):
                sets = document_sets(data, offsets[a : b + 1], k)
                yield batch_of(
                    ["doc_id", "hashes", "sketch"],
                    [batch.column(0).slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s).tobytes() for s in sets], pa.binary())],
                )

    return run


def tree_join(probes: list[np.ndarray], members: list[np.ndarray], percent: int = PERCENT, step: int = 32) -> np.ndarray:
    """Which probes link with which members [probe, member], by one walk of the members' prefix tree for all probes together.

    A node of the tree is a shared beginning of ordered sets.  The walk keeps, per depth of the current path, each probe's overlap with the path; a
    member goes on from the depth that it shares with the one before.  At every ``step`` elements each probe's overlap so far and what
    it has left beyond the current element bound what any set below can reach; where no probe can reach its least overlap, the subtree is left.
    """
    linked = np.zeros((len(probes), len(members)), bool)
    sizes = np.array([len(x) for x in probes])
    if not sizes.any() or not members:
        return linked
    universe = np.unique(np.concatenate(probes))
    has = np.zeros((len(universe) + 1, len(probes)), np.int32)
    for k, x in enumerate(probes):
        has[np.searchsorted(universe, x), k] = 1
    passed = np.zeros((len(universe) + 2, len(probes)), np.int32)  # elements of a probe below a place of the universe
    np.cumsum(has, axis=0, out=passed[1:])
    least = -(-sizes * percent // 100)
    order = sorted(range(len(members)), key=lambda m: members[m].astype(">u8").tobytes())
    before, dead = None, -1
    overlap = np.zeros((1, len(probes)), np.int32)
    for m in order:
        x = members[m]
        shared = 0
        if before is not None:
            n = min(len(before), len(x))
            unequal = np.flatnonzero(before[:n] != x[:n])
            shared = int(unequal[0]) if len(unequal) else n
        if 0 <= dead <= shared:
            continue  # in the subtree that was left
        before, dead = x, -1
        overlap = overlap[: shared + 1]
        for a in range(shared, len(x), step):
            tail = x[a : a + step]
            at = np.searchsorted(universe, tail)
            inside = universe[np.minimum(at, len(universe) - 1)] == tail
            overlap = np.concatenate((overlap, overlap[-1] + np.cumsum(has[np.where(inside, at, len(universe))], axis=0)))
            left = sizes - passed[at[-1] + inside[-1]]
            if (overlap[-1] + left < least).all():
                dead = len(overlap) - 1
                break
        else:
            both = overlap[-1]
            linked[:, m] = 100 * both >= percent * (sizes + len(x) - both)
    return linked


def probe_groups(sets: list[np.ndarray], cells: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of probes whose tables stay within ``cells`` entries."""
    start = total = 0
    for i, x in enumerate(sets):
        if i > start and (total + len(x)) * (i + 1 - start) > cells:
            yield start, i
            start, total = i, 0
        total += len(x)
    if sets:
        yield start, len(sets)


def _compare(percent: int):
    """Links of one centre (``b`` null) with a block of members."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        centre, ids, sets = None, [], []
        for b, h in zip(rows.column("b").to_pylist(), rows.column("hashes")):
            h = np.frombuffer(h.as_py(), np.uint64)
            if b is None:
                centre = h
            else:
                ids.append(b)
                sets.append(h)
        linked = [] if centre is None else [b for b, yes in zip(ids, tree_join([centre], sets, percent)[0]) if yes]
        return pa.table({"a": pa.array([key[0].as_py()] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return run


def _blocks(block: int):
    """Blocks of a group by its members and their elements (n)."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / ELEMENTS)).cast("int")


def compare_pairs(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """The pairs (a, b; n, the size of b's set) that link.  Members of one centre are dealt in blocks by a hash, the centre's set goes to each block."""
    sized = pairs.groupBy("a").agg(_blocks(block).alias("blocks"))
    dealt = pairs.join(sized, "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    members = dealt.select("a", "block", "b").join(sets.withColumnRenamed("doc_id", "b"), "b")
    each = sized.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    centres = each.join(sets.withColumnRenamed("doc_id", "a"), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "hashes")
    return members.select("a", "block", "b", "hashes").union(centres).groupBy("a", "block").applyInArrow(_compare(percent), "a long, b long")


def possible_links(sizes: np.ndarray, sketches: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int = PERCENT, cells: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of ``left``, of ``right``) whose sizes and sketches do not rule out a link: no pair that links is missing."""
    words = np.array([len(x) for x in sketches])
    stacks = {w: (np.flatnonzero(words == w), np.stack([x for x in sketches if len(x) == w])) for w in np.unique(words).tolist()}
    place = np.zeros(len(words), np.int64)
    for rows, _ in stacks.values():
        place[rows] = np.arange(len(rows))
    for u in stacks:
        for v in stacks:
            x, y = left[words[left] == u], right[words[right] == v]
            if not len(x) or not len(y):
                continue
            w = min(u, v)
            a, b = folded(stacks[u][1][place[x]], w), folded(stacks[v][1][place[y]], w)
            step = max(1, cells // (len(y) * w))
            for i in range(0, len(x), step):
                most = (sizes[x[i : i + step], None] + sizes[y]) * (100 - percent)
                near = np.abs(sizes[x[i : i + step], None] - sizes[y]) * (100 + percent) <= most
                if near.any():
                    p, q = np.nonzero(near)
                    if 2 * len(p) < near.size:
                        differ = np.bitwise_count(a[i + p] ^ b[q]).sum(axis=1, dtype=np.int64)
                    else:
                        differ = np.bitwise_count(a[i : i + step, None] ^ b).sum(axis=2, dtype=np.int64)[p, q]
                    yes = differ * (100 + percent) <= most[p, q]
                    yield x[i + p[yes]], y[q[yes]]


def _possible_ties(percent: int):
    """Roots (a, b) of members that may link, one tie for each merge of roots; rows of a group (path, lo, hi) come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(r: int) -> int:
            while (up := parent.get(r, r)) != r:
                parent[r] = r = parent.get(up, up)
            return r

        def ties(rows: pa.Table) -> tuple[list[int], list[int]]:
            path, lo, hi, own, roots, sizes = (rows.column(c).to_numpy() for c in ("path", "lo", "hi", "own", "root", "n"))
            raw = rows.column("sketch").to_pylist()
            starts = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
            a, b = [], []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(path)]):
                known = np.array([find(r) for r in roots[s:e].tolist()])
                if (known == known[0]).all():
                    continue
                left, right = np.flatnonzero(own[s:e] == lo[s]), np.flatnonzero(own[s:e] == hi[s])
                for p, q in possible_links(sizes[s:e], [np.frombuffer(x, np.uint64) for x in raw[s:e]], left, right, percent):
                    apart = known[p] != known[q]
                    for x, y in np.unique(np.stack((known[p[apart]], known[q[apart]])), axis=1).T.tolist():
                        i, j = find(x), find(y)
                        if i != j:
                            parent[max(i, j)] = min(i, j)
                            a.append(i)
                            b.append(j)
            return a, b

        kept: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            if not len(rows):
                continue
            same = np.ones(len(rows), bool)
            for c in ("path", "lo", "hi"):
                x = rows.column(c).to_numpy()
                same &= x == x[-1]
            whole = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0  # the last group may go on
            if whole:
                a, b = ties(rows.slice(0, whole))
                yield batch_of(["a", "b"], [pa.array(a, pa.int64()), pa.array(b, pa.int64())])
            kept = rows.slice(whole)
        if kept is not None and len(kept):
            a, b = ties(kept)
            yield batch_of(["a", "b"], [pa.array(a, pa.int64()), pa.array(b, pa.int64())])

    return run


def possible_families(mixed: DataFrame, sketches: DataFrame, percent: int = PERCENT, block: int = SKETCHES) -> DataFrame:
    """Ties (a, b) of roots with members that meet in a bucket and may link, as far as their sketches tell.  ``mixed``: path, doc_id, n, root of buckets with several roots; ``sketches``: doc_id, sketch.

    Buckets of the same members are compared once.  A large bucket is dealt in blocks by a hash, each pair of blocks apart.
    """
    same = [F.bit_xor(F.xxhash64("doc_id")), F.bit_xor(F.xxhash64("doc_id", F.lit(1)))]
    one = mixed.groupBy("path").agg(same[0].alias("x"), same[1].alias("y"), F.count(F.lit(1)).alias("members")).groupBy("x", "y", "members").agg(F.min("path").alias("path"))
    sized = one.select("path", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    own = mixed.join(sized, "path").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    dealt = own.select("path", "doc_id", "n", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("path", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "doc_id", "n", "root", "own").join(sketches, "doc_id")
    rows = dealt.select("path", "lo", "hi", "own", "root", "n", "sketch").repartition("path", "lo", "hi").sortWithinPartitions("path", "lo", "hi")
    return rows.mapInArrow(_possible_ties(percent), "a long, b long").distinct()


def _compare_blocks(percent: int):
    """Links between the components of two blocks of a family; a union-find leaves one link for each merge."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id")
        ids, roots, own = (rows.column(c).to_numpy() for c in ("doc_id", "root", "own"))
        sets = [np.frombuffer(h.as_py(), np.uint64) for h in rows.column("hashes")]
        lo, hi = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        parent = {r: r for r in roots.tolist()}

        def find(r: int) -> int:
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        a, b = [], []
        members = [sets[i] for i in right]
        for start, end in probe_groups([sets[i] for i in left]):
            yes = tree_join([sets[i] for i in left[start:end]], members, percent)
            for p, m in zip(*np.nonzero(yes)):
                i, j = left[start + p], right[m]
                x, y = find(int(roots[i])), find(int(roots[j]))
                if x != y:
                    parent[x] = y
                    a.append(int(ids[i]))
                    b.append(int(ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def compare_families(members: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different roots of each family.  ``members``: family, doc_id, n (size of its set), root.

    A family is dealt in blocks by a hash and each pair of blocks is one task's group, so that no pair of documents is a row.
    """
    sized = members.groupBy("family").agg(_blocks(block).alias("blocks"))
    own = members.join(sized, "family").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    dealt = own.select("family", "doc_id", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("family", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "doc_id", "root", "own")
    return dealt.join(sets, "doc_id").groupBy("family", "lo", "hi").applyInArrow(_compare_blocks(percent), "a long, b long")


def shared_paths(docs: DataFrame, reps: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> tuple[DataFrame, str]:
    """path, rep, n, popular: the paths that can witness a link, for one document of each equal set; and the table of all paths that they are read from.

    Paths of one document only are left out.  Of the others a document needs only its rarest: linked sets differ in at most d runs, so
    in the global order by (documents of the path, path) one of the first d + 1 non-empty paths of each is common to both.
    """
    rows = docs.mapInArrow(_paths_of(percent, k), "path long, node long").repartition("path").groupBy("path", "node").agg(F.count(F.lit(1)).alias("copies"))
    of_path = Window.partitionBy("path")
    rows = rows.select("path", "node", F.count(F.lit(1)).over(of_path).alias("documents"))
    rows, all_paths = cut(rows.where("documents > 1").withColumn("tag", F.col("path").bitwiseAND(F.lit(3)).cast("int")), "tree-paths")
    in_class = Window.partitionBy("node", "tag")
    low = F.array(*[F.lit(int(c)) for c in CLASSES])
    own = F.size(F.filter(low, lambda c: c <= F.col("n"))) - 1  # the document's class; the path's is it or one of the few below
    below = F.pmod(own - F.col("tag"), F.lit(4))
    partner = F.floor(F.col("n") * 100 / percent)
    partner = F.when(below == 0, partner).otherwise(F.least(F.get(low, own - below + 1) - 1, partner))
    d = F.floor((F.col("n") + partner) * (100 - percent) / (100 + percent))
    alone = F.get("totals", F.col("tag")) - F.count(F.lit(1)).over(in_class)  # paths of this document only, the rarest of all
    ranked = (
        rows.join(reps.select(F.col("d1").alias("node"), "rep", "n", "totals"), "node")
        .withColumn("rank", alone + F.row_number().over(in_class.orderBy("documents", "path")))
        .withColumn("popular", F.sum("documents").over(Window.partitionBy("node")))
    )
    return ranked.where(F.col("rank") <= d + 1).select("path", "rep", "n", "popular"), all_paths


def jaccard_components(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, held: list[str] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, for every row of ``docs`` (doc_id, text).  Tables that the result is read from are added to ``held``; all others are removed."""
    spark, held = docs.sparkSession, [] if held is None else held
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    meta, meta_path = cut(docs.mapInArrow(_describe(percent, k), "doc_id long, n long, d1 long, d2 long, totals array<long>"), "shingle-sets")
    real = meta.where("n > 0 and doc_id is not null")
    reps, reps_path = cut(real.groupBy("d1", "d2", "n", "totals").agg(F.min("doc_id").alias("rep")), "set-classes")
    member, member_path = cut(real.join(reps.drop("totals"), ["d1", "d2", "n"]).select("doc_id", "rep"), "set-members")
    held += [meta_path, member_path]
    witnesses, all_paths = shared_paths(docs, reps, percent, k)
    kept, kept_path = cut(witnesses, "tree-witnesses")
    remove(spark, all_paths, reps_path)

    # the centre of a path's bucket is its most popular document
    bucket = Window.partitionBy("path")
    centred = kept.select("path", F.col("rep").alias("doc_id"), "n", F.max(F.struct("popular", -F.col("rep"))).over(bucket).alias("top"), F.count(F.lit(1)).over(bucket).alias("size"))
    shared, shared_path = cut(centred.where("size > 1").select("path", "doc_id", "n", (-F.col("top")["col2"]).alias("centre")), "tree-buckets")
    remove(spark, kept_path)
    sets, sets_path = cut(docs.join(shared.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_sets_of(k), "doc_id long, hashes binary, sketch binary"), "tree-sets")
    sketches, sets = sets.select("doc_id", "sketch"), sets.select("doc_id", "hashes")

    # first every member against the centre it meets most often
    met = shared.where("doc_id != centre").groupBy(F.col("centre").alias("a"), F.col("doc_id").alias("b")).agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n"))
    tried, tried_path = cut(met.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a"), F.max("n").alias("n")).select("a", "b", "n"), "tree-tried")
    links, _ = cut(compare_pairs(tried, sets, percent), "tree-links")
    roots = connected_components(links)

    # then the buckets that still hold several components: roots that meet in a bucket and may link make a family
    apart = shared.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("path", "doc_id", "n", F.coalesce("root", "doc_id").alias("root"))
    apart = apart.select("path", "doc_id", "n", "root", F.min("root").over(bucket).alias("lo"), F.max("root").over(bucket).alias("hi")).where("lo != hi")
    apart, apart_path = cut(apart.select("path", "doc_id", "n", "root"), "tree-apart")
    ties, ties_path = cut(possible_families(apart, sketches, percent), "tree-ties")
    families = connected_components(ties).select(F.col("node").alias("root"), F.col("root").alias("family"))
    more, _ = cut(compare_families(apart.groupBy("doc_id", "root").agg(F.max("n").alias("n")).join(families, "root").select("family", "doc_id", "n", "root"), sets, percent), "tree-links")
    remove(spark, shared_path, sets_path, tried_path, apart_path, ties_path)  # sets are as large as the texts
    roots = connected_components(links.union(more))

    placed = member.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("root"))
    # rows of one doc_id with several texts tie these texts' components together
    several = placed.groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("b"))
    ties, _ = cut(several.where("a != b").select("a", "b"), "tree-ties")
    if ties.limit(1).count():
        tied = connected_components(ties).select(F.col("node").alias("root"), F.col("root").alias("tied"))
        placed = placed.join(tied, "root", "left").select("doc_id", F.coalesce("tied", "root").alias("root"))
    # a component's name is its least doc_id: a rep is the least of its class, a root the least of its reps
    component = placed.groupBy("doc_id").agg(F.min("root").alias("component"))
    return meta.select("doc_id", F.col("n").alias("n_shingles")).join(component, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` with the least doc_id of their component, once each; rows with null doc_id stay."""
    held: list[str] = []
    found, _ = cut(jaccard_components(docs, percent, k, held), "group-members")
    remove(docs.sparkSession, *held)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.limit(1).count():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).union(once)


def op10_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: set size and component under 4-word shingles and a similarity of 0.85."""
    return jaccard_components(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, w[i : i + least(4, len(w)) - 1] AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
keyed AS (SELECT doc_id, md5_number(array_to_string(s, ' ')) AS s FROM shingles),
sizes AS (SELECT doc_id, count(*) AS n FROM keyed GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM keyed a JOIN keyed b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links UNION SELECT doc_id, doc_id FROM documents),
reach(x, root) USING KEY (x) AS (
  SELECT doc_id, doc_id FROM documents UNION
  SELECT e.x, min(r.root) FROM recurring.reach r JOIN edges e ON r.x = e.y JOIN recurring.reach now ON now.x = e.x GROUP BY e.x, now.root HAVING min(r.root) < now.root)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, root AS component_id FROM documents LEFT JOIN sizes USING (doc_id) JOIN reach ON doc_id = x
"""
