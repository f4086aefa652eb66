"""Operators against brute force, and their defined results on odd tables."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm.common import text_buffers
from sparkloom.llm import hilbert, hilbert_search, learning, positive_unlabelled, prefix_tree_join, revisit, string_kernel, style_tree, winnowing

LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(rng, n, size=400):
    return [f"w{i}" for i in rng.integers(0, size, n)]


# ---- winnowing ----


def brute_windows(docs, items, window=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    out = []
    for doc, text in docs:
        w, hit, found = cut(text), set(), set()
        for item, passage in items:
            p = cut(passage)
            n = min(window, len(p))
            own = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)} if n and item is not None else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in own:
                    hit.update(range(i, i + n))
                    found.add(item)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_winnowing_equals_all_windows(spark, bound):
    rng = np.random.default_rng(1)
    items = [(i, " ".join(words_of(rng, n))) for i, n in enumerate([40, 13, 14, 5, 1, 12, 60])] + [(100, "a a a a a a a a a a a a a a a"), (101, ""), (102, None), (None, "w1 w2")]
    docs = []
    for i in range(40):
        w = words_of(rng, int(rng.integers(0, 120)))
        for k in rng.integers(0, 8, 2):
            p = (items[k][1] or "").split()
            a = int(rng.integers(0, max(1, len(p) - 5)))
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = p[a : a + int(rng.integers(5, 40))]
        docs.append((i, ". ".join(w).replace("w1", "W1")))
    docs += [(200, "a " * 300), (201, None), (202, ""), (203, "Ünïcode w7"), (204, "w5-w5,w5")]
    d = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = [tuple(r) for r in winnowing.contaminate(d, b, broadcast_bytes=bound).collect()]
    assert sorted(got) == sorted(brute_windows(docs, items))
    kept = winnowing.without_contaminated(d, b, broadcast_bytes=bound)
    assert kept.columns == ["doc_id", "text", "item_id"] and {r.doc_id for r in kept.collect()} == {x[0] for x in got if not x[5]}
    assert winnowing.contaminate(d.limit(0), b, broadcast_bytes=bound).count() == 0
    assert winnowing.contaminate(d, b.limit(0), broadcast_bytes=bound).where("n_hit > 0").count() == 0


# ---- prefix-tree join ----


def brute_components(rows, k, percent):
    sets, parent = defaultdict(list), {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc].append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [d for d in sets if d is not None]
    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted(((d, len(s), find(d) if d is not None else None) for d in sets for s in sets[d]), key=str)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_join_equals_all_pairs(spark, k, percent):
    rng = np.random.default_rng(2)
    rows, n = [], 0
    for size in [3, 6, 10, 15, 25, 40, 80, 160, 300]:
        base = words_of(rng, size, 5000)
        for edits in [0, 0, 1, 1, 2, 3, 4, 6, 8]:
            w = list(base)
            for _ in range(edits):
                at = int(rng.integers(0, len(w)))
                w[at : at + int(rng.integers(0, 2))] = words_of(rng, int(rng.integers(0, 2)), 5000)
            rows.append((n := n + 1, " ".join(w).upper() if n % 3 else "\t".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (None, rows[5][1]), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int")
    got = sorted((tuple(r) for r in prefix_tree_join.jaccard_components(df, percent, k).collect()), key=str)
    assert got == brute_components(rows, k, percent)
    kept = prefix_tree_join.one_of_each_group(df, percent, k)
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert ids == sorted({c for d, _, c in got if d is not None}) and kept.columns == df.columns
    assert prefix_tree_join.jaccard_components(df.limit(0), percent, k).count() == 0


def test_a_family_of_many_variants(spark, monkeypatch):
    monkeypatch.setattr(prefix_tree_join, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base, rows = words_of(rng, 120, 9000), []
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 9))):
            w[at] = f"x{rng.integers(0, 9000)}"
        rows.append((i, " ".join(w)))
    got = sorted((tuple(r) for r in prefix_tree_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute_components(rows, 4, 85)


def test_tree_walk_equals_set_arithmetic():
    rng = np.random.default_rng(0)
    base = np.sort(rng.integers(0, 2**62, 200)).astype(np.uint64)

    def variant(k):
        x = base[rng.random(len(base)) > k / 200]
        return np.unique(np.concatenate((x, rng.integers(0, 2**62, rng.integers(0, 12)).astype(np.uint64))))

    a = [variant(k) for k in rng.integers(1, 30, 60)] + [base[:3], base[:1]]
    b = [variant(k) for k in rng.integers(1, 30, 80)] + [base, base[:3], np.array([5], np.uint64)]
    want = [[100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y)) for y in b] for x in a]
    assert (prefix_tree_join.tree_join(a, b) == want).all()


# ---- Hilbert ----


@pytest.mark.parametrize("dims,bits", [(2, 5), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    h = hilbert.hilbert_index(grid, bits)
    assert sorted(h.tolist()) == list(range(len(grid)))
    assert np.abs(np.diff(grid[np.argsort(h)].astype(int), axis=0)).sum(1).max() == 1


def test_shards(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, "t" * int(rng.integers(0, 300)) if i % 9 else None, "hot" if i % 3 else f"s{i % 7}", int(i % 50) if i % 8 else None) for i in range(500)] + [(None, "x", None, None), (3, "x", "hot", 1), (3, "x", "hot", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n long")
    for law in ("rows", "bytes"):
        got = hilbert.hilbert_shards(df, ["source", "n"], 24, law).collect()
        assert len(got) == len(rows) and {r.shard for r in got} == set(range(24))
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
        counts, sizes = [len(v) for v in by.values()], [sum(r.size for r in v) for v in by.values()]
        assert max(counts) - min(counts) <= 1 if law == "rows" else max(sizes) - min(sizes) <= 2 * 308
        assert all(r.size == 8 + len(t or "") and r.text_crc32 == zlib.crc32((t or "").encode()) for r in got for d, t, *_ in rows if d == r.doc_id and d not in (3, None))
    unique = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    hilbert.write_shards(unique, hilbert.hilbert_shards(unique, ["source", "n"], 4), f"file://{tmp_path}/shards")
    assert spark.read.parquet(f"file://{tmp_path}/shards").count() == unique.count()
    assert hilbert.hilbert_shards(df.limit(0), ["source", "n"]).count() == 0


def classic_curve(bits, x, y):
    """The plane Hilbert curve by quadrants, from the largest down."""
    d, side = 0, 1 << (bits - 1)
    while side:
        right, up = int(bool(x & side)), int(bool(y & side))
        d += side * side * ((3 * right) ^ up)
        if not up:
            if right:
                x, y = side - 1 - (x & (side - 1)), side - 1 - (y & (side - 1))
            x, y = y, x
        x, y, side = x & (side - 1), y & (side - 1), side >> 1
    return d


def test_curve_and_cells_equal_another_computation(spark):
    """The curve is the classic one but for a turn of the plane, and a table's cells follow from the ranks of its values."""
    rng, n = np.random.default_rng(9), 255
    points = rng.integers(0, 256, (400, 2))
    turns = [lambda x, y, s=s, i=i, j=j: ((n - x if i else x), (n - y if j else y))[:: -1 if s else 1] for s in (0, 1) for i in (0, 1) for j in (0, 1)]
    same = [t for t in turns if all(classic_curve(8, *t(int(x), int(y))) == d for (x, y), d in zip(points, hilbert.hilbert_index(points.astype(np.uint64), 8)))]
    assert len(same) == 1
    rows = [(i, "t", [None, "b", "a", "zz", "m"][i % 5], [None, *range(-6, 6)][i % 13]) for i in range(650)]
    got = {r.doc_id: r.curve for r in hilbert.hilbert_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, n long"), ["source", "n"]).collect()}

    def cell(value, known):
        return 0 if value is None else 1 + sorted(known).index(value) * 254 // len(known)

    for i, _, source, k in rows:
        assert got[i] == classic_curve(8, *same[0](cell(source, ["a", "b", "m", "zz"]), cell(k, list(range(-6, 6)))))


def test_shard_files_prune_in_every_dimension(spark, tmp_path):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, "t", f"s{rng.integers(0, 20):02d}", int(rng.integers(0, 1000))) for i in range(4000)], "doc_id long, text string, source string, n long")
    hilbert.write_shards(df, hilbert.hilbert_shards(df, ["source", "n"], 24), f"file://{tmp_path}/shards")
    files = hilbert.file_ranges(spark, f"file://{tmp_path}/shards", ["source", "n"]).collect()
    assert sum(r.rows for r in files) == 4000 and len(files) >= 24
    for low in range(0, 1000, 100):
        assert sum(r.min_n < low + 50 and r.max_n >= low for r in files) <= 0.5 * len(files)
    for i in range(20):
        assert sum(r.min_source <= f"s{i:02d}" <= r.max_source for r in files) <= 0.5 * len(files)


def test_search(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    x[40:140] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 12), (1020, [float("nan")] * 12), (1040, [1.0, None] + [1.0] * 10), (1060, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in hilbert_search.nearest(df, F.col("vec_id") % 20 == 0, window=1000).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    d = x.astype(float)
    assert sorted(got) == list(range(0, 300, 20))
    for q, found in got.items():
        s = np.einsum("ij,ij->i", d, np.broadcast_to(d[q], d.shape))
        want = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        assert [v for v, _ in found] == want and np.allclose([y for _, y in found], s[want], atol=1e-12)
    few = hilbert_search.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 4
    assert hilbert_search.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("spread", [0.3, None])
def test_recall_of_measured_windows(spark, spread, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16)) * 3
    x = (centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * spread if spread else rng.normal(size=(3000, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "x", 0.5) for i, v in enumerate(x)] + [(7, x[7].tolist(), "y", 0.1)], "vec_id long, embedding array<float>, node string, score double")
    windows = []
    own = hilbert_search.window_for
    monkeypatch.setattr(hilbert_search, "window_for", lambda *a: windows.append(own(*a)) or windows[0])
    got = defaultdict(set)
    for r in hilbert_search.nearest(df, F.col("vec_id") % 20 == 0, block=64, sample=60).collect():
        got[r.query_id].add(r.vec_id)
    s = x[::20].astype(float) @ x.astype(float).T
    hit = 0
    for k, q in enumerate(range(0, 3000, 20)):
        s[k, q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s[k])[:20].tolist()))
    assert hit / (150 * 20) >= 0.9
    assert (windows[0] < 150) == bool(spread)  # structure makes windows narrow, at one size


# ---- classifiers ----


def prose(rng, n, stem=""):
    letters = list("etaoinshr")
    w = ["".join(rng.choice(letters, int(rng.integers(2, 8)))) for _ in range(n)]
    if stem:
        w[int(rng.integers(0, n))] = stem
    return " ".join(w)


def test_gapped_insults(spark):
    rng = np.random.default_rng(7)
    docs, labels = [], []
    for i in range(700):
        bad = i % 4 == 0
        docs.append((i, prose(rng, 30, rng.choice(["blockhead", "dunce", "blockheads", "dunces,"]) if bad else "")))
        labels.append((i, int(bad)))
    labels += [(1, 1), (None, 1), (2, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    machine = string_kernel.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    extra = [(9000, prose(rng, 20, "block-head")), (9001, prose(rng, 20) + " d u n c e"), (9002, None), (9003, ""), (9004, prose(rng, 3000)), (9005, "x" * 5000)]
    scored = {r.doc_id: r.score for r in string_kernel.score(spark.createDataFrame(docs + extra, "doc_id long, text string"), machine).collect()}
    held = [i for i, y in labels[:700] if zlib.crc32(str(i).encode()) % 5 == 0]
    wrong = [i for i in held if (scored[i] >= 0.5) != (i % 4 == 0)]
    assert len(wrong) <= 0.03 * len(held)
    assert scored[9000] >= 0.5 and scored[9001] >= 0.5 and scored[9002] == scored[9003] < 0.5 and scored[9005] < 0.5
    assert string_kernel.fit(d, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) is None
    assert {r.score for r in string_kernel.score(d.limit(3), None).collect()} == {0.0}


@pytest.mark.parametrize("insults, wrong", [(["blockhead"], 1), (["blockhead"], 10), (["blockhead", "dunce", "nitwit"], 5), (["blockhead", "dunce", "nitwit"], 10)])
def test_insults_survive_wrong_labels(spark, insults, wrong):
    """Clean-labelled documents that hold an insult: one, some, a thirtieth of them."""
    rng = np.random.default_rng(0)
    texts = [prose(rng, 40, rng.choice(insults)) for _ in range(80)] + [prose(rng, 40, rng.choice(insults) if i < wrong else "") for i in range(320)]
    rows = [(i, int(i < 80), s) for i, t in enumerate(texts) for s in sorted(string_kernel.bag_of(t))]
    machine = string_kernel.train(spark.createDataFrame(rows, "doc long, y int, seg string"), 80, 320)
    score = lambda x: machine.probability(np.array([max(machine.of_tokens(sorted(string_kernel.tokens(x))))]))[0]
    assert sum(score(prose(rng, 40, rng.choice(insults))) >= 0.5 for _ in range(40)) >= 36
    assert sum(score(prose(rng, 40)) >= 0.5 for _ in range(60)) <= 2


def test_collapsed_sum_equals_the_sum_over_landmarks():
    """One table of weights stands for sum_j b_j K(segment, landmark_j)."""
    rng = np.random.default_rng(2)
    marks, words = ["blockhead", "dunce", "été", "aaaa"], ["blokhead", "d u n c e".replace(" ", ""), "étés", "aaaaa", "zzz"]
    weights, table = rng.normal(size=4), np.zeros(1 << string_kernel.TABLE_BITS)
    for mark, b in zip(marks, weights):
        entries, values = string_kernel.features(mark)
        np.add.at(table, entries, b * values)
    machine = string_kernel.Machine(table, 0.25, 1.0, 0.0, -1e9)
    assert np.allclose(machine.of_tokens(words), string_kernel._kernel(words, marks) @ weights + 0.25, atol=2e-3)


def test_positive_unlabelled(spark):
    rng = np.random.default_rng(8)
    docs = [(i, prose(rng, 60) if i % 3 else " | ".join(prose(rng, 1).upper() for _ in range(60))) for i in range(900)]
    labels = [(i, 1) for i in range(900) if i % 3 and i % 2]
    d = spark.createDataFrame([*docs, (5000, None), (5001, ""), (5002, "a" * 200_000)], "doc_id long, text string")
    model = positive_unlabelled.fit(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    # a third of all is bad; of the unlabelled 600 it is a half
    assert 0.3 < model.prior < 0.7
    scored = {r.doc_id: r.score for r in positive_unlabelled.score(d, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scored[i] >= 0.3) != bool(i % 3) for i in held) <= 0.03 * len(held)
    assert all(0 <= scored[i] <= 1 for i in (5000, 5001, 5002))
    assert positive_unlabelled.fit(d, spark.createDataFrame([], "doc_id long, quality int")) is None


def quality_tables(spark, n=900, label_all=False):
    rng = np.random.default_rng(8)
    docs = [(i, prose(rng, 60) if i % 3 else " | ".join(prose(rng, 1).upper() for _ in range(60))) for i in range(n)]
    labels = [(i, int(i % 3 > 0)) for i in range(n) if label_all or (i % 3 and i % 2)]
    return docs, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_labelled_bad_documents_are_unlabelled_ones(spark):
    docs, d, labels = quality_tables(spark, label_all=True)
    model = positive_unlabelled.fit(d, labels)
    scored = {r.doc_id: r.score for r in positive_unlabelled.score(d, model).collect()}
    assert sum((scored[i] >= 0.3) != bool(i % 3) for i, _ in docs) <= 0.02 * len(docs)
    flipped = labels.where("quality = 1")  # labels of bad documents are never read
    again = {r.doc_id: r.score for r in positive_unlabelled.score(d, positive_unlabelled.fit(d, flipped)).collect()}
    assert again == scored


def test_positive_unlabelled_on_odd_tables(spark):
    docs, d, labels = quality_tables(spark, 300)
    good = d.where("doc_id % 3 > 0")
    everything = good.select("doc_id").withColumn("quality", F.lit(1))
    only_held_out_left = positive_unlabelled.fit(good, everything)
    assert only_held_out_left is None  # nothing is unlabelled
    alike = positive_unlabelled.fit(good, labels)
    assert alike.prior > 0.6  # unlabelled documents are like the positives
    assert alike.probability(positive_unlabelled.features(*text_buffers(pa.array([t for i, t in docs if i % 3])))).mean() > 0.5
    prior, clipped = positive_unlabelled.class_prior(np.linspace(0.98, 0.1, 60), 500, np.zeros(60), 500)
    assert (prior, clipped) == (positive_unlabelled.LEAST_PRIOR, True)
    model = positive_unlabelled.fit(d, labels)
    odd = spark.createDataFrame([(1, docs[1][1], "a", 0.5), (1, docs[1][1], "b", 0.1), (None, docs[1][1], None, None), (3, None, "x", 0.0)], "doc_id long, text string, positive string, score double")
    found = positive_unlabelled.with_score(odd, model, "__score").collect()
    assert len({r["__score"] for r in found[:3]}) == 1 and [r.positive for r in found] == ["a", "b", None, "x"]
    assert positive_unlabelled.fit(d.union(d).withColumn("positive", F.lit("x")).withColumn("half", F.lit(9)), labels).prior > 0  # repeated rows, clashing columns
    assert positive_unlabelled.score(d.limit(0), model).count() == 0
    assert positive_unlabelled.fit(d.limit(0), labels) is None and positive_unlabelled.fit(d, labels.limit(0)) is None


def test_labels_that_may_be_learnt(spark):
    rows = [(i, i % 2) for i in range(50)] + [(3, 0), (None, 1), (4, None), (6, 7)]
    got = {r.doc_id: r.y for r in learning.learnable(spark.createDataFrame(rows, "doc_id long, y1 int"), "y1").collect()}
    assert got == {i: i % 2 for i in range(50) if zlib.crc32(str(i).encode()) % 5 and i != 3}


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_winnowing_judges_each_row_by_its_text(spark, bound):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(None, passage), (None, "clean words"), (1, passage), (1, "other clean words"), (2, None), (2, passage), (3, passage)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = [tuple(r) for r in winnowing.contaminate(d, b, broadcast_bytes=bound).collect()]
    assert sorted(got, key=repr) == sorted(brute_windows(docs, [(7, passage)]), key=repr)
    kept = [tuple(r) for r in winnowing.without_contaminated(d, b, broadcast_bytes=bound).collect()]
    assert sorted(kept, key=repr) == sorted((x for x in docs if x[1] != passage), key=repr)


# ---- style trees ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="site-header"><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a><li>Other</ul></nav><div id="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<main><article><header><h1>Title &amp; more</h1></header><p><b>First &lt;one&gt;<br>line<p>Second&nbsp;  text</p><ul><li>x<li>y</ul><pre>a
b</pre><aside>Aside</aside><form><input>Send</form></article></main><section class="comments"><p>Nice!</p></section><div class="sidebar">Side</div><footer>&copy; x</footer>"""


def test_page(spark):
    want = "Title & more\n\nFirst <one> line\n\nSecond text\n\nx\n\ny\n\na b"
    assert style_tree.main_text(PAGE, "http://h.example/1") == want
    odd = ["", "no markup", "<p>unclosed", "<", "a < b > c", "<p title=\"a>b\">x</p>", "<p>&#233;&eacute;&bogus;</p>", "<div>" * 3000 + "deep", "<script>never closed <p>x", "</p></div>text"]
    got = [style_tree.main_text(x, None) for x in odd]
    assert got == ["", "no markup", "unclosed", "<", "a < b > c", "x", "éé&bogus;", "deep", "", "text"]


ARTICLES = [
    ('<div class="content-sidebar-wrap"><article><p>a b</p></article></div>', "a b"), ('<div class="page has-sidebar"><main><p>a b</p></main></div>', "a b"), ('<div class="post comments-open"><p>a b</p></div>', "a b"),
    ('<article><section id="legal-background"><p>a b</p></section></article>', "a b"), ('<article><div class="share-price-report"><p>a b</p></div></article>', "a b"), ("<article><p>Let <math><mi>x</mi></math> be</p></article>", "Let x be"),
    ('<article><p>a b</p><div class="post-comments"><p>c</p></div><div class="related-posts">d</div><div class="share-buttons">e</div><ul class="nav-links"><li>f</ul></article>', "a b"),
    ('<form id="frame"><main><p>a b</p><form><input>x</form></main></form>', "a b"), ('<div class="siteHeader">x</div><p>a b</p><div id="cookieNotice">y</div><div class="footer-links">z</div>', "a b"),
    ('<p>a b</p><div hidden>x</div><div style="display: none">y</div><div role="navigation">z</div><div class="sponsored-content">s</div>', "a b"),
]


def test_names_weigh_only_what_they_name():
    for html, want in ARTICLES:
        assert " ".join(style_tree.main_text(html, "http://h.example/1").split()) == want, html


def test_deep_pages_take_linear_time():
    for html in ("<div>" * 20_000 + "deep", "<b>" * 20_000 + "deep", "<div>" * 20_000 + "</section>" * 20_000 + "<td>" * 20_000 + "deep", "<div><header>" * 10_000 + "<article>deep", "<div><p>" * 10_000 + "deep"):
        start = time.time()
        assert "deep" in style_tree.main_text(html, "http://h.example/1") or "header" in html
        root = style_tree.parse(html)
        style_tree.number(root, 1)
        assert len(style_tree.evidence(root)) <= 40 * 40_000
        assert time.time() - start < 10


def test_small_hosts_learn_from_the_pool(spark):
    rng = np.random.default_rng(4)
    page = lambda host, i: f"<html><body><div class='kx'>Words that all of {host} repeat</div><div class='body{host}'><p>{prose(rng, 30)}</p></div></body></html>"
    rows = [(1000 * h + i, f"http://h{h}.example/{i}", page(h, i)) for h in range(3) for i in range(20)] + [(9000, "http://lone.example/", page("lone", 0)), (9001, "http://other.example/", page("other", 0).replace("kx", "unknown"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (1000, 0):
        got = {r.page_id: r.text for r in style_tree.extract(df, bound).collect()}
        assert [i for i, t in got.items() if "repeat" in t] == [9001]  # one page, and a class that no other host has
        assert all(len(t.split()) == 30 for i, t in got.items() if i != 9001)
    assert all("repeat" in style_tree.main_text(h, u) for _, u, h in rows)  # without the tree


def brute_importance(pages):
    """importance of each node on its host and after backing off, from all features of all pages."""
    shown, styles, content, place = defaultdict(list), defaultdict(list), defaultdict(list), {}
    for _, url, html in pages:
        if not html or not style_tree.site(url):
            continue
        root = style_tree.parse(html)
        style_tree.number(root, style_tree._hash("host", style_tree.site(url)))
        for node, kind, feature in style_tree.evidence(root):
            (shown, styles, content)[kind][node].append(feature)
            if kind == 0:
                place[node] = feature & ~3
    entropy = lambda xs, m: -sum(c / m * np.log(c / m) for c in Counter(xs).values()) / np.log(m)
    own, pools = {}, defaultdict(list)
    for node, xs in shown.items():
        m = len(xs)
        if m > 1:
            weight = style_tree.DAMPING ** len(set(styles[node]))
            counts = Counter(content[node])
            spread = sum(c * np.log(c) / np.log(m) for c in counts.values()) / len(content[node]) if content[node] else 1.0
            own[node] = (1 - weight) * entropy(styles[node], m) + weight * (1 - spread)
            if place[node]:
                pools[place[node]].append((m - 1, own[node]))
    out = {}
    for node, xs in shown.items():
        said = pools.get(place[node], [])
        pooled = (sum(a * b for a, b in said) + style_tree.POOL_WEIGHT * style_tree.PRIOR) / (sum(a for a, _ in said) + style_tree.POOL_WEIGHT)
        n = len(xs) - 1
        out[node] = (n * own.get(node, 0) + style_tree.HOST_WEIGHT * pooled) / (n + style_tree.HOST_WEIGHT)
    return out


def test_importance_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        extra = "".join(f"<div class='c{rng.integers(3)}'><a href='/{rng.integers(5)}'>l</a>{prose(rng, 2)}</div>" for _ in range(int(rng.integers(0, 4))))
        rows.append((i, f"http://h{i % 7 if i < 50 else i}.example/", f"<body><nav>menu</nav>{extra}<div class='t'>{'same' if i % 2 else prose(rng, 3)}</div></body>"))
    rows += [rows[3], (None, None, None), (70, "http://h1.example/", "")]
    got = {r.node: r.importance for r in style_tree.importance(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = brute_importance(rows)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_repeated_branches_go(spark):
    rng = np.random.default_rng(9)
    page = lambda i: f"<html><body><div>Welcome to our site, read on below</div><div class=x{'' if i % 2 else ' '}><p>{prose(rng, 30)}</p><p>{prose(rng, 20)}</p></div><p class=b>All rights are ours</p></body></html>"
    rows = [(i, f"http://{'www.' if i % 2 else ''}h.example/{i}", page(i), "x") for i in range(40)] + [(100, "http://one.example/", "<p>Alone</p>", "x"), (101, None, None, "x"), (102, "http://h.example/e", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    for bound in (1000, 0):
        got = {r.page_id: r for r in style_tree.extract(df, bound).collect()}
        assert len(got) == len(rows) and got[100].text == "Alone" and got[101].text == got[102].text == ""
        assert all("Welcome" not in got[i].text and "rights" not in got[i].text and len(got[i].text.split()) == 50 for i in range(40))
        assert all(r.n_chars == len(r.text) for r in got.values())
    assert style_tree.extract(df.limit(0)).count() == 0


def test_copies_on_a_host_keep_articles(spark):
    rng = np.random.default_rng(3)
    page = lambda title, body: f"<html><body><div>Welcome to our site</div><article><h1>{title}</h1><h2>Repeated head</h2>{body}</article></body></html>"
    bodies = ["".join(f"<p>{prose(rng, 30)}</p>" for _ in range(3)) for _ in range(2)]
    rows = [(i, f"http://h.example/{i}", page("Copy", bodies[0])) for i in range(8)] + [(8, "http://h.example/u", page("Unique", bodies[1]))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = lambda body: "\n\n".join(["Repeated head", *body[3:-4].split("</p><p>")])
    for bound in (1000, 0):
        got = {r.page_id: r.text for r in style_tree.extract(df, bound).collect()}
        assert all(got[i] == "Copy\n\n" + whole(bodies[0]) for i in range(8)) and got[8] == "Unique\n\n" + whole(bodies[1])


# ---- revisits ----


def test_revisits(spark):
    h = lambda **x: {k.replace("_", "-"): v for k, v in x.items()}
    rows = [
        (1, "http://www.A.example/x/", 10, "response", h(etag='"a"', date="10", server="s"), "d1"), (2, "https://a.example:443/x#f", 10, "revisit", h(etag='"a"'), None),
        (3, "a.example/x?utm_source=q", 20, "revisit", h(etag='W/"a"', date="20", server="z"), None), (4, "http://a.example/x", 100_000, "revisit", h(etag='"b"'), None),
        (5, "http://a.example/x", 200_000, "response", None, "d2"), (6, "http://a.example/x", 200_000, "response", h(server="t"), "d2"), (7, "http://a.example/x", 900_000, "revisit", None, "d2"),
        (8, "http://a.example/x", 900_000, "revisit", h(last_modified="1"), None), (9, None, 5, "revisit", None, None), (10, "http://b.example/?b=2&a=1", None, "revisit", None, None), (11, "http://a.example/x", 900_001, "revisit", None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>, digest string")
    got = {r.record_id: (r.state, r.resolved_id, r.headers) for r in revisit.resolve(df).collect()}
    assert got[2][:2] == ("missing", None) and got[3] == ("resolved", 1, {"etag": 'W/"a"', "date": "20", "server": "s"})
    assert got[4][:2] == ("mismatch", None) and got[7] == ("resolved", 6, {"server": "t"}) and got[8][0] == "mismatch" and got[11][:2] == ("resolved", 6)
    assert got[9][0] == got[10][0] == "missing" and len(got) == 8
    assert got == {r.record_id: (r.state, r.resolved_id, r.headers) for r in revisit.resolve(df, 10**9).collect()}
    assert revisit.resolve(df.limit(0)).count() == 0
    urls = spark.createDataFrame([("HTTP://u:p@WWW2.X.example:80/A//?ref=1&B=2&a=#z",), ("x",)], "u string").select(revisit.canonical_url(F.col("u"))).collect()
    assert [r[0] for r in urls] == ["x.example/A?B=2&a=", "x"]


# ---- rows and columns that might clash ----


def test_repeated_rows_and_clashing_columns(spark):
    captures = [(1, "http://a.example/", 10, "response", {"etag": "1"}, None), (2, "http://a.example/", 20, "revisit", {"etag": "1"}, None)]
    df = spark.createDataFrame(captures * 2, "record_id long, url string, ts long, kind string, headers map<string,string>, digest string")
    for c in ("block", "own", "before", "from", "canonical_url", "end", "state"):
        df = df.withColumn(c, F.lit("x"))
    assert [(r.record_id, r.state, r.resolved_id) for r in revisit.resolve(df).collect()] == [(2, "resolved", 1)] * 2

    docs = spark.createDataFrame([(i % 40, f"text {i % 40}", "s", i % 5) for i in range(80)], "doc_id long, text string, source string, n long")
    for c in ("curve", "shard", "slot", "place", "part", "size", "d0", "o0", "zero", "y", "bag", "score", "known", "law"):
        docs = docs.withColumn(c, F.lit("x"))
    got = hilbert.hilbert_shards(docs, ["source", "n"], 8).collect()
    assert len(got) == 80 and len({(r.shard, r.slot) for r in got}) == 80 and max(r.slot for r in got) == 9

    rng = np.random.default_rng(1)
    rows = [(i, prose(rng, 20, "dunce" if i % 3 == 0 else "")) for i in range(150)]
    d = spark.createDataFrame(rows * 2, "doc_id long, text string").withColumn("y", F.lit("x")).withColumn("bag", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] * 2, "doc_id long, toxic int")
    machine = string_kernel.fit(d, labels)
    scored = string_kernel.with_score(d, machine, "__s").collect()
    assert len(scored) == 300 and len({(r.doc_id, r["__s"]) for r in scored}) == 150 and scored[0].y == "x"
    assert string_kernel.score(d.limit(0), machine).count() == 0 and string_kernel.fit(d.limit(0), labels) is None and string_kernel.fit(d, labels.limit(0)) is None


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 50_000}" for i in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, "x" * 2_000_000), (4, "short text here")], "doc_id long, text string")
    got = {r.doc_id: r for r in prefix_tree_join.jaccard_components(docs).collect()}
    assert got[1].component_id == got[2].component_id == 1 and got[3].n_shingles == got[4].n_shingles - 0 == 1 and got[3].component_id == 3
    passage = " ".join(f"w{i}" for i in range(30_000, 30_020))
    hit = {r.doc_id: (r.n_words, r.n_hit) for r in winnowing.contaminate(docs, spark.createDataFrame([(1, passage)], "item_id long, text string")).collect()}
    assert hit == {1: (400_000, 160), 2: (400_001, 160), 3: (1, 0), 4: (3, 0)}
