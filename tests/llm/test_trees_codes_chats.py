"""Merkle manifests, product codes and chat formatting against brute force, on small and odd tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import chat, codes, merkle

# ---- Merkle ----


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_leaf(values):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    """The levels of a tree, from the leaves to its root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_steps(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return out


def plain_manifest(rows):
    """(leaf, subroot, steps) of rows (doc_id, source, lang, n_chars, text), in any order, and the root."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append(plain_tree([plain_leaf(r) for r in own]))
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for i, t in enumerate(trees):
        out += [(d, t[-1][0], plain_steps(t, at) + plain_steps(top, i)) for at, d in enumerate(t[0])]
    return sorted(out), top[-1][0]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g long, at int, n string"


def documents(spark, groups):
    rows = []
    for name, size in groups.items():
        rows += [(i * 3 if i % 5 else None, None if i % 7 == 0 else "süd", name, i, None if i % 11 == 0 else f"Text {i} 測", 5, 1, "x") for i in range(size)]
    rows += rows[:3]  # repeated rows
    random.Random(3).shuffle(rows)
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("groups", [{"a": 1}, {"a": 5}, {"a": 6, None: 1}, {"a": 61, "é": 8, "b": 9, None: 2}, {"a": 700, "b": 510}, {f"g{i}": 1 + i % 3 for i in range(75)}])
@pytest.mark.parametrize("block", [2, 20_000])
def test_manifest_equals_brute_force(spark, monkeypatch, groups, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows, df = documents(spark, groups)
    got, root = merkle.manifest(df, merkle.FIELDS, "lang", "doc_id", doc_id=F.col("doc_id"))
    got = got.withColumn("folded", merkle.folded(F.col("leaf"), F.col("steps"))).withColumn("proof", merkle.proof_digest(F.col("steps"))).collect()
    want, want_root = plain_manifest([r[:5] for r in rows])
    assert root == want_root and all(r.folded == root for r in got)
    assert sorted((r.leaf, r.subroot, [tuple(s) for s in r.steps]) for r in got) == want
    assert all(r.proof == digest(*(x for s in r.steps for x in s)) for r in got)


def test_manifest_of_nothing(spark):
    got, root = merkle.manifest(documents(spark, {"a": 3})[1].limit(0), merkle.FIELDS, "lang", "doc_id")
    assert root is None and got.count() == 0


def test_changes_are_found(spark):
    rows, df = documents(spark, {"a": 100, "b": 3})
    got, root = merkle.manifest(df, merkle.FIELDS, "lang", "doc_id", other=F.sha2(F.lit("another"), 256))
    got = got.withColumn("folded", merkle.folded(F.col("other"), F.col("steps")))
    assert got.where(F.col("folded") == root).count() == 0 and got.count() == len(rows)


# ---- product codes ----


@pytest.mark.parametrize("width, spread", [(1, 3), (4, 5), (4, 1000), (3, 1 << 24)])
def test_search_equals_brute_force(width, spread):
    """Nearest entries, ties to the lower index: small numbers tie often, entries repeat."""
    rng = np.random.default_rng(spread)
    book, parts = rng.integers(-spread, spread + 1, (64, width)), rng.integers(-spread, spread + 1, (3000, width))
    index, best, compared = codes.Searcher(book)(parts)
    d = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
    assert compared < 0.8 * d.size or width * spread < 20


def test_clusters_prune():
    rng = np.random.default_rng(1)
    book = rng.integers(-3, 4, (64, 4)) + np.repeat(rng.integers(-500, 500, (8, 4)), 8, axis=0)
    parts = book[rng.integers(0, 64, 2000)] + rng.integers(-2, 3, (2000, 4))
    index, _, compared = codes.Searcher(book)(parts)
    assert compared < 0.3 * 64 * 2000 and (index == ((parts[:, None] - book[None]) ** 2).sum(2).argmin(1)).all()


def plain_codes(rows, parts, entries, rounds):
    kept = [(k, v, y) for k, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[int(np.floor(256 * np.float32(x).astype(float))) for x in v] for _, v, _ in kept]
    width = len(ints[0]) // parts
    part = lambda v, p: tuple(v[p * width : (p + 1) * width])
    books = [[part(v, p) for v in ints[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, v: min((far(part(v, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for v in ints:
                own.setdefault(near(p, v)[1], []).append(part(v, p))
            books[p] = [tuple(sum(c) // len(own[i]) for c in zip(*own[i])) if i in own else e for i, e in enumerate(books[p])]
    out = [(k, "".join(f"{near(p, v)[1]:02x}" for p in range(parts)), sum(near(p, v)[0] for p in range(parts)), y) for (k, _, y), v in zip(kept, ints)]
    sums = {y: sum(r[2] for r in out if r[3] == y) for y in {r[3] for r in out}}
    return sorted(((k, c, e, sums[y]) for k, c, e, y in out), key=repr), books


@pytest.mark.parametrize("few", [0, 100])
def test_codes_equal_brute_force(spark, few):
    rng = random.Random(5)
    rows = [(i if i % 9 else None, [rng.choice([rng.uniform(-1, 1), 0.25]) for _ in range(8)], rng.choice([0, 1, None])) for i in range(150)]
    rows += rows[:4] + [(1000, None, 1), (1001, [None] * 8, 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] + [0.0] * 7, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    books = codes.fitted(df, "vec_id", "embedding", 4, 16, 2)
    got = codes.with_label_error(codes.coded(df, books, "vec_id", "embedding", "label"), "c1", few).collect()
    want, want_books = plain_codes(rows, 4, 16, 2)
    assert books.entries.tolist() == [[list(e) for e in b] for b in want_books]
    assert sorted(((r.c0, r.code, r.error, r.label_error) for r in got), key=repr) == want
    back = books.decode(np.array([[int(r.code[i : i + 2], 16) for i in range(0, 8, 2)] for r in got]))
    assert back.shape == (len(got), 8) and np.abs(back).max() <= 1.01


def test_odd_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert codes.fitted(empty, "vec_id", "embedding") is None
    few = spark.createDataFrame([(1, [0.5] * 16, 1), (2, [0.5] * 16, None)], "vec_id long, embedding array<double>, label int")
    books = codes.fitted(few, "vec_id", "embedding")
    assert books.entries.shape == (16, 2, 1) and {r.code for r in codes.coded(few, books, "vec_id", "embedding").collect()} == {"00" * 16}
    for rows in ([(1, [0.5] * 16), (2, [0.5] * 32)], [(1, [0.5] * 7)], [(1, [1e30] * 16)]):
        with pytest.raises(Exception, match="vectors have|parts|coded"):
            codes.fitted(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")


# ---- chats ----

MARKS = [*chat.Template().marks, "\\", "\\\\", "<", "[", "s>", "/INST]", "$1", "", "né 測 😀", "\n", " ", "]", ">"]


def plain_format(turns, learnt=("assistant",)):
    """The formatted text and the loss spans, in plain Python."""
    t = chat.Template()

    def esc(text):
        out = []
        for i, c in enumerate(text):
            out.append("\\\\" if c == "\\" else c + "\\" if any(text.startswith(m, i) for m in t.marks) else c)
        return "".join(out)

    out, spans, last = "", [], None
    for role, text in turns:
        if role != last:
            out += (t.end if last is not None else "") + t.head + esc(role) + t.body
        else:
            out += t.then
        last = role
        if role in learnt:
            spans.append((len(out.encode()), len(esc(text).encode())))
        out += esc(text)
    return out + t.end, spans


def test_chats_come_back(spark):
    rng = random.Random(11)
    words = lambda: "".join(rng.choice(MARKS) for _ in range(rng.randrange(8)))
    chats = {c: [(rng.choice(["user", "assistant", "assistant", "tool", "", words()]), words()) for _ in range(rng.randrange(1, 40))] for c in range(60)}
    chats[99] = [("assistant", f"{i} </s>") for i in range(1500)]  # longer than a run of sums
    rows = [(c, i, r if r or i % 2 else None, t if t or i % 2 else None, "x", 1) for c, turns in chats.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, one int")
    out = chat.formatted(df)
    got = {r.conv_id: (r.formatted, [tuple(s) for s in r.loss]) for r in out.collect()}
    assert got == {c: plain_format(turns) for c, turns in chats.items()}
    for r in chat.read_back(out).collect():
        assert [(t.role, t.text) for t in r.turns] == chats[r.conv_id]
        assert r.learnt == [t for role, t in chats[r.conv_id] if role == "assistant"]


def test_odd_chats(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.formatted(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, None, "user", "b"), (None, 1, "user", "a"), (None, 1, "user", "a"), (1, 1, None, None)]
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.formatted(spark.createDataFrame(rows, schema))).collect()}
    assert got == {None: [("user", "b"), ("user", "a"), ("user", "a")], 1: [("", "")]}
    long = spark.createDataFrame([(1, 0, "user", "<s>\\ é" * 400_000)], schema)
    assert chat.read_back(chat.formatted(long)).first().turns[0].text == "<s>\\ é" * 400_000


def test_templates_are_checked():
    for marks in ({"head": "x"}, {"head": "a\\b"}, {"head": "aba"}, {"head": "<s>x"}, {"head": "xx", "body": "yx"}):
        with pytest.raises(ValueError):
            chat.Template(**marks)
    assert chat.Template(head="<|im_start|>", body="<|im_body|>", then="<|im_then|>", end="<|im_end|>", reserved=())


def test_no_python_on_executors(spark, tmp_path):
    """The plan of the query has no Python node."""
    spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    plan = chat.op13_chat_format(spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
