"""Sweeps, running sums, chains and resampling against brute force, and the rows they need on long inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import encode, metrics, record


def plain_nodes(nodes, tokens):
    out = []
    for rec, i, a, b in nodes:
        on = [(t, x, y) for r, t, x, y in tokens if r == rec and y > x and y > a and x < b]
        if on and on[0][1] <= a and on[-1][2] >= b:
            out.append((rec, i, on[0][0], on[-1][0] + 1))
    return sorted(out)


def test_nodes_equal_brute_force(spark):
    rng = random.Random(4)
    nodes, tokens = [], []
    for rec in range(25):
        at = 0
        for t in range(rng.randrange(0, 30)):
            width, gap = rng.choice([0, 1, 1, 3]), rng.choice([0, 0, 1])
            for _ in range(rng.choice([1, 1, 2])):  # bytes of one character share its place
                tokens.append((rec, len([x for x in tokens if x[0] == rec]), at + gap, at + gap + width))
            at += gap + width
        for i in range(12):
            a = rng.randrange(0, 40)
            nodes.append((rec, i, a, a + rng.randrange(1, 20)))
    n, t = spark.createDataFrame(nodes, "rec int, i int, a int, b int"), spark.createDataFrame(tokens, "rec int, t int, x int, y int")
    got = encode.anchored_nodes(n, t, 1000).select("rec", "i", "lo", "hi").collect()
    assert sorted(map(tuple, got)) == plain_nodes(nodes, tokens)


def test_a_long_record_needs_rows_in_proportion(spark):
    """100,000 tokens under 20,000 nodes, half of which span nearly everything: no step has more rows than both boundaries of all."""
    n, m = 100_000, 20_000
    tokens = spark.range(n).select(F.lit(1).alias("rec"), F.col("id").alias("t"), (F.col("id") * 2).alias("x"), (F.col("id") * 2 + 2).alias("y"))
    nodes = spark.range(m).select(F.lit(1).alias("rec"), F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, F.col("id") * 2).otherwise(F.col("id") * 8).alias("a"), F.when(F.col("id") % 2 == 0, n * 2 - F.col("id")).otherwise(F.col("id") * 8 + 6).alias("b"))
    df = encode.anchored_nodes(nodes, tokens, m)
    assert df.count() == m
    plan = df._jdf.queryExecution()
    rows = []

    def walk(node):
        found = node.metrics().get("numOutputRows")
        if found.isDefined():
            rows.append(found.get().value())
        if "AdaptiveSparkPlan" in node.getClass().getSimpleName():
            return walk(node.executedPlan())
        if "QueryStage" in node.getClass().getSimpleName():
            return walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    df.collect()
    walk(plan.executedPlan())
    assert "Join" not in plan.executedPlan().toString() and max(rows) <= 2 * (n + m)


@pytest.mark.parametrize("width", [1, 5])
def test_span_means_equal_brute_force(spark, width):
    rng = np.random.default_rng(width)
    vectors = [(f"r{r}", t, rng.normal(size=width).tolist()) for r in range(6) for t in range(20) if rng.random() < 0.8]
    spans = [(f"r{r}", f"s{k}", int(a), int(a + rng.integers(0, 15))) for r in range(7) for k, a in enumerate(rng.integers(0, 22, 12))]
    v, s = spark.createDataFrame(vectors, "rec string, t int, vec array<double>"), spark.createDataFrame(spans, "rec string, span string, lo int, hi int")
    got = {(r.rec, r.span): r["mean"] for r in encode.span_means(v, s).collect()}
    want = {}
    for rec, span, lo, hi in spans:
        own = [x for r, t, x in vectors if r == rec and lo <= t < hi]
        if own:
            want[(rec, span)] = np.mean(own, axis=0)
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def plain_progress(scores, delta):
    best, bad, out = None, 0, []
    for s in scores:
        better = best is None or s > best + delta
        best, bad = (s, 0) if better else (best, bad + 1)
        out.append((better, bad))
    return out


@pytest.mark.parametrize("delta", [0.05, 1.5])
def test_progress_equals_the_fold(spark, delta):
    rng = random.Random(8)
    runs = {"rising": [i / 7 for i in range(700)], "walk": np.cumsum([rng.gauss(0.02, 0.3) for _ in range(3000)]).tolist(), "same": [1.0] * 50, "one": [3.0], "falling": [float(-i) for i in range(60)], "steps": [round(rng.random() * 4) / 2 for _ in range(300)]}
    rows = [(k, i * 3, s) for k, own in runs.items() for i, s in enumerate(own)]
    rng.shuffle(rows)
    got = metrics.progress(spark.createDataFrame(rows, "run string, step long, score double"), min_delta=delta).orderBy("run", "step").collect()
    for k, own in runs.items():
        assert [(r.is_best, r.bad) for r in got if r.run == k] == plain_progress(own, delta), k


def test_a_long_run(spark):
    """A million evaluations of one run."""
    n = 1_000_000
    score = (F.col("id") % 1009) * 0.001 + F.log(F.col("id") + 1.0)
    df = spark.range(n).select(F.lit("a").alias("run"), F.col("id").alias("step"), score.alias("score"))
    got = metrics.progress(df, min_delta=0.5).where("is_best").orderBy("step").collect()
    scores = [r.score for r in df.orderBy("step").collect()]
    assert [r.step for r in got] == [i for i, (better, _) in enumerate(plain_progress(scores, 0.5)) if better]


def plain_interval(rows, repetitions, seed):
    cumulated = [round(65536 * sum(np.exp(-1) / np.prod(range(1, i + 1), initial=1.0) for i in range(k + 1))) for k in range(8)]

    def times(g, r):
        u = int(hashlib.md5(f"{seed}:{r // 8}:{g}".encode()).hexdigest()[4 * (r % 8) : 4 * (r % 8) + 4], 16)
        return sum(u >= t for t in cumulated)

    aps = []
    for r in range(repetitions):
        own = [(p, y) for g, p, y in rows if g is not None and y >= 0 for _ in range(times(g, r))]
        pos, n = sum(y for _, y in own), len(own)
        if 0 < pos < n:
            levels = sorted({p for p, _ in own}, reverse=True)
            at = lambda p: [y for q, y in own if q >= p]
            aps.append(sum(sum(y for q, y in own if q == p) * sum(at(p)) / len(at(p)) for p in levels) / pos)
    return np.quantile(aps, 0.025), np.quantile(aps, 0.975), len(aps)


def test_bootstrap_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(rng.choice([f"g{i}" for i in range(8)] + [None]), round(rng.random(), 1), rng.choice([0, 0, 1, -1])) for _ in range(120)]
    df = spark.createDataFrame(rows, "g string, p double, label int").repartition(5)
    low, high, used = plain_interval(rows, 30, 3)
    got = metrics.bootstrap_ap(df, "g", repetitions=30, seed=3).first()
    assert used > 20 and got.low == pytest.approx(low) and got.high == pytest.approx(high)
    assert metrics.bootstrap_ap(df.withColumn("label", F.lit(0)), "g").first().low is None


def test_multiplicities_are_poisson(spark):
    counts = np.array([r.m for r in spark.range(3000).select(metrics.multiplicities(F.col("id"), 20, 1).alias("m")).collect()])
    assert abs(counts.mean() - 1) < 0.02 and abs(counts.var() - 1) < 0.04 and abs((counts == 0).mean() - np.exp(-1)) < 0.01


def test_roles_equal_brute_force(spark):
    rng = random.Random(9)
    names = record.ROLES
    notes = [(a, a + rng.randrange(0, 9), {rng.choice(names): rng.choice([0, 1]) for _ in range(rng.randrange(0, 4))}) for a in (rng.randrange(0, 30) for _ in range(25))]
    offsets = [(i, i + rng.choice([0, 1, 2])) for i in range(35)]
    df = spark.createDataFrame([(offsets, notes)], "o array<struct<start:int,end:int>>, e array<struct<start:int,end:int,roles:map<string,int>>>")
    got = df.select(encode.evidence_roles(F.col("o"), F.col("e")).alias("r")).first().r
    for (x, y), row in zip(offsets, got):
        want = [-1.0] * len(names)
        for a, b, roles in notes:
            if y > x and y > a and x < b:
                for k, v in roles.items():
                    want[names.index(k)] = v
        assert row == want
