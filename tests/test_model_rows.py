"""Encoding, batches and metrics."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import batch, encode, metrics, record
from sparkloom.plans import catalogue


def test_records_are_used_whole_or_windowed(spark):
    long = spark.createDataFrame([("a", "g", "int f(){" + "x++;" * 100 + "return x;}", 1)], "id string, group_id string, code string, label int")
    df = record.validated(long)
    assert encode.encode(df, 64).count() == 0
    rows = encode.encode(df, 64, pretrain=True).orderBy(F.col("id")).collect()
    assert sum(len(r.input_ids) - 2 for r in rows) == len(long.first().code) and all(r.label == -1 and r.input_was_windowed for r in rows)


def test_offsets_count_characters(spark):
    df = record.validated(spark.createDataFrame([("a", "g", "int café=1; /* 測試 */", None)], "id string, group_id string, code string, label int"))
    r = encode.encode(df, 64).first()
    assert r.offsets[-2].end == len("int café=1; /* 測試 */") and len(r.offsets) == len(r.input_ids) == len(r.kind_ids) == len(r.target_mask)
    assert r.label == -1 and set(r.cwe) == {-1.0}


def test_unknown_is_not_negative(spark):
    t = spark.range(1).select(encode.weakness_targets(F.array(F.lit("CWE-20"), F.lit("CWE-1")), F.array(F.lit("CWE-22")), F.lit(False))).first()[0]
    assert t[:3] == [1.0, 0.0, -1.0]


def test_epochs(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 37 % 100).alias("n"))
    got = batch.epoch_batches(df, "n", 8, 17, 0, shard_rows=250, block=4)
    a, b = got.orderBy("batch", "slot").collect(), got.orderBy("batch", "slot").collect()
    assert a == b and sorted(r.id for r in a) == list(range(500))
    assert batch.resumed(got, 10).orderBy("batch", "slot").collect() == [r for r in a if r.batch >= 10]
    assert [r.id for r in batch.epoch_batches(df, "n", 8, 17, 1, shard_rows=250, block=4).orderBy("batch", "slot").collect()] != [r.id for r in a]


def test_masking(spark):
    df = spark.createDataFrame([(i, [2, *range(20, 120), 3]) for i in range(20)] + [(99, [])], "id int, ids array<int>")
    for r in batch.span_masked(df, "ids", 300, 5).collect():
        assert len(r.selected) == (15 if r.ids else 0)
        assert all(x == y for i, (x, y) in enumerate(zip(r.ids, r.masked_ids)) if i not in r.selected)


def test_masking_covers_every_window(spark, tmp_path):
    texts = [(1, "ab" * 700 + "é"), (2, "x" * 510), (3, "y" * 511), (4, "short"), (5, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalogue.span_mask(spark, str(tmp_path)).collect()
    want = {}
    for doc, text in texts:
        ids = [b + 16 for b in text.encode()]
        want |= {(doc, s): [encode.CLS, *ids[s : s + 510], encode.SEP] for s in range(0, len(ids), 510)}
    assert len(rows) == len(want) and {(r.doc_id, r.window_start): r.ids for r in rows} == want
    for r in rows:
        assert len(r.masked_ids) == len(r.ids) and len(r.selected) == max(1, round(0.15 * (len(r.ids) - 2)))
        assert 0 not in r.selected and len(r.ids) - 1 not in r.selected
        assert all(x == y for i, (x, y) in enumerate(zip(r.ids, r.masked_ids)) if i not in r.selected)
    first, second = (next(r.selected for r in rows if (r.doc_id, r.window_start) == (1, s)) for s in (0, 510))
    assert first != second


def test_snippets_of_every_part_and_offset(spark, tmp_path):
    keys = [0, 2000, 2001, 30007]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: catalogue.QUERIES[name](spark, str(tmp_path)).collect()
    code = {r.i: r.code for r in catalogue.snip(spark, str(tmp_path)).collect()}
    assert sorted(code) == keys
    for name in ("fingerprint_code", "token_kinds", "lexeme_spans", "target_mask_overlap", "evidence_lines"):
        assert {r.i for r in run(name)} == set(keys)
    assert {r.id for r in run("clang_graph")} == set(map(str, keys))
    assert {f"f{k}" for k in keys} <= {r.token for r in run("lexer_tokens")}
    want = []
    for i, text in code.items():
        a = text.index("a[i]")
        for t in range(len(text)):
            risky = 1 if a <= t < a + 4 else -1
            want.append((i, t, risky, i % 2 if a + 2 <= t < a + 6 else risky))
    assert sorted(map(tuple, run("evidence_roles_interval"))) == sorted(want)


def test_tied_threshold(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 0, 1, -1], [0.7, 0.7, 0.6, 0.2, 0.9, 0.99])), "label int, p double")
    assert metrics.fpr_threshold(df, 0.25) == math.nextafter(0.7, 1)
    with pytest.raises(ValueError):
        metrics.fpr_threshold(df.where("label = 1"), 0.1)


def test_ranking_against_pairs(spark):
    import random

    r = random.Random(1)
    rows = [(r.randint(0, 1), r.randint(0, 12) / 12) for _ in range(200)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auroc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    ap, seen = 0.0, 0.0
    for t in sorted({p for _, p in rows}, reverse=True):
        tp = sum(p >= t for p in pos)
        ap, seen = ap + (tp - seen) / len(pos) * tp / sum(p >= t for _, p in rows), tp
    got = metrics.ranking(spark.createDataFrame(rows, "label int, p double")).first()
    assert got.auroc == pytest.approx(auroc) and got.auprc == pytest.approx(ap)
    one = metrics.ranking(spark.createDataFrame([(1, 0.5)], "label int, p double")).first()
    assert one.auroc is None and one.auprc is None


def test_confusion_without_cases(spark):
    r = metrics.confusion(spark.createDataFrame([(0, 0.1), (-1, 0.9)], "label int, p double")).first()
    assert (r.n, r.precision, r.recall, r.f1, r.fpr) == (1, None, None, 0.0, 0.0) and r.zero_fp_95pct_upper_bound == pytest.approx(0.95)


def test_masked_loss(spark):
    items = spark.createDataFrame([(1, 0.0, 1.0, 2.0), (1, 5.0, -1.0, 2.0), (2, 0.0, -1.0, 9.0)], "item int, logit double, target double, weight double")
    assert metrics.masked_bce(items).first().loss == pytest.approx(math.log(2))
    assert metrics.masked_bce(items.where("item = 2")).first().loss == 0


def test_calibration_recovers_a_known_map(spark):
    df = spark.range(20_000).select(((F.col("id") % 200) / 20 - 5).alias("logit"), F.xxhash64("id").alias("h"))
    p = 1 / (1 + F.exp(-(F.col("logit") / 2 + 0.5)))
    df = df.select("logit", (F.pmod("h", F.lit(1_000_000)) / 1_000_000 < p).cast("int").alias("label"))
    t, b = metrics.fit_calibration(df)
    assert t == pytest.approx(2, abs=0.15) and b == pytest.approx(0.5, abs=0.1)


def test_bootstrap(spark):
    df = spark.createDataFrame([(i % 2, (i * 7 % 10) / 10, i % 5) for i in range(60)], "label int, p double, g int")
    a, b = metrics.bootstrap_ap(df, "g", repetitions=30).first(), metrics.bootstrap_ap(df, "g", repetitions=30).first()
    assert a == b and 0 <= a.low <= a.high <= 1
    assert metrics.bootstrap_ap(df.where("g = 1"), "g").first().low is None
