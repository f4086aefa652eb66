"""Training in steps: runs that stop and go on, schedules, patience, guards, and the batched scorer."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cache, evaluate, linear, steps, tokens, training
from sparkloom.sources import files

SETTINGS = steps.Settings(bits=10, batch_size=16, warmup=3, max_steps=8, evaluate_every=4, learning_rate=0.2, weaknesses=True)


@pytest.fixture(scope="module")
def caches(spark, tmp_path_factory):
    rng, at = random.Random(0), tmp_path_factory.mktemp("caches")
    rows = [(f"{p}{i}", f"g{i}", "r", f"int f{rng.randint(0, 999)}(){{{'gets(b);' if i % 2 else 'fgets(b, n);'}}}", i % 2, p, ["CWE-125"] if i % 4 == 1 else [], ["CWE-125"]) for p, n in (("train", 90), ("validation", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "id string, group_id string, repo string, code string, label int, split string, cwes array<string>, known_cwes array<string>")
    out = []
    for part in ("train", "validation"):
        cache.prepare(df.where(F.col("split") == part), str(at / part), "sft", length=128)
        out.append(cache.open_cache(spark, str(at / part)))
    return [out[0][0], out[1][0], out[0][1], out[1][1]]


def test_stopped_and_resumed_equals_unbroken(spark, tmp_path, caches):
    """Over the ends of epochs (90 rows are six batches), at different parallelism."""
    settings = replace(SETTINGS, accumulation=2)
    whole = steps.train_steps(*caches, str(tmp_path / "a"), settings)
    assert whole["step"] == 8 and whole["last_saved_step"] == 8 and whole["validation"]["auroc"] > 0.9
    first = steps.train_steps(*caches, str(tmp_path / "b"), settings, stop_after=3)
    assert first["step"] == 3 and first["last_saved_step"] == 3 and first["weights_sha256"] != whole["weights_sha256"]
    parts = [caches[0].repartition(7), *caches[1:]]
    second = steps.train_steps(*parts, str(tmp_path / "b"), settings, resume=True, stop_after=2)
    assert second["step"] == 5
    third = steps.train_steps(*caches, str(tmp_path / "b"), settings, resume=True)
    assert (third["step"], third["seen_tokens"], third["weights_sha256"]) == (8, whole["seen_tokens"], whole["weights_sha256"])
    a, b = ({e["step"]: e["loss"] for e in files.read_events(spark, str(tmp_path / x / "events"))} for x in "ab")
    assert a == b and sorted(a) == list(range(1, 9)) and a[8] < a[1]
    assert steps.train_steps(*caches, str(tmp_path / "b"), settings, resume=True)["step"] == 8  # nothing is left to do


def test_guards_of_runs(spark, tmp_path, caches):
    run = str(tmp_path / "a")
    short = replace(SETTINGS, max_steps=2, weaknesses=False)
    steps.train_steps(*caches, run, short)
    for words, error, call in (
        ("resume it", FileExistsError, lambda: steps.train_steps(*caches, run, short)), ("either", ValueError, lambda: steps.train_steps(*caches, run, short, init=run, resume=True)),
        ("settings", ValueError, lambda: steps.train_steps(*caches, run, replace(short, max_steps=9), resume=True)),
        ("data", ValueError, lambda: steps.train_steps(*caches[:2], caches[2] | {"data": {"rows": 1}}, caches[3], run, short, resume=True)),
        ("another size", ValueError, lambda: steps.train_steps(*caches, str(tmp_path / "b"), replace(short, bits=9), init=run)),
        ("another tokenizer", ValueError, lambda: steps.train_steps(*caches[:2], *[c | {"tokenizer_sha256": "x"} for c in caches[2:]], str(tmp_path / "b"), short, init=run)),
        ("made for", ValueError, lambda: steps.train_steps(*caches[:2], caches[2], caches[2], str(tmp_path / "b"), short)),
        ("labels", ValueError, lambda: steps.Settings(stage="pretrain")), ("at least", ValueError, lambda: steps.Settings(batch_size=0)),
    ):
        with pytest.raises(error, match=words):
            call()
    started = steps.train_steps(*caches, str(tmp_path / "b"), replace(short, max_steps=1, learning_rate=0.0), init=run)
    model, about = steps.load(spark, str(tmp_path / "b"))
    assert started["weights_sha256"] == steps.load(spark, run)[1]["weights_sha256"] == about["weights_sha256"] == model.digest()
    assert about["supervision"]["risk"] == {"positive": [90], "negative": [90]}  # of both stages
    bad = caches[0].withColumn("weight", F.lit(float("inf")))
    with pytest.raises(FloatingPointError):
        steps.train_steps(bad, *caches[1:], str(tmp_path / "c"), short)


def test_patience_and_tokens_end_runs(spark, tmp_path, caches):
    got = steps.train_steps(*caches, str(tmp_path / "a"), replace(SETTINGS, max_steps=50, evaluate_every=1, patience=2, min_delta=10.0, weaknesses=False))
    assert got["step"] == 3  # the first is the best, two are not better by 10
    assert training.resolve(spark, str(tmp_path / "a")).endswith("step_00000001") and [e.get("early_stopped") for e in sorted(files.read_events(spark, str(tmp_path / "a" / "events")), key=lambda e: e["step"])] == [False, False, True]
    got = steps.train_steps(*caches, str(tmp_path / "b"), replace(SETTINGS, max_steps=50, target_tokens=1500, weaknesses=False))
    assert 1500 <= got["seen_tokens"] < 3000 and got["last_saved_step"] == got["step"]


def test_rates():
    s = replace(SETTINGS, warmup=2, max_steps=10, learning_rate=1.0, floor=0.1)
    assert [steps.rate(i, 0, s) for i in (1, 2, 10, 99)] == [0.5, 1.0, pytest.approx(0.1), pytest.approx(0.1)] and steps.rate(6, 0, s) == pytest.approx(0.55)
    assert steps.rate(6, 5, replace(s, target_tokens=10)) == pytest.approx(0.55)


def test_sums_equal_the_gradient(spark, caches):
    """Against numeric differences of the joint loss."""
    rng = np.random.default_rng(1)
    model = linear.Linear(rng.normal(0, 0.3, ((1 << 6) + 1, 2)), ["risk", "cwe:x"])
    rows = caches[0].limit(25).withColumn("cwe", F.slice("cwe", 1, 1)).withColumn("weight", F.lit(0.5) + F.length("id")).cache()
    got = linear.sums(rows, model)

    def loss(m):
        out = linear.sums(rows, m)["loss"]
        return out.sum()

    for place, head in ((int(np.abs(got["gradient"][:-1, 0]).argmax()), 0), (64, 0), (64, 1)):
        up, down = model.weights.copy(), model.weights.copy()
        up[place, head] += 1e-4
        down[place, head] -= 1e-4
        assert got["gradient"][place, head] == pytest.approx((loss(linear.Linear(up, model.heads)) - loss(linear.Linear(down, model.heads))) / 2e-4, rel=1e-3, abs=1e-5)
    assert got["tokens"] == rows.agg(F.sum(F.size("input_ids"))).first()[0]
    rows.unpersist()


def test_batched_scores_equal_the_model(spark, caches):
    rng = np.random.default_rng(2)
    model = linear.Linear(rng.normal(size=((1 << 8) + 1, 65)), linear.heads_of(True))
    rows = caches[1].select("id", "input_ids").collect()
    got = {r.id: r.f for r in caches[1].select("id", linear.scorer(spark, model, 128, 7)(F.col("input_ids")).alias("f")).collect()}
    for r in rows:
        assert np.allclose(got[r.id], model.logits(np.array([r.input_ids]))[0], atol=1e-9)
    logit = {r.id: r.logit for r in linear.scored(caches[1], model, 128).collect()}
    assert all(math.isclose(logit[k], f[0], abs_tol=1e-12) for k, f in got.items())


def test_reports_of_a_trained_model(spark, tmp_path, caches):
    """evaluate and predict take one model's scores."""
    steps.train_steps(*caches, str(tmp_path / "a"), replace(SETTINGS, max_steps=12))
    model, about = steps.load(spark, str(tmp_path / "a"))
    report = evaluate.evaluate(linear.scored(caches[1], model, 128), about, caches[3] | {"purpose": "test"})
    assert report["metrics"]["auroc"] > 0.9
    code = spark.createDataFrame([("bad", "int f1(){gets(b);}", "c"), ("good", "int f1(){fgets(b, n);}", "c"), ("long", "x" * 500, "c")], "id string, code string, language string")
    got = {r.id: r for r in evaluate.predict(code, linear.for_reports(model, 128), about, tokens.Bytes()).collect()}
    assert got["bad"].risk_score > got["good"].risk_score and got["long"].status == "insufficient_context"
    assert [w.cwe for w in got["bad"].weakness_candidates] == ["CWE-125"] and got["bad"].evidence_candidates == []


def test_doctor(spark):
    got = steps.doctor(spark, steps=3, records=20)
    assert got["rows"] == 20 and got["logit_error_after_loading"] == 0 and got["losses"][2] < got["losses"][0] and got["tokens_a_second"] > 0
    with pytest.raises(ValueError):
        steps.doctor(spark, length=60)
