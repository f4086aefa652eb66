"""Findings of round 3: odd rows, batches and plans that failed before."""

import math

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import encode


def test_span_means_of_odd_vectors(spark):
    """Null vectors, other lengths, null components and NaN count where they are and nowhere else."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, [1.0, 2.0]), (1, 1, None), (1, 2, [3.0, 4.0]), (2, 0, [1.0, 2.0]), (2, 1, [5.0]), (2, 2, [3.0, 4.0, 7.0]), (3, 0, [nan, inf]), (3, 1, [1.0, 1.0]), (3, 2, [3.0, 4.0]),
        (4, 0, [None, 2.0]), (4, 1, [None, -inf]), (5, 0, None), (5, 1, None),
    ]
    vectors = spark.createDataFrame(rows, "rec long, t long, vec array<float>")
    spans = spark.createDataFrame([(r, s, a, b) for r in range(1, 6) for s, a, b in ((0, 0, 2), (1, 1, 7))], "rec long, span int, lo int, hi int")
    got = {(r["rec"], r["span"]): r["mean"] for r in encode.span_means(vectors, spans).collect()}
    assert math.isnan(got[3, 0][0]) and got[3, 0][1] == inf
    del got[3, 0]
    assert got == {(1, 0): [1.0, 2.0], (1, 1): [3.0, 4.0], (2, 0): [3.0, 2.0], (2, 1): [4.0, 4.0, 7.0], (3, 1): [2.0, 2.5], (4, 0): [None, -inf], (4, 1): [None, -inf]}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_graph_steps_stay_by_record(spark):
    """Edges, tokens and nodes are moved once, while narrow."""
    from sparkloom.plans import catalogue

    assert plan_of(catalogue.QUERIES["edge_remap"](spark, "/root/testdata/sf0.001")).count("Exchange hashpartitioning") <= 6


def test_fixes_are_identified_before_methods_multiply(spark):
    from sparkloom.plans import catalogue

    plan = plan_of(catalogue.QUERIES["patch_candidates_join"](spark, "/root/testdata/sf0.001"))
    assert "regexp_replace" not in plan.split("Join", 1)[0] and "REPARTITION_BY_NUM" in plan


def test_tokens_are_held_in_ranges(spark):
    """A batch's tokens are made in ranges of texts, with the library's ids and offsets."""
    import numpy as np
    import public_tokenizers

    from sparkloom.operators import tokens

    assert list(tokens._ranges(np.array([tokens.HELD, 1, 2, 3 * tokens.HELD, 5]))) == [(0, 1), (1, 3), (3, 4), (4, 5)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", "int café;", None, "ab " * 300_000, "z"]
    got = tokens.Library(path, []).tokens(spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1), {"t": F.col("text")}).orderBy("i").collect()
    for text, row in zip(texts, got):
        own = tokens._tokenizer(path).encode(text or "", add_special_tokens=False)
        assert row["t"]["ids"] == own.ids and [(o["start"], o["end"]) for o in row["t"]["offsets"]] == own.offsets


def test_texts_do_not_meet_labels(spark):
    """Fingerprints are made before documents meet their labels, so texts are not joined."""
    from sparkloom.plans import catalogue

    plan = plan_of(catalogue.QUERIES["dedup_best"](spark, "/root/testdata/sf0.001"))
    assert "sha2" not in plan.split("Join", 1)[0]


@pytest.mark.parametrize("name", ["lexeme_spans", "evidence_roles_interval", "cwe_targets", "clang_graph"])
def test_parts_are_dealt_to_all_cores(spark, name):
    """A small file whose rows give many is not left to the few tasks of its scan."""
    from sparkloom.plans import catalogue

    assert "REPARTITION_BY_NUM" in plan_of(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_byte_tokens_of_any_text(spark):
    from sparkloom.functions.text import byte_ids
    from sparkloom.operators.tokens import byte_offsets

    for text in ("", "ab\0\n", "é測😀", None):
        ids, offsets = spark.createDataFrame([(text,)], "t string").select(byte_ids(F.col("t")), byte_offsets(F.col("t"))).first()
        assert ids == (None if text is None else [b + 16 for b in text.encode()])
        assert offsets == (None if text is None else [(i, i + 1) for i, c in enumerate(text) for _ in c.encode()])


def test_near_copies_leave_no_tables_behind(spark):
    from sparkloom.llm import prefix_tree_join
    from sparkloom.operators import storage

    before = set(storage._made)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, "another text of its own")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in prefix_tree_join.one_of_each_group(docs).collect()) == [1, 3]
    assert not [p for p in set(storage._made) - before if "/tree-paths-" in p or "/tree-sets-" in p or "/shingle-sets-" in p]


def test_merges_that_are_met_again_stay(monkeypatch):
    """A full cache doesn't forget what is in use."""
    from sparkloom.llm import bpe

    merges, made = bpe.Merges({bytes([i]): i for i in range(256)}, most=8), []
    own = merges.merge
    monkeypatch.setattr(merges, "merge", lambda piece: made.append(piece) or own(piece))
    for i in range(40):
        assert merges["xy"] == (b"\x78\0\0\0\x79\0\0\0", b"\1\0\1\0") and merges[f"{i:02}"][1] == b"\1\0\1\0"
        assert len(merges) + len(merges.older) <= 8
    assert made.count(b"xy") == 1


def test_steps_together_equal_steps_alone(spark, tmp_path):
    """one job for the steps between checkpoints, over ends of parts and epochs, with the weights of one aggregation a step; a model's logits don't depend on padding."""
    import numpy as np

    from sparkloom.operators import linear, steps

    rows = spark.range(700).selectExpr(
        "cast(id AS string) AS id", "cast(id AS string) AS group_id", "transform(sequence(0, cast(id * 37 % 90 AS int)), x -> cast(5 + (x * id) % 200 AS int)) AS input_ids", "cast(id % 3 - 1 AS int) AS label",
        "cast(array() AS array<float>) AS cwe", "1.0D + id % 4 AS weight", "-1 AS adequate", "cast(array() AS array<float>) AS family", "cast(array() AS array<array<float>>) AS roles",
    ).cache()
    about = lambda purpose: {"purpose": purpose, "stage": "sft", "tokenizer_sha256": "t", "data": purpose, "max_length": 128, "vocab_size": 300}
    settings = steps.Settings(bits=8, batch_size=32, accumulation=8, warmup=2, max_steps=7, evaluate_every=1 << 30, validation_rows=50)
    got, jobs = {}, []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(steps, "PART_ROWS", 32 * 17)
        together = steps.advance_together
        patch.setattr(steps, "advance_together", lambda rows, tasks, first, count, *a: jobs.append((tasks, count)) or together(rows, tasks, first, count, *a))
        for name, exchanged in (("together", steps.EXCHANGED), ("alone", 0)):
            patch.setattr(steps, "EXCHANGED", exchanged)
            got[name] = steps.train_steps(rows, rows, about("train"), about("validation"), str(tmp_path / name), settings)
    assert jobs and all(tasks > 1 and count > 1 for tasks, count in jobs) and sum(count for _, count in jobs) < 7
    assert got["together"] == got["alone"] and got["alone"]["step"] == 7
    events = [sorted((repr(e) for e in steps_events(spark, tmp_path / n)), key=str) for n in got]
    assert events[0] == events[1]
    model, ids = linear.Linear(np.random.default_rng(0).normal(size=(257, 1)), ["risk"]), np.arange(5, 305)[None]
    assert (model.logits(ids) == model.logits(np.pad(ids, ((0, 0), (0, 777)), constant_values=linear.PAD))).all()
    rows.unpersist()


def steps_events(spark, run):
    from sparkloom.sources import files

    return files.read_events(spark, f"{run}/events")


def test_an_epoch_has_the_short_batches_of_all_shards(spark):
    """of several shards each has a last batch of its own, and an epoch's steps count them."""
    from sparkloom.operators import batch

    df = spark.range(1000).selectExpr("cast(id AS string) AS id", "cast(id % 7 AS int) AS length")
    own = batch.epoch_batches(df, "length", 16, 17, 1, shard_rows=150).agg(F.max("batch")).first()[0] + 1
    assert own == batch.epoch_length(df, 16, 17, 1, shard_rows=150) > -(-1000 // 16)
