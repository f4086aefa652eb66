"""Findings of round 4: tables of which larger copies, or odd rows, failed or differed before."""

import glob
import time

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import prefix_tree_join as ptj


def test_documents_that_only_share_a_passage_make_no_family(spark, monkeypatch):
    """Whole sets are dealt out for documents that may link, not for all that buckets tie together."""
    words = lambda seed, n: " ".join(f"w{seed}x{i}" for i in range(n))
    passage = words("p", 100)
    rows = [(i, f"{passage} {words(i, 60)}") for i in range(200)]
    near = words("near", 300)
    rows += [(1000 + i, near + f" end{i}") for i in range(3)]
    dealt = []
    real = ptj.compare_families
    monkeypatch.setattr(ptj, "compare_families", lambda members, *a, **b: dealt.append(members.select("doc_id", "root").collect()) or real(members, *a, **b))
    got = {r["doc_id"]: r["component_id"] for r in ptj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(200)} | {1000 + i: 1000 for i in range(3)}
    assert len(dealt) == 1 and len(dealt[0]) == 0


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(4)
    sets, sizes = [], (1, 2, 7, 60, 64, 65, 130, 1000, 1030)
    for n in sizes:
        base = rng.integers(0, 1 << 63, n, np.uint64)
        for gone in (0, n // 12, n // 6, n // 3):
            sets.append(np.unique(np.concatenate((base[gone:], rng.integers(0, 1 << 63, gone // 2, np.uint64)))))
    every = np.arange(len(sets))
    for percent in (50, 80, 85, 100):
        linked = ptj.tree_join(sets, sets, percent)
        may = np.zeros_like(linked)
        for cells in (1, 10_000):
            for p, q in ptj.possible_links(np.array([len(s) for s in sets]), [ptj.sketch(s) for s in sets], every, every, percent, cells):
                may[p, q] = True
            assert linked.any() and not (linked & ~may).any() and may.sum() < 0.5 * may.size


def test_large_buckets_are_dealt_in_blocks(spark):
    """Ties between all blocks of a bucket, and none between members that cannot link; buckets of the same members are met once."""
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 63, 100, np.uint64) for _ in range(12)]
    sets = {i: np.sort(np.concatenate((base[i % 12][: 98], rng.integers(0, 1 << 63, 2, np.uint64)))) for i in range(60)}
    mixed = spark.createDataFrame([(p, i, 100, i) for p in (7, 8) for i in sets], "path long, doc_id long, n long, root long")
    sketches = spark.createDataFrame([(i, bytearray(ptj.sketch(s).tobytes())) for i, s in sets.items()], "doc_id long, sketch binary")
    for block in (3, 7, 2048):
        ties = ptj.possible_families(mixed, sketches, 85, block).collect()
        assert all(t["a"] % 12 == t["b"] % 12 for t in ties)
        roots = ptj.connected_components(spark.createDataFrame(ties)).collect()
        assert {r["node"]: r["root"] for r in roots} == {i: i % 12 for i in range(60)}


def test_shuffle_files_go_with_the_table_written(spark):
    from sparkloom.operators.storage import cut

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    folder = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: set(glob.glob(f"{folder}/*/shuffle_*"))
    before, own = files(), spark.conf.get(setting)
    made, _ = cut(spark.range(1000).select((F.col("id") % 7).alias("k")).repartition("k").groupBy("k").count(), "shuffled")
    for _ in range(50):  # they are removed in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(setting) == own and made.count() == 7


def differences(spark, folder, name, texts):
    """Rows of a query that its SQL lacks, and the reverse, over documents of these texts."""
    import duckdb

    from sparkloom.plans import catalogue

    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    want = db.execute(catalogue.ORACLE_SQL[name])
    got = catalogue.QUERIES[name](spark, str(folder)).select(*[c[0] for c in want.description])
    want, got = {tuple(r) for r in want.fetchall()}, {tuple(r) for r in got.collect()}
    return want ^ got


#: no text at all, white space of several kinds, and texts around a window's end
ODD = ["int x;", "", " \t\n", None, " ", "a", "😀é", "x" * 510, "", "y" * 511, "z " * 600]


def test_documents_without_text_are_records(spark, tmp_path):
    assert not differences(spark, tmp_path, "scan_validate", [t for t in ODD if not t or t.strip()])


def test_blank_code_breaks_no_other_rule(spark):
    from sparkloom.operators import record

    df = spark.createDataFrame([("a", "g", "", None, None), ("b", "g", None, None, None), ("c", "", " ", None, None), ("d", "g", "", 2, None), ("e", "g", "", None, (0, 1)), ("f", "g", "x", None, (0, 0))], "id string, group_id string, code string, label int, target_span struct<start:int,end:int>")
    broken = lambda **how: {r["id"]: r["violations"] for r in record.validated(df, strict=False, **how).collect()}
    assert broken(blank="any") == {"a": [], "b": [], "c": ["group_id"], "d": ["label"], "e": ["target_span"], "f": ["target_span"]}
    assert broken(blank="empty") == {"a": [], "b": [], "c": ["code", "group_id"], "d": ["label"], "e": ["target_span"], "f": ["target_span"]}
    assert broken() == {"a": ["code", "target_span"], "b": ["code"], "c": ["code", "group_id"], "d": ["code", "label", "target_span"], "e": ["code", "target_span"], "f": ["target_span"]}


def test_cache_of_documents_without_text(spark, tmp_path):
    """Empty texts are rejected and counted, white space is encoded, nulls are counted apart; without ``blank`` they are errors."""
    import pytest

    from sparkloom.operators import cache

    assert not differences(spark, tmp_path / "odd", "cache_manifest", ODD)
    df = spark.createDataFrame([("a", "g", "int x;", 1), ("b", "g", "", 1), ("c", "g", None, None), ("d", "g", None, 0), ("e", "g", " ", None)], "id string, group_id string, code string, label int")
    for stage, want in (("pretrain", (5, 0, 1, 2, 2)), ("sft", (5, 2, 1, 1, 1))):
        stats = cache.prepare(df, str(tmp_path / stage), stage, length=64, blank=True)["stats"]
        assert tuple(stats[k] for k in ("input_records", "rejected_no_supervision", "rejected_overlength_or_empty", "rejected_null", "output_records")) == want
    with pytest.raises(Exception, match="code"):
        cache.prepare(df, str(tmp_path / "strict"), "pretrain", length=64)


def test_bytes_of_no_text_have_no_sum(spark, tmp_path):
    assert not differences(spark, tmp_path, "byte_tokens", ODD)


def test_texts_break_no_rule_by_themselves(spark, tmp_path):
    assert not differences(spark, tmp_path, "validate_violations", ODD * 30)


def test_methods_are_moved_once(spark, monkeypatch):
    """By their file, before they multiply; where fixes are too many to be sent to all executors, the same rows."""
    from sparkloom.plans import catalogue
    from sparkloom.sources import adapters

    few = catalogue.QUERIES["patch_candidates_join"](spark, "/root/testdata/sf0.001")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(adapters, "FEW_FIXES", 3)
    monkeypatch.setattr(adapters.F, "broadcast", None)  # not asked for
    many = catalogue.QUERIES["patch_candidates_join"](spark, "/root/testdata/sf0.001")
    assert few.count() > 0 and few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()
