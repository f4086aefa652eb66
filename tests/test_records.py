"""Adapters, checks, splits and audits on literal rows."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import record, split
from sparkloom.operators.components import connected_components
from sparkloom.plans import catalogue
from sparkloom.sources import adapters, files


def test_adapters(spark):
    m = spark.createDataFrame([("true", "old", "new", "Own/R", "h", "CVE-2020-1", ["CWE-9"]), ("false", None, "ok", "Own/R", "h", None, ["CWE-9"])], "is_vul string, func_before string, func string, repo_name string, commit_hash string, cve_id string, cwe_ids array<string>")
    got = adapters.megavul(m).select("code", "label", "cwes", "fixed_for_incident", "group_id").collect()
    assert [tuple(r) for r in got] == [("old", 1, ["CWE-9"], None, "CVE-2020-1"), ("new", None, [], "CVE-2020-1", "CVE-2020-1"), ("ok", 0, [], None, "github.com/own/r@h")]
    bad = spark.createDataFrame([("true", None, "new", "o/r")], "is_vul string, func_before string, func string, repo_name string")
    with pytest.raises(Exception, match="no earlier function"):
        adapters.megavul(bad).collect()
    p = spark.createDataFrame([("int f;", "0", "own/p", "CWE-1")], "func string, target string, project string, cwe string")
    r = adapters.primevul(p).first()
    assert (r.label, r.cwes, r.group_id, r.repo) == (0, [], "github.com/own/p", "github.com/own/p")
    s = spark.createDataFrame([("int f;", True, "own/p", None, ["CVE-2020-2", "CVE-2020-10"], ["CWE-3"], 7)], "func_body string, is_vulnerable boolean, project_url string, commit_id string, cve_list array<string>, cwe_list array<string>, idx int")
    r = adapters.secvuleval(s).first()
    assert (r.id, r.group_id, r.incident, r.cwes, r.label) == ("SecVulEval:7", "CVE-2020-10+CVE-2020-2", "CVE-2020-10", ["CWE-3"], 1)
    with pytest.raises(ValueError, match="fetched first"):
        adapters.code(spark.createDataFrame([("x",)], "blob_id string"))
    with pytest.raises(ValueError, match="SELECT"):
        adapters.patch_candidates(spark, "DELETE FROM x")


def test_checks(spark):
    rows = [("a", "g", "int x;", 1, 1.0), ("b", "", " ", 2, -1.0), (None, "g", "int y;", None, None)]
    df = spark.createDataFrame(rows, "id string, group_id string, code string, label int, weight double")
    got = {r.code: r.violations for r in record.validated(df, strict=False).select("code", "violations").collect()}
    assert got == {"int x;": [], " ": ["code", "group_id", "label", "weight"], "int y;": []}
    with pytest.raises(Exception, match="group_id"):
        record.validated(df).collect()
    kept = record.validated(df.where("label is null")).first()
    assert kept.weight == 1.0 and len(kept.id) == 64 and kept.target_span.end == 6


def corpus(spark, rows):
    df = spark.createDataFrame(rows, "ordinal int, id string, group_id string, repo string, code string, label int, split string")
    return df.withColumns({"incident": F.lit(None).cast("string"), "incidents": F.lit(None).cast("array<string>")})


def test_contradictions_are_set_aside_and_copies_dropped(spark):
    rows = [(1, "a", "g1", "o/r1", "int x;", 0, None), (2, "b", "g2", "o/r2", "int  x; // c", 1, None), (3, "c", "g3", "o/r3", "int y;", None, None), (4, "d", "g4", "o/r3", "int y ;", 1, None)]
    got = {r.id: r.split for r in split.split_corpus(corpus(spark, rows)).collect()}
    assert got["a"] == got["b"] == "quarantine" and set(got) == {"a", "b", "d"}


def test_given_splits(spark):
    rows = [(1, "a", "g", "o/r", "int x;", 0, "test"), (2, "b", "g", "o/r", "int z;", 1, None)]
    assert {r.split for r in split.split_corpus(corpus(spark, rows), respect_splits=True).collect()} == {"test"}
    with pytest.raises(Exception, match="overlap"):
        split.split_corpus(corpus(spark, [*rows, (3, "c", "g", "o/r", "int w;", 1, "train")]), respect_splits=True).collect()


def test_audit(spark):
    rows = [(1, "a", "g", "o/r1", "int x;", 0, "train"), (2, "b", "g", "o/r2", "int z;", 1, "test")]
    with pytest.raises(ValueError, match="leak"):
        split.audit(corpus(spark, rows))
    split.audit(corpus(spark, rows[:1]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (50, 51), (51, 50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}, 50: 50, 51: 50}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    (tmp_path / "b.json").write_text('[{"x": 1}, {"x": 3}]')
    (tmp_path / "c.cpp").write_text("int x;\n")
    assert files.read_records(spark, str(tmp_path / "a.jsonl")).count() == 2
    assert files.read_records(spark, str(tmp_path / "b.json"), array=True).count() == 2
    assert files.read_code_file(spark, str(tmp_path / "c.cpp")).first().language == "c++"
    (tmp_path / "bad.jsonl").write_text("{x\n")
    with pytest.raises(Exception):
        files.read_records(spark, str(tmp_path / "bad.jsonl")).collect()
    path = str(tmp_path / "t")
    files.write_table(spark.range(5), path, purpose="train")
    assert files.read_table_checked(spark, path).count() == 5
    spark.range(6).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="differs"):
        files.read_table_checked(spark, path)


def test_every_document_is_validated(spark, tmp_path):
    def tables(name, texts):
        at = str(tmp_path / name)
        spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        return at

    got = catalogue.scan_validate(spark, tables("good", ["a", "bb", "ccc", "dddd"])).collect()
    assert sorted((r.id, r.label, r.target_end) for r in got) == [("0", None, 1), ("1", 1, 2), ("2", None, 3), ("3", None, 4)]
    with pytest.raises(Exception, match="3: code"):
        catalogue.scan_validate(spark, tables("bad", ["a", "bb", "ccc", " "])).collect()
