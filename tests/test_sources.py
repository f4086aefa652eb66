"""Line-numbered records, refusal of what JSON has no form for, partitioned database scans, releases read in waves."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import split
from sparkloom.sources import database, files, imports

# ---- JSON lines ----


@pytest.fixture
def small_splits(spark):
    """Files are cut into splits of 200 bytes, several to a task."""
    keys = {"spark.sql.files.maxPartitionBytes": "200", "spark.sql.files.openCostInBytes": "1"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


def lines_of(path, n, start=0):
    """A file with blank lines between; returns (line, id) of its records."""
    text, want = [], []
    for i in range(start, start + n):
        if i % 3 == 0:
            text.append("   " if i % 2 else "")
        text.append(json.dumps({"id": i, "text": "x" * (i % 70) + "é", "more": {"a": [i, 1.5]}}))
        want.append((len(text), i))
    path.write_text("\n".join(text) + "\n")
    return want


def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits):
    (tmp_path / "a").mkdir()
    want = [("one.jsonl", *w) for w in lines_of(tmp_path / "a" / "one.jsonl", 120)] + [("two.jsonl", *w) for w in lines_of(tmp_path / "a" / "two.jsonl", 33, 500)]
    (tmp_path / "a" / "empty.jsonl").write_text("")
    got = files.read_numbered(spark, str(tmp_path / "a"))
    assert got.rdd.getNumPartitions() > 8
    assert sorted((r.ordinal.file.rsplit("/", 1)[1], r.ordinal.line, r.id) for r in got.collect()) == sorted(want)


def test_inputs_keep_their_order(spark, tmp_path):
    for name, start in (("z", 0), ("a", 100)):
        lines_of(tmp_path / f"{name}.jsonl", 20, start)
    got = files.read_numbered(spark, [str(tmp_path / "z.jsonl"), str(tmp_path / "a.jsonl")]).orderBy("ordinal").collect()
    assert [r.id for r in got] == [*range(20), *range(100, 120)]


@pytest.mark.parametrize("bad", ['{"id": 1', "[1]", "7", '{"id": "x"}', "nothing"])
def test_errors_name_file_and_line(spark, tmp_path, bad):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n' + bad + "\n")
    schema = spark.createDataFrame([], "id int").schema
    with pytest.raises(Exception, match=r"x\.jsonl:4: no JSON object"):
        files.read_numbered(spark, str(tmp_path / "x.jsonl"), schema).collect()
    assert files.read_numbered(spark, str(tmp_path / "x.jsonl"), schema).schema.fieldNames() == ["id", "ordinal"]


def test_ordinals_of_other_formats(spark, tmp_path, small_splits):
    lines_of(tmp_path / "x.jsonl", 50)
    rows = split.with_ordinal(spark.read.json(str(tmp_path / "x.jsonl"))).where("id is not null").orderBy("ordinal").collect()
    assert [r.id for r in rows] == list(range(50))


def test_only_finite_numbers_are_written(spark, tmp_path):
    assert files.write_records(spark.createDataFrame([(1, 0.5), (2, None)], "a int, b double"), str(tmp_path / "ok")) == 2
    for i, (value, kind) in enumerate([("double('NaN')", "plain"), ("float('Infinity')", "plain"), ("array(1.0D, double('-Infinity'))", "array"), ("struct(map('k', array(double('NaN'))) AS m)", "deep")]):
        with pytest.raises(Exception, match="not finite"):
            files.write_records(spark.range(3).select("id", F.expr(f"if(id = 2, {value}, null)").alias(kind)), str(tmp_path / f"bad{i}"))


def test_split_from_json(spark, tmp_path):
    record = lambda i, code, label, **more: json.dumps({"id": f"r{i}", "group_id": f"g{i}", "repo": f"o/r{i}", "code": code, "label": label, **more})
    (tmp_path / "b.jsonl").write_text("\n".join([record(1, "int a;", 1), "", record(2, "int b;", 0), record(3, "int  b ;", 0)]))
    (tmp_path / "a.jsonl").write_text("\n".join([record(4, "int c;", 0), record(5, "int c ;", 1), record(6, "int b;", 0, incident="CVE-2020-1")]))
    told = split.split_files([str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")], str(tmp_path / "out"))
    assert told["source_rows"] == 6 and told["conflicting_labels_quarantined"] == 2 and told["lexical_duplicates_removed"] == 2 and told["seed"] == 17
    assert [x.rsplit("/", 1)[1] for x in told["inputs"]] == ["b.jsonl", "a.jsonl"] and files.read_document(spark, str(tmp_path / "out.manifest")) == told
    kept = {r.id for r in spark.read.parquet(str(tmp_path / "out")).where("split != 'quarantine'").collect()}
    assert kept == {"r1", "r2"}  # the first of equals: by input, then by line
    with pytest.raises(Exception, match="exist"):
        split.split_files([str(tmp_path / "b.jsonl")], str(tmp_path / "out"))


# ---- databases ----


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as con:
        con.execute("create table t (k integer primary key, code text, x real)")
        con.execute("create table u (k int, repo text, n int)")
        con.executemany("insert into t values (?, ?, ?)", [(i * 7 - 50, f"int x{i}; -- é", i / 3 if i % 4 else None) for i in range(1000)])
        con.executemany("insert into u values (?, ?, ?)", [(i * 7 - 50 if i % 9 else None, f"o/r{i % 5}", i if i % 9 else None) for i in range(1000)])
    return path


def test_database_scans_in_ranges(spark, db):
    query = "SELECT t.k AS k, code, x, repo FROM t JOIN u ON t.k = u.k WHERE t.k % 2 = 0;"
    want = sorted(sqlite3.connect(db).execute(query).fetchall(), key=repr)
    for key, parts, tasks in (("k", 6, 7), (None, None, 1), ("k", 40, 41)):
        got = database.read_query(spark, db, query, "k long, code string, x double, repo string", key, parts)
        if tasks:
            assert got.rdd.getNumPartitions() == tasks
        assert sorted((tuple(r) for r in got.collect()), key=repr) == want
        if key and parts == 6:
            sizes = [n for n in got.rdd.glom().map(len).collect() if n]
            assert len(sizes) == 6 and max(sizes) < 2 * len(want) / 6


def test_rows_without_a_key_and_empty_results(spark, db):
    assert database.read_query(spark, db, "select n, repo from u", "n int, repo string", "n", 4).count() == 1000
    assert database.read_query(spark, db, "select n, repo from u where n < 0", "n int, repo string", "n", 4).count() == 0
    assert database.read_query(spark, db, "select n, repo from u where n = 5", "n int, repo string", "n", 4).count() == 1


def test_databases_are_only_read(spark, db):
    with pytest.raises(ValueError, match="SELECT"):
        database.read_query(spark, db, "delete from t", "k long")
    with pytest.raises(ValueError, match="no column"):
        database.read_query(spark, db, "select k from t", "k long", "other")
    with pytest.raises(Exception, match="integer key"):
        database.read_query(spark, db, "select code from t", "code string", "code").collect()
    with pytest.raises(Exception):
        database.read_query(spark, db, "select k from t; delete from t", "k long").collect()
    assert sqlite3.connect(db).execute("select count(*) from t").fetchone() == (1000,)


# ---- releases ----


@pytest.fixture
def release(spark, tmp_path):
    """40 files of 50 rows; two of three rows pass."""
    folder = str(tmp_path / "release")
    rows = spark.range(2000, numPartitions=40).select(
        "id", F.concat(F.lit("int x"), F.col("id"), F.lit(";")).alias("content"), F.lit("o/r").alias("repo_name"), F.array(F.when(F.col("id") % 3 == 0, "GPL").otherwise("MIT")).alias("licenses"), F.lit("C").alias("lang"),
    )
    rows.write.parquet(folder)
    return folder


def plain_scan(limit):
    scanned = emitted = filtered = 0
    out = []
    for i in range(2000):
        scanned += 1
        if i % 3 == 0:
            filtered += 1
            continue
        out.append(f"int x{i};")
        emitted += 1
        if emitted >= limit:
            break
    return out, {"scanned": scanned, "license_filtered": filtered, "language_filtered": 0, "emitted": emitted}


@pytest.mark.parametrize("limit, most_files", [(33, 2), (300, 10), (5000, 40)])
def test_scans_stop_early(spark, tmp_path, release, limit, most_files):
    got = imports.from_release(release, str(tmp_path / "out"), "mirror", revision="r", limit=limit, allowed=["MIT"], terms_acknowledged=True)["stats"]
    want, stats = plain_scan(limit)
    assert got == stats | {"files": 40, "files_read": got["files_read"]} and got["files_read"] <= most_files
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.code for r in rows) == sorted(want) and {r.source_revision for r in rows} == {"r"}


def test_scans_that_find_nothing(spark, tmp_path, release):
    with pytest.raises(ValueError, match="no row"):
        imports.from_release(release, str(tmp_path / "out"), "mirror", revision="r", allowed=["BSD"], terms_acknowledged=True)
    (tmp_path / "there").mkdir()
    with pytest.raises(FileExistsError):
        imports.from_release(release, str(tmp_path / "there"), "mirror", revision="r", allowed=["MIT"], terms_acknowledged=True)
