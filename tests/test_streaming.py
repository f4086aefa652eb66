"""The record stream, syntax graphs and reports."""

import json

from pyspark.sql import functions as F

from sparkloom.operators import report
from sparkloom.streaming import ingest


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"id": "a", "group_id": "g", "code": "int x;", "label": 1}, {"id": "b", "group_id": "g", "code": "int  x; // c", "label": 1}, {"id": "c", "group_id": "", "code": "int y;"}, {"id": "d", "group_id": "g", "code": "int z;"}]
    (tmp_path / "in/1.json").write_text("\n".join(map(json.dumps, rows)))
    schema = spark.createDataFrame([], "id string, group_id string, code string, label int").schema
    stream = ingest.checked(ingest.incoming(spark, str(tmp_path / "in"), schema))
    ingest.append_to(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_evidence_report(spark):
    df = spark.createDataFrame([("a", "x\ny\nz", [(0, 1, "use", 0.2), (4, 5, "guard", 0.9), (2, 3, "use", 0.9)])], "id string, code string, evidence array<struct<start:int,end:int,role:string,score:double>>")
    got = [(r.rank, r.role, r.line) for r in report.top_evidence(df, 2).orderBy(F.col("rank")).collect()]
    assert got == [(1, "guard", 3), (2, "use", 2)]
    assert report.runtime(spark)["spark"]
