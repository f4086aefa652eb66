"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Only a session on one machine (``local[...]``) may leave it unset; it then gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: whether Spark removes the shuffle files of a query when it ends
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A place of its own for an intermediate table; ``clean`` removes what is still there."""
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; no result that was not read yet may be needed any more."""
    remove(spark, *list(_made))


def cut(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a table in the shared folder and reread it: ends lineage, survives lost executors.  The write's shuffle files go with its end, not whenever the driver collects garbage."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path), path


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to all cores (by the hash of some columns, or in turn): for small tables whose rows take long or give many, of which a scan makes few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded size, the same for all operators: rows may be long, and a Python worker holds a batch at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by ``cut`` that no pending plan reads any more."""
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        if path in _made:
            _made.remove(path)
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
