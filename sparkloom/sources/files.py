"""JSON lines (with their numbers), JSON arrays and code files in; records, partitioned tables and documents out."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

from sparkloom.operators.storage import cut


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None, array: bool = False) -> DataFrame:
    """Records of JSON lines, or of one JSON array; blank lines are skipped, anything malformed is an error."""
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", array)
    return (reader.schema(schema) if schema else reader).json(path)


def read_code_file(spark: SparkSession, path: str) -> DataFrame:
    """One record of a source file; the language follows from its name."""
    text = spark.read.text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return text.select(F.col("value").alias("code"), F.when(name.rlike(r"\.(cpp|cc|cxx)$"), "c++").otherwise("c").alias("language"), name.alias("source_path"))


#: a table with a row for each split of the input files is broadcast up to so many rows, else joined
FEW_SPLITS = 100_000


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of every line of the text files under ``path``, blank ones included.

    Lines are counted in each split of a file; sums over a file's earlier splits give the numbers, so no file is read by one task and no line is moved.  The input must not change between the two passes.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    splits, _ = cut(text.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "lines")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    starts = splits.select("file", "split", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    starts = F.broadcast(starts) if splits.limit(FEW_SPLITS + 1).count() <= FEW_SPLITS else starts
    return text.join(starts, ["file", "split"]).select("file", (F.col("at") + F.col("shift")).alias("line"), "value")


def read_numbered(spark: SparkSession, paths: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """Records of JSON lines with ``ordinal`` (input, file, line): the place of each among all inputs, which come in the order given.

    Blank lines are skipped but counted.  A line that is no JSON object, or does not fit the schema, is an error that names its file and line.
    """
    paths = [paths] if isinstance(paths, str) else paths
    if schema is None:
        schema = spark.read.option("mode", "FAILFAST").json(paths).schema
    bad = "__broken"
    own = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    lines = None
    for i, path in enumerate(paths):
        one = numbered_lines(spark, path).select(F.struct(F.lit(i).alias("input"), "file", "line").alias("ordinal"), "value")
        lines = one if lines is None else lines.union(one)
    record = F.from_json("value", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    df = lines.where(F.trim(F.translate("value", "\t\r\f\x0b", "    ")) != "").withColumn("r", record)
    broken = F.col("r").isNull() | F.col("r")[bad].isNotNull() | ~F.ltrim("value").startswith("{")
    where = F.concat(F.col("ordinal")["file"], F.lit(":"), F.col("ordinal")["line"].cast("string"), F.lit(": no JSON object of the expected form: "), F.substring("value", 1, 200))
    checked = F.when(broken, F.raise_error(where).cast(own)).otherwise(F.col("r"))
    return df.select(checked.alias("r"), "ordinal").select(*[F.col("r")[f.name].alias(f.name) for f in schema.fields], "ordinal")


def _unwritable(value: Column, kind: T.DataType) -> Column | None:
    """Whether a value holds a number that JSON has no form for; None where its type has none."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.isnan(value) | (F.abs(value) == float("inf"))
    if isinstance(kind, T.StructType):
        parts = [x for f in kind.fields if (x := _unwritable(value[f.name], f.dataType)) is not None]
        return None if not parts else reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts])
    if isinstance(kind, T.ArrayType):
        return None if _unwritable(value, kind.elementType) is None else F.exists(value, lambda x: F.coalesce(_unwritable(x, kind.elementType), F.lit(False)))
    if isinstance(kind, T.MapType):
        return _unwritable(F.map_values(value), T.ArrayType(kind.valueType))
    return None


def write_records(df: DataFrame, path: str) -> int:
    """JSON lines; the number of records is returned.  NaN or an infinity anywhere in a record is an error, and so is an existing target."""
    parts = [F.coalesce(x, F.lit(False)) for f in df.schema.fields if (x := _unwritable(F.col(f.name), f.dataType)) is not None]
    if parts:
        message = F.concat(F.lit("a number that is not finite: "), F.to_json(F.struct("*")))
        df = df.where(F.when(reduce(lambda a, b: a | b, parts), F.raise_error(message).cast("boolean")).otherwise(True))
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").json(path)
    return seen.get["n"]


def write_partitions(df: DataFrame, path: str, by: str = "split") -> None:
    """A folder for each partition; an existing target is an error."""
    df.write.mode("errorifexists").partitionBy(by).parquet(path)


def content_hash(df: DataFrame) -> dict[str, int | str]:
    """Number of rows and an order-free hash of them."""
    row = F.xxhash64(*df.columns)
    n, x, s = df.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).first()
    return {"rows": n, "xor": x or 0, "sum": str(s or 0)}


def text_hash(df: DataFrame, column: str) -> DataFrame:
    """rows, xor and sum of the first 60 bits of each text's SHA-256: a hash that other engines can check."""
    bits = F.conv(F.substring(F.sha2(column, 256), 1, 15), 16, 10).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(bits).alias("xor"), F.sum(bits.cast("decimal(38,0)")).cast("string").alias("sum"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_document(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON document, whole or not at all: written beside its place and renamed.  Numbers that are not finite are an error."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False)
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, part = hadoop.Path(path), hadoop.Path(f"{path}.part")
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = system.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if system.exists(target):
        system.delete(target, True)
    if not system.rename(part, target):
        raise OSError(f"{path} could not be written")


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def append_event(spark: SparkSession, path: str, event: dict | list[dict]) -> None:
    """A line, or some, of a log that only grows."""
    lines = [(json.dumps(e, allow_nan=False),) for e in (event if isinstance(event, list) else [event])]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("append").text(path)


def read_events(spark: SparkSession, path: str) -> list[dict]:
    return [json.loads(r[0]) for r in spark.read.text(path).collect()]


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """repo, canonical of a document that maps repository identities."""
    return spark.createDataFrame(sorted(read_document(spark, path).items()), "repo string, canonical string")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def files_hash(spark: SparkSession, path: str) -> str:
    """One hash of all files under a path, whatever their names: of their own hashes in order."""
    return hashlib.sha256("".join(sorted(r["sha256"] for r in file_hashes(spark, path).select("sha256").collect())).encode()).hexdigest()


def write_table(df: DataFrame, path: str, **about) -> dict:
    """A table with a manifest beside it."""
    df.write.mode("errorifexists").parquet(path)
    spark = df.sparkSession
    manifest = {**about, **content_hash(spark.read.parquet(path))}
    if not manifest["rows"]:
        raise ValueError("no rows")
    write_document(spark, f"{path}.manifest", manifest)
    return manifest


def read_table_checked(spark: SparkSession, path: str) -> DataFrame:
    """The table, after its rows were compared with its manifest."""
    manifest = read_document(spark, f"{path}.manifest")
    df = spark.read.parquet(path)
    if content_hash(df) != {k: manifest[k] for k in ("rows", "xor", "sum")}:
        raise ValueError(f"{path} differs from its manifest")
    return df
