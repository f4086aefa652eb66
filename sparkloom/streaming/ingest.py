"""Records dropped as JSON files, checked and made unique as a stream.  Splits stay a batch job: a new record may join components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sparkloom.functions.text import fingerprint
from sparkloom.operators.record import violations


def incoming(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def checked(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Valid records, the first of each fingerprint within ``late`` of arrival; state is dropped after that."""
    columns = set(stream.columns)
    of = lambda name: F.col(name) if name in columns else F.lit(None)
    whole = {"teacher_probability": "double", "weight": "double", "label": "int", "adequate": "int", "group_id": "string", "code": "string"}
    typed = lambda name: of(name).cast(whole[name]) if name in whole else _empty(name)
    valid = stream.where(F.size(violations(typed, paired=False)) == 0)
    return valid.withColumn("fp", fingerprint(F.col("code"))).withColumn("arrived", F.current_timestamp()).withWatermark("arrived", late).dropDuplicatesWithinWatermark(["fp"])


def _empty(name: str):
    from sparkloom.operators.record import CANONICAL

    return F.lit(None).cast(CANONICAL[name].dataType)


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Starts writing what has arrived, then stops."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
