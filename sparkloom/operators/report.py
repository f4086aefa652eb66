"""Reports on single inputs and on sizes of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.functions.text import byte_ids, line_of
from sparkloom.operators.encode import fits
from sparkloom.operators.metrics import calibrated


def findings(df: DataFrame, length: int, temperature: float | None, bias: float = 0.0, threshold: float = 0.5) -> DataFrame:
    """id, status and probability of records (id, code, logit): insufficient_context where a record is not used whole, uncalibrated without a calibration."""
    whole = fits("__ids", length)
    df = df.withColumn("__ids", byte_ids(F.col("code")))
    if temperature is None:
        return df.select("id", F.when(whole, "uncalibrated_risk_score").otherwise("insufficient_context").alias("status"), F.lit(None).cast("double").alias("probability"))
    out = calibrated(df, temperature, bias, threshold)
    return out.select("id", F.when(whole, F.col("status")).otherwise("insufficient_context").alias("status"), F.when(whole, F.col("probability")).alias("probability"))


def top_evidence(df: DataFrame, most: int = 12) -> DataFrame:
    """id, rank, role, score, line of the strongest spans.  ``df``: id, code, evidence array of (start, end, role, score)."""
    best = F.slice(F.array_sort(F.transform("evidence", lambda e, i: F.struct((-e["score"]).alias("key"), i.alias("i"), e["role"].alias("role"), e["score"].alias("score"), e["start"].alias("start")))), 1, most)
    rows = df.select("id", "code", F.posexplode(best).alias("rank", "e"))
    return rows.select("id", (F.col("rank") + 1).alias("rank"), "e.role", "e.score", line_of(F.col("code"), F.col("e")["start"]).alias("line"))


def runtime(spark: SparkSession) -> dict[str, str]:
    """Versions and the settings that plans depend on."""
    keys = ["spark.master", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes", "spark.sql.session.timeZone", "spark.checkpoint.dir"]
    return {"spark": spark.version, **{k: str(spark.conf.get(k, None)) for k in keys}}


def weight_decay_applies(name: Column, dims: Column) -> Column:
    """Whether a parameter is decayed: matrices, but not embeddings or biases."""
    exempt = F.lit(False)
    for part in ("token.", "kind.", "role.", "language.", "relation.", "bias."):
        exempt = exempt | name.contains(part)
    return (dims >= 2) & ~exempt


def rate_scale(name: Column, heads: float = 1.0) -> Column:
    """Factor of the learning rate of a parameter: heads may have one of their own."""
    return F.when(name.startswith("heads."), F.lit(heads)).otherwise(F.lit(1.0))
