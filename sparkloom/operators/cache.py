"""Caches of model rows: checked input, counters, and a manifest that later steps are held to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.operators.encode import encode, supervised
from sparkloom.operators.record import validated
from sparkloom.operators.split import PARTITIONS
from sparkloom.operators.storage import remove
from sparkloom.operators.tokens import Bytes
from sparkloom.sources.files import content_hash, read_document, read_table_checked, write_document

STAGES = ("pretrain", "sft", "align", "security")


def purpose_violations(records: DataFrame, purpose: str) -> DataFrame:
    """Records of another partition than the purpose."""
    return records.where(F.col("split").isNotNull() & (F.col("split") != "") & (F.col("split") != purpose))


def admitted(records: DataFrame, stage: str) -> DataFrame:
    """Records with supervision of any kind; all of them for pretraining."""
    return records if stage == "pretrain" else records.where(supervised(records.columns))


def cache_counters(encoded: DataFrame) -> DataFrame:
    """output_records, tokens (without mates), labeled_records, graph_records and paired_records of model rows."""
    paired = F.col("mate").isNotNull() if "mate" in encoded.columns else F.lit(False)
    return encoded.agg(
        F.count(F.lit(1)).alias("output_records"), F.coalesce(F.sum(F.size("input_ids")), F.lit(0)).alias("tokens"), F.count_if(F.col("label") >= 0).alias("labeled_records"),
        F.count_if(F.col("graph").isNotNull()).alias("graph_records"), F.count_if(paired).alias("paired_records"), F.count_if(F.col("window_start") == 0).alias("records"),
    )


def prepare(records: DataFrame, path: str, stage: str, tokenizer=None, length: int = 512, most_nodes: int = 256, most_neighbours: int = 16, purpose: str | None = None, blank: bool = False) -> dict:
    """Check, filter and encode records, and write them with a manifest, which is returned.  An existing target, or nothing that fits, is an error.

    Counters: input_records, rejected_no_supervision, rejected_overlength_or_empty, output_records, tokens, labeled_records, graph_records, paired_records.
    ``blank``: records without code are no error; empty ones are rejected, white space is encoded, and those whose code is null are counted as rejected_null.
    """
    spark, tokenizer = records.sparkSession, tokenizer or Bytes()
    checked = validated(records, blank="any" if blank else "")
    if purpose and not purpose_violations(checked, purpose).isEmpty():
        raise ValueError(f"records of another partition cannot be prepared for {purpose}")
    rows = admitted(checked, stage)
    graphs = F.col("graph").isNotNull() | (F.col("mate")["graph"].isNotNull() if "mate" in checked.columns else F.lit(False))
    n = checked.agg(F.count(F.lit(1)).alias("all"), F.count_if(supervised(checked.columns)).alias("supervised"), F.count_if(graphs).alias("graphs"), F.count_if(F.col("code").isNull() if stage == "pretrain" else F.col("code").isNull() & supervised(checked.columns)).alias("nulls")).first()
    encoded = encode(rows, length, stage == "pretrain", tokenizer, most_nodes, most_neighbours, n["graphs"] > 0)
    mate = F.coalesce(F.size("mate.input_ids"), F.lit(0)) if "mate" in encoded.columns else F.lit(0)
    encoded = encoded.withColumn("length", F.greatest(F.size("input_ids"), mate))
    encoded.write.mode("errorifexists").parquet(path)
    written = spark.read.schema(encoded.schema).parquet(path)
    counts = cache_counters(written).first().asDict()
    if not counts["output_records"]:
        remove(spark, path)
        raise ValueError("no record fits; nothing is cut short")
    admitted_n = (n["all"] if stage == "pretrain" else n["supervised"]) - n["nulls"]
    other = rows.where(F.col("split").isNotNull() & (F.col("split") != "") & ~F.col("split").isin(*PARTITIONS, "quarantine")).select("id", "split").first()
    if other:
        raise ValueError(f"record {other['id']} is of an unknown partition: {other['split']}")
    splits = sorted(r[0] for r in rows.select("split").where("split is not null and split != ''").distinct().collect())  # known names only
    stats = {"input_records": n["all"], "rejected_no_supervision": n["all"] - admitted_n - n["nulls"], "rejected_overlength_or_empty": admitted_n - counts.pop("records"), **counts}
    stats |= {"rejected_null": n["nulls"]} if blank else {}
    manifest = {
        "format": 1, "stage": stage, "purpose": purpose or (splits[0] if len(splits) == 1 else "unspecified"), "source_splits": splits, "max_length": length, "tokenizer_sha256": tokenizer.sha256,
        "input": content_hash(checked.select("id", F.sha2("code", 256).alias("code"), "label")), "data": content_hash(_hashable(written)), "vocab_size": tokenizer.vocab_size, "random_vocab_size": tokenizer.random_vocab_size,
        "diagnostic_tokenizer": tokenizer.diagnostic, "stats": stats,
    }
    write_document(spark, f"{path}.manifest", manifest)
    return manifest


def _hashable(encoded: DataFrame) -> DataFrame:
    return encoded.select(*sorted(encoded.columns))


def open_cache(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The rows and the manifest of a cache, after the rows were compared with it."""
    manifest = read_document(spark, f"{path}.manifest")
    df = spark.read.parquet(path)
    if content_hash(_hashable(df)) != manifest["data"]:
        raise ValueError(f"{path} differs from its manifest")
    return df, manifest


__all__ = ["admitted", "cache_counters", "open_cache", "prepare", "purpose_violations", "read_table_checked"]
