"""A baseline classifier on model rows, with the bookkeeping of a training run: guards, log, checkpoints, pointers, retention."""

from __future__ import annotations

import hashlib

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.operators.encode import FIRST_MASKABLE
from sparkloom.operators.metrics import binary_metrics, mean_loss, supervision
from sparkloom.functions.text import bce, sigmoid
from sparkloom.operators.storage import new_path, remove
from sparkloom.sources.files import append_event, exists, read_document, write_document


def comparable(train: dict, validation: dict, stage: str) -> None:
    """An error unless two caches can train and validate one model."""
    for name, manifest, purpose in (("train", train, "train"), ("validation", validation, "validation")):
        if manifest["purpose"] != purpose:
            raise ValueError(f"the {name} cache was made for {manifest['purpose']}")
        if (manifest["stage"] == "pretrain") != (stage == "pretrain"):
            raise ValueError(f"the {name} cache was made for stage {manifest['stage']}")
    if train["tokenizer_sha256"] != validation["tokenizer_sha256"]:
        raise ValueError("the caches were made with different tokenizers")
    if train["data"] == validation["data"]:
        raise ValueError("the caches hold the same rows")


def _features(rows: DataFrame, size: int) -> DataFrame:
    """Counts of tokens and of their pairs, by hash."""
    words = F.transform(F.filter("input_ids", lambda t: t >= FIRST_MASKABLE), lambda t: t.cast("string"))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return HashingTF(inputCol="__words", outputCol="features", numFeatures=size).transform(rows.withColumn("__words", F.concat(words, pairs))).drop("__words")


def scored(rows: DataFrame, model: LogisticRegressionModel) -> DataFrame:
    """id, group_id, label, weight and logit of model rows."""
    raw = model.transform(_features(rows, model.numFeatures).drop("prediction"))
    return raw.select("id", "group_id", "label", "weight", F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("logit"))


def targets_of(rows: DataFrame) -> DataFrame:
    """head, slot, target of all heads of model rows."""
    one = lambda head, c: rows.select(F.lit(head).alias("head"), F.lit(0).alias("slot"), F.col(c).cast("double").alias("target"))
    many = lambda head, c: rows.select(F.lit(head).alias("head"), F.posexplode(c).alias("slot", "t")).select("head", "slot", F.col("t").cast("double").alias("target"))
    roles = rows.select(F.explode("roles").alias("r")).select(F.lit("roles").alias("head"), F.posexplode("r").alias("slot", "t")).select("head", "slot", F.col("t").cast("double").alias("target"))
    return one("risk", "label").union(one("adequacy", "adequate")).union(many("cwe", "cwe")).union(many("family", "family")).union(roles)


def train(rows: DataFrame, validation: DataFrame, train_manifest: dict, validation_manifest: dict, run: str, stage: str = "sft", size: int = 1 << 16, iterations: int = 50, ridge: float = 1e-3, keep: int = 3) -> dict:
    """Fit, validate and save one more checkpoint of a run; the model's document is returned.

    Each call is one step of the run: the log grows by an event, the checkpoint becomes ``latest``, and ``best`` if its score is higher than any before; older ones go (see ``retention``).
    """
    comparable(train_manifest, validation_manifest, stage)
    spark = rows.sparkSession
    known = rows.where("label >= 0")
    model = LogisticRegression(labelCol="label", weightCol="weight", maxIter=iterations, regParam=ridge).fit(_features(known, size))
    path = new_path(spark, "model")  # a model that was read back leaves its training summary, and with it the session, behind
    model.write().save(path)
    model = LogisticRegressionModel.load(path)
    out = scored(validation, model).withColumn("p", sigmoid(F.col("logit")))
    loss = out.where("label >= 0").agg(F.sum(bce(F.col("logit"), F.col("label").cast("double"))).alias("loss"), F.count(F.lit(1)).alias("n"))
    figures = {**binary_metrics(out), "validation_loss": mean_loss(loss).first()["validation_loss"]}
    seen = rows.agg(F.coalesce(F.sum(F.size("input_ids")), F.lit(0)).alias("n")).first()["n"]
    counts = {}
    for r in supervision(targets_of(rows)).orderBy("head", "slot").collect():  # a row per head and slot
        own = counts.setdefault(r["head"], {"positive": [], "negative": []})
        own["positive"].append(r["positive"])
        own["negative"].append(r["negative"])
    before = pointer(spark, run, "latest")
    step = 1 + (read_document(spark, f"{before}/metadata.json")["step"] if before else 0)
    score = -figures["validation_loss"] if figures["auprc"] is None else figures["auprc"]
    weights = hashlib.sha256(model.coefficients.toArray().tobytes() + repr(model.intercept).encode()).hexdigest()
    about = {
        "format": 1, "stage": stage, "step": step, "seen_tokens": seen, "score": score, "weights_sha256": weights, "tokenizer_sha256": train_manifest["tokenizer_sha256"], "vocab_size": train_manifest["vocab_size"],
        "max_length": train_manifest["max_length"], "train_data": train_manifest["data"], "validation_data": validation_manifest["data"], "supervision": counts, "validation": figures,
    }
    save_checkpoint(spark, run, model, about, keep)
    remove(spark, path)
    append_event(spark, f"{run}/events", {"step": step, "seen_tokens": seen, "validation": figures})
    return about


def pointer(spark: SparkSession, run: str, name: str) -> str | None:
    """The checkpoint that ``latest`` or ``best`` of a run names."""
    path = f"{run}/{name}.json"
    return f"{run}/{read_document(spark, path)['checkpoint']}" if exists(spark, path) else None


def resolve(spark: SparkSession, path: str, prefer: str = "best") -> str:
    """The checkpoint meant by a pointer file, a checkpoint's folder or a run: its preferred pointer, else the latest."""
    if path.endswith(".json") and exists(spark, path):
        return f"{path.rsplit('/', 1)[0]}/{read_document(spark, path)['checkpoint']}"
    if exists(spark, f"{path}/metadata.json"):
        return path
    found = pointer(spark, path, prefer) or pointer(spark, path, "latest")
    if not found:
        raise FileNotFoundError(f"{path} has no checkpoint")
    return found


def load(spark: SparkSession, path: str, prefer: str = "best") -> tuple[LogisticRegressionModel, dict]:
    where = resolve(spark, path, prefer)
    return LogisticRegressionModel.load(f"{where}/model"), read_document(spark, f"{where}/metadata.json")


def save_checkpoint(spark: SparkSession, run: str, model, about: dict, keep: int = 3, better: bool | None = None) -> str:
    """Write a checkpoint (its metadata last, so a broken one is never found), move the pointers and drop old ones; the same step twice is an error.

    ``model``: one of Spark's, or a function that writes to a path.  ``better``: whether it becomes the best one; by default, if its score is higher than the best one's.
    """
    name = f"checkpoints/step_{about['step']:08d}"
    where = f"{run}/{name}"
    if exists(spark, f"{where}/metadata.json"):
        raise FileExistsError(where)
    if callable(model):
        model(f"{where}/model")
    else:
        model.write().overwrite().save(f"{where}/model")
    write_document(spark, f"{where}/metadata.json", about)
    best = pointer(spark, run, "best")
    if better is None:
        better = best is None or about["score"] > read_document(spark, f"{best}/metadata.json")["score"]
    write_document(spark, f"{run}/latest.json", {"checkpoint": name})
    if better:
        write_document(spark, f"{run}/best.json", {"checkpoint": name})
    _retain(spark, run, keep)
    return where


def _retain(spark: SparkSession, run: str, keep: int) -> None:
    """Keep the newest checkpoints and those that pointers name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{run}/checkpoints")
    names = sorted(f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p))
    named = {found.rsplit("/", 1)[1] for x in ("latest", "best") if (found := pointer(spark, run, x))}
    for name in names[: -max(1, keep)]:
        if name not in named:
            remove(spark, f"{run}/checkpoints/{name}")
