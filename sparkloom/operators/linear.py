"""A linear model with several heads on hashed tokens and token pairs, its gradients as aggregations, and its scores as a batched function.

Sums over rows are made of whole numbers (fractions of 2**-FRACTION), so that they don't depend on how rows are dealt to tasks: the same rows give the same weights, bit by bit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sparkloom.operators.encode import FIRST_MASKABLE, PAD
from sparkloom.operators.metrics import LOSS_WEIGHTS
from sparkloom.operators.record import WEAKNESSES

FRACTION = 36
#: rows whose features are held at a time
CHUNK = 64
#: sums that are no gradients, by their place
WEIGHT, LOSS, TOKENS, BROKEN = -1, -2, -3, -4
#: a row's weights and losses are below, or count as not finite
MOST = 1e6


def heads_of(weaknesses: bool) -> list[str]:
    return ["risk", *(f"cwe:{n}" for n in WEAKNESSES)] if weaknesses else ["risk"]


def targets(heads: list[str]) -> Column:
    """A row's target for each head: 1, 0 or -1 (unknown)."""
    risk = F.array(F.coalesce(F.col("label"), F.lit(-1)).cast("double"))
    return risk if heads == ["risk"] else F.concat(risk, F.transform("cwe", lambda x: x.cast("double")))


def head_weights(heads: list[str]) -> np.ndarray:
    """Weights of the heads' mean losses in the joint loss."""
    return np.array([LOSS_WEIGHTS["risk"], *[LOSS_WEIGHTS["cwe"] / max(1, len(heads) - 1)] * (len(heads) - 1)])


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of ids as rows of one length, filled up with PAD."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.full((len(column), max(1, int(lengths.max(initial=0)))), PAD, np.int64)
    out[np.arange(out.shape[1])[None] < lengths[:, None]] = column.flatten().to_numpy()
    return out


@dataclass
class Linear:
    """Weights of 2**bits features, and of the bias after them, for each head."""

    weights: np.ndarray
    heads: list[str]

    @classmethod
    def zero(cls, bits: int, heads: list[str]) -> Linear:
        return cls(np.zeros(((1 << bits) + 1, len(heads))), heads)

    @property
    def size(self) -> int:
        return len(self.weights) - 1

    def digest(self) -> str:
        return hashlib.sha256(",".join(self.heads).encode() + np.ascontiguousarray(self.weights).tobytes()).hexdigest()

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The feature of each token and of each pair of neighbours (the bias' place where there is none), and which exist."""
        u = ids.astype(np.uint64)
        mixed = np.concatenate((u * np.uint64(0x9E3779B1), u[:, :-1] * np.uint64(0x85EBCA6B) + u[:, 1:] * np.uint64(0xC2B2AE35) + np.uint64(1)), 1)
        mixed = (mixed ^ (mixed >> np.uint64(17))) * np.uint64(0x9E3779B97F4A7C15)
        word = ids >= FIRST_MASKABLE
        exists = np.concatenate((word, word[:, :-1] & word[:, 1:]), 1)
        return np.where(exists, ((mixed >> np.uint64(33)) % np.uint64(self.size)).astype(np.int64), self.size), exists

    def features(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and place of each feature, row by row, and the root of their number by row."""
        place, exists = self.places(ids)
        n = exists.sum(1)
        return np.repeat(np.arange(len(ids)), n), place[exists], np.sqrt(np.maximum(n, 1))

    def summed(self, row: np.ndarray, place: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Logits [row, head] of ``features``, added up one after another, so that they don't depend on how far rows are filled up."""
        own = [np.bincount(row, self.weights[place, h], len(root)) for h in range(len(self.heads))]
        return np.stack(own, 1) / root[:, None] + self.weights[-1]

    def logits(self, ids: np.ndarray) -> np.ndarray:
        """Logits [row, head]: mean weights of a row's features, times the root of their number."""
        out = np.zeros((len(ids), len(self.heads)))
        for i in range(0, len(ids), CHUNK):
            out[i : i + CHUNK] = self.summed(*self.features(ids[i : i + CHUNK]))
        return out


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * float(1 << FRACTION)).astype(np.int64)


def _counted(at: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by place, exactly: upper and lower bits apart, so that none leaves the 53 bits of a float."""
    upper, lower = (np.bincount(at, part.astype(float), size).astype(np.int64) for part in (x >> 20, x & ((1 << 20) - 1)))
    return (upper << 20) + lower


class Tally:
    """Sums of some rows at one model, in whole numbers: gradients (of weighted losses) by place and head, weights and losses by head, tokens, and whether a row was not finite."""

    def __init__(self, shape: tuple[int, int]):
        self.gradient, self.by_head, self.tokens, self.broken = np.zeros(shape, np.int64), np.zeros((2, shape[1]), np.int64), 0, False

    def add(self, model: Linear, rows: pa.RecordBatch) -> None:
        """``rows``: as ``narrow`` has them."""
        targets = np.array(rows.column(1).to_pylist(), float).reshape(rows.num_rows, self.gradient.shape[1])
        weights = rows.column(2).to_numpy(zero_copy_only=False)[:, None] * (targets >= 0)
        for i in range(0, rows.num_rows, CHUNK):
            ids, y, w = matrix(rows.column(0).slice(i, CHUNK)), targets[i : i + CHUNK], weights[i : i + CHUNK]
            row, at, root = model.features(ids)
            f = model.summed(row, at, root)
            loss = np.maximum(f, 0) - f * y + np.log1p(np.exp(-np.abs(f)))
            if not ((w * (1 + np.abs(f) + loss)) < MOST).all():  # NaN fails too
                self.broken = True
                return
            self.by_head += np.stack((_whole(w).sum(0), _whole(np.where(w > 0, w * loss, 0.0)).sum(0)))
            self.tokens += int((ids != PAD).sum())
            g = w * (1 / (1 + np.exp(-f)) - y)
            each = _whole(g / root[:, None])
            for h in np.flatnonzero(each.any(0)):
                self.gradient[:, h] += _counted(at, each[row, h], len(self.gradient))
            self.gradient[-1] += _whole(g).sum(0)

    def numbers(self) -> np.ndarray:
        """All sums in a row; such rows can be added up."""
        return np.concatenate(([self.broken, self.tokens], self.by_head.ravel(), self.gradient.ravel())).astype(np.int64)

    @classmethod
    def of(cls, x: np.ndarray, shape: tuple[int, int]) -> Tally:
        out = cls(shape)
        out.broken, out.tokens, out.by_head, out.gradient = bool(x[0]), int(x[1]), x[2 : 2 + 2 * shape[1]].reshape(2, -1), x[2 + 2 * shape[1] :].reshape(shape)
        return out

    def sums(self) -> dict[str, np.ndarray]:
        out = {"gradient": self.gradient / float(1 << FRACTION), "weight": self.by_head[0] / float(1 << FRACTION), "loss": self.by_head[1] / float(1 << FRACTION), "tokens": self.tokens}
        return {k: x * float("nan") for k, x in out.items()} if self.broken else out


def narrow(rows: DataFrame, heads: list[str], *more: str) -> DataFrame:
    """What a gradient needs of rows: ids, targets by head, weight."""
    return rows.select("input_ids", targets(heads).alias("y"), F.coalesce("weight", F.lit(1.0)).cast("double").alias("w"), *more)


def sums(rows: DataFrame, model: Linear) -> dict[str, np.ndarray]:
    """gradient (of the sums of weighted losses), weight and loss by head, and tokens, of ``rows`` (input_ids, label, cwe, weight).

    Each task adds up its own rows and returns its features' sums, which are added up by feature; what reaches the driver has the size of the model at most.
    All are NaN if a row's weight, logit or loss is not finite, or their product beyond ``MOST``.
    """
    shape = model.weights.shape
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a model of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = shared.value, Tally(shape)
        for batch in batches:
            total.add(own, batch)
            if total.broken:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (BROKEN, 0, 1)], names=["place", "head", "s"])
                return
        at, head = np.nonzero(total.gradient)
        h = np.arange(shape[1])
        columns = (np.concatenate((at, np.full(len(h), WEIGHT), np.full(len(h), LOSS), [TOKENS])), np.concatenate((head, h, h, [0])), np.concatenate((total.gradient[at, head], *total.by_head, [total.tokens])))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["place", "head", "s"])

    got = narrow(rows, model.heads).mapInArrow(run, "place long, head long, s long").groupBy("place", "head").agg(F.sum("s").alias("s")).toPandas()
    place, head, s = (got[c].to_numpy() for c in ("place", "head", "s"))
    out = Tally(shape)
    out.broken, out.tokens = bool((place == BROKEN).any()), int(s[place == TOKENS].sum())
    for i, where in enumerate((WEIGHT, LOSS)):
        out.by_head[i][head[place == where]] = s[place == where]
    own = place >= 0
    out.gradient[place[own], head[own]] = s[own]
    shared.unpersist()
    return out.sums()


def scorer(spark: SparkSession, model: Linear, length: int, batch: int = 256):
    """A column function from ids (``length`` at most) to logits by head; workers load the broadcast model once and get rows in batches."""
    shared = spark.sparkContext.broadcast(model)  # a model of fixed size

    def make():
        own = shared.value
        return lambda ids: own.logits(ids.astype(np.int64))

    score = predict_batch_udf(make, return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[[length]])
    return lambda ids: score(F.slice(F.concat(ids, F.array_repeat(F.lit(PAD), length)), 1, length))


def scored(rows: DataFrame, model: Linear, length: int) -> DataFrame:
    """id, group_id, label, weight and logit (of the risk) of model rows."""
    logits = scorer(rows.sparkSession, model, length)(F.col("input_ids"))
    return rows.select("id", "group_id", "label", "weight", F.get(logits, F.lit(0)).alias("logit"))


def for_reports(model: Linear, length: int):
    """What ``evaluate.predict`` calls: model rows to id, risk, cwe and roles (none)."""

    def score(rows: DataFrame) -> DataFrame:
        out = rows.select("id", scorer(rows.sparkSession, model, length)(F.col("input_ids")).alias("f"))
        return out.select("id", F.get("f", F.lit(0)).alias("risk"), F.slice("f", 2, max(1, len(model.heads) - 1)).alias("cwe"), F.array().cast("array<array<double>>").alias("roles"))

    return score


def save(spark: SparkSession, path: str, model: Linear, *moments: np.ndarray) -> None:
    """Weights and moments as a table of those that aren't all zero."""
    import pandas as pd

    arrays = [model.weights, *moments]
    place, head = np.nonzero(np.any([a != 0 for a in arrays], axis=0))
    table = pd.DataFrame({"place": place, "head": head, **{f"x{i}": a[place, head] for i, a in enumerate(arrays)}})
    spark.createDataFrame(table, "place long, head long, " + ", ".join(f"x{i} double" for i in range(len(arrays)))).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, size: int, heads: list[str]) -> tuple[Linear, list[np.ndarray]]:
    """The model and its moments."""
    table = spark.read.parquet(path).toPandas()  # of the model's size
    arrays = []
    for name in (c for c in table.columns if c.startswith("x")):
        a = np.zeros((size + 1, len(heads)))
        a[table["place"], table["head"]] = table[name]
        arrays.append(a)
    return Linear(arrays[0], heads), arrays[1:]
