"""Quality by positive-unlabelled learning with a non-negative risk.

Features describe the whole text: shares of character classes and of their pairs, word lengths, repetition of words, lines and
neighbours.  Positives are trusted labelled documents.  The unlabelled ones are all other documents that are not held out: labels of bad documents are never read, so these
stay among the unlabelled as they would without labels.

The class prior is the share of positives among all unlabelled documents.  Documents are split in two halves by a hash; a model fitted on a sample of one half tells positives
from unlabelled documents of the other, so every document is scored by a model that it had no part in.  Where only positives score, the unlabelled share above a threshold
divided by the positives' share above it is the prior; the least such ratio over thresholds (with a margin for their sampling errors) is taken.  The unlabelled shares are counted over all
unlabelled documents of the corpus.  An estimate outside LEAST_PRIOR to MOST_PRIOR is set to the nearer of them, and the model says so (``clipped``).

Then a linear model on standardised features minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss; where the second term
becomes negative, its gradient is reversed, as in the non-negative estimator.

Bounds (parameters): models are fitted on at most ``positives`` + ``unlabelled`` documents; the prior is counted on all unlabelled ones, and all documents are scored.

Defined cases: null or empty texts have the features of no characters and are scored like others; repeated rows score alike, and of rows of one doc_id one text (of the least hash) is learnt from;
null doc_ids are scored, not learnt from, and not held out; labels that are null or contradict each other are not learnt from; without positives, or without any other
document, there is no model and every score is 1; an empty table gives an empty table; other columns are never read, but pass through ``with_score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm.common import append, batch_of, read_table, slices_by_bytes, small_batches, text_buffers
from sparkloom.llm.learning import fold, learnable, sample_ids, sigmoid
from sparkloom.llm.words import NON_SPACE, Words

THRESHOLD = 0.3
LEAST_PRIOR, MOST_PRIOR = 0.05, 0.98
#: thresholds at which shares are compared, as quantiles of the positives' scores
LEVELS = np.linspace(0.02, 0.9, 60)

#: character classes: a-z, A-Z, digits, beyond ASCII, blanks, line ends, . and comma, ! and ?, brackets and quotes, the bar, other symbols
CLASSES = 11
_KIND = np.full(256, 10, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[[9, 32]], _KIND[[10, 13]] = 4, 5
_KIND[[44, 46, 58, 59]], _KIND[[33, 63]] = 6, 7
_KIND[[34, 39, 40, 41, 91, 93]], _KIND[124] = 8, 9
N_STATS = 10
N_FEATURES = CLASSES + CLASSES * CLASSES + N_STATS


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of features for each text."""
    n = len(offsets) - 1
    part = data[offsets[0] : offsets[-1]]
    edges = offsets - offsets[0]
    sizes = np.diff(edges)
    owner = np.repeat(np.arange(n), sizes)
    kind = _KIND[part]
    single = np.bincount(owner * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    same = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    pair = (owner[:-1] * CLASSES + kind[:-1]) * CLASSES + kind[1:] if len(owner) else np.zeros(0, np.int64)
    double = np.bincount(pair[same], minlength=n * CLASSES * CLASSES).reshape(n, CLASSES * CLASSES)
    out = np.zeros((n, N_FEATURES), np.float32)
    total = np.maximum(sizes, 1)[:, None]
    out[:, :CLASSES] = np.sqrt(single / total)
    out[:, CLASSES : CLASSES * (CLASSES + 1)] = np.sqrt(double / total)
    words = Words(data, offsets, NON_SPACE)
    h, row, count = words.hashes(), words.row_of_word(), np.maximum(words.counts, 1)
    order = np.lexsort((h, row))
    hs, rs = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    distinct = np.bincount(rs[new], minlength=n)
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, rs[heads], runs)
    again = np.zeros(n)
    if len(h) > 1:
        again = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n)
    length = (words.ends - words.starts).astype(float)
    mean = np.bincount(row, length, minlength=n) / count
    spread = np.sqrt(np.maximum(0, np.bincount(row, length**2, minlength=n) / count - mean**2))
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    expected = np.minimum(1, 2.2 / np.maximum(count, 1) ** 0.2)  # distinct words fall as a text grows
    lines = single[:, 5] + 1
    at = CLASSES * (CLASSES + 1)
    stats = [distinct / count, distinct / count / expected, most / count, again / count, np.log1p(words.counts), mean, spread, np.log1p(longest), np.log1p(words.counts / lines), np.log1p(sizes)]
    for i, x in enumerate(stats):
        out[:, at + i] = x
    return out


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float = 0.5, clipped: bool = False):
        self.mean, self.scale, self.weights, self.prior, self.clipped = mean, scale, weights, prior, clipped

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def _standard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = x.std(0)
    return x.mean(0), np.where(scale > 1e-6, scale, 1.0)


def _adam(gradient, d: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(d), np.zeros(d), np.zeros(d)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _inputs(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the features, and both kinds standardised with a bias."""
    mean, scale = _standard(np.concatenate((positive, unlabelled)))
    one = lambda x: np.concatenate((np.clip((x.astype(float) - mean) / scale, -8, 8), np.ones((len(x), 1))), 1)
    return mean, scale, one(positive), one(unlabelled)


def tell_apart(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """A model that tells positives from unlabelled documents."""
    mean, scale, a, b = _inputs(positive, unlabelled)

    def gradient(w: np.ndarray) -> np.ndarray:
        return b.T @ sigmoid(b @ w) / len(b) - a.T @ sigmoid(-(a @ w)) / len(a) + 0.01 * np.append(w[:-1], 0)

    return Model(mean, scale, _adam(gradient, a.shape[1], 200, 0.05))


def class_prior(positive: np.ndarray, n_positive: int, unlabelled: np.ndarray, n_unlabelled: int) -> tuple[float, bool]:
    """The share of positives among the unlabelled, from the shares of both above each threshold; whether it had to be clipped."""
    error = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(n_positive) + 1 / np.sqrt(n_unlabelled))
    best = int(np.argmin((unlabelled + error) / np.maximum(positive, 1e-9)))
    found = float(unlabelled[best] / max(positive[best], 1e-9))
    prior = float(np.clip(found, LEAST_PRIOR, MOST_PRIOR))
    return prior, prior != found


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, clipped: bool = False, steps: int = 400, strength: float = 3.0) -> Model:
    """Minimise the non-negative risk on feature rows; the fewer positives there are, the more the weights are held back."""
    mean, scale, p, u = _inputs(positive, unlabelled)
    ridge = strength / len(p)

    def risk(w: np.ndarray) -> np.ndarray:
        fp, fu = p @ w, u @ w
        good = -prior * (p.T @ sigmoid(-fp)) / len(p)
        bad = u.T @ sigmoid(fu) / len(u) - prior * (p.T @ sigmoid(fp)) / len(p)
        below = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        return (good + bad if below >= 0 else -bad) + ridge * np.append(w[:-1], 0)

    return Model(mean, scale, _adam(risk, p.shape[1], steps, 0.05), prior, clipped)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(0))
        for a, b in slices_by_bytes(offsets):
            x = features(data, offsets[a : b + 1])
            yield batch_of(["positive", "half", "x"], [*(c.slice(a, b - a) for c in batch.columns[1:]), pa.array([r.tobytes() for r in x], pa.binary())])


def _levels(models: list[Model], cuts: list[np.ndarray]):
    """doc_id and level of each text: how many thresholds of its half its score reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            half = batch.column(2).to_numpy()
            level = np.zeros(batch.num_rows, np.int32)
            for a, b in slices_by_bytes(offsets):
                x = features(data, offsets[a : b + 1])
                for h in (0, 1):
                    own = np.flatnonzero(half[a:b] == h)
                    level[a + own] = np.searchsorted(cuts[h], models[h].margin(x[own]), side="right")
            yield batch_of(["doc_id", "level"], [batch.column(0), level])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", positives: int = 6000, unlabelled: int = 12_000) -> Model | None:
    """Learn from trusted positives and all other documents that are not held out; models are fitted on at most so many of each."""
    spark = docs.sparkSession
    small_batches(spark)
    trusted = learnable(labels, label).where("y = 1").select("doc_id")
    half = (F.xxhash64(F.col("doc_id"), F.lit(7)) % 2 != 0).cast("int").alias("half")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").where(fold() != 0)
    good = sample_ids(own.select("doc_id").join(trusted, "doc_id", "left_semi").distinct(), positives)
    others = sample_ids(own.select("doc_id").join(trusted, "doc_id", "left_anti").distinct(), unlabelled)
    chosen = good.withColumn("positive", F.lit(1)).union(others.withColumn("positive", F.lit(0)))  # at most positives + unlabelled rows
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("positive").alias("positive"), F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "positive", half)
    got = rows.mapInArrow(_features_of, "positive int, half int, x binary").toArrow()
    x = np.array([np.frombuffer(b.as_py(), np.float32) for b in got.column(2)]).reshape(-1, N_FEATURES)
    y, halves = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.lexsort((*x.T[-3:], halves, y))  # the order of arrival is not fixed
    x, y, halves = x[order], y[order], halves[order]
    p, u = x[y == 1], x[y == 0]
    if not len(p) or not len(u):
        return None
    # a half is judged by the model of the other; where one has not both kinds, all are judged by all
    sides = [(p[halves[y == 1] == h], u[halves[y == 0] == h]) for h in (0, 1)]
    if min(len(part) for side in sides for part in side) == 0:
        sides = [(p, u), (p, u)]
    models = [tell_apart(*sides[1 - h]) for h in (0, 1)]
    scores = [models[h].margin(sides[h][0]) for h in (0, 1)]
    cuts = [np.quantile(s, LEVELS) for s in scores]
    above = np.mean([np.concatenate([s >= c[i] for s, c in zip(scores, cuts)]) for i in range(len(LEVELS))], axis=1)
    levels = own.select("doc_id", "text", half).mapInArrow(_levels(models, cuts), "doc_id long, level int")  # ids and levels are shuffled, texts are not
    counted = levels.join(trusted, "doc_id", "left_anti").groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per level
    n = np.zeros(len(LEVELS) + 1)
    for r in counted:
        n[r["level"]] = r["n"]
    shares = (n[::-1].cumsum()[::-1] / n.sum())[1:]
    prior, clipped = class_prior(above, len(p), shares, int(n.sum()))
    return train(p, u, prior, clipped)


def with_score(docs: DataFrame, model: Model | None, name: str) -> DataFrame:
    """``docs`` with the score of each row's text."""
    small_batches(docs.sparkSession)

    def scores(column: pa.Array) -> np.ndarray:
        data, offsets = text_buffers(column)
        out = np.ones(len(column))
        for a, b in slices_by_bytes(offsets) if model is not None else ():
            out[a:b] = model.probability(features(data, offsets[a : b + 1]))
        return out

    return append(docs, "text", scores, name, "double")


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of each row of ``docs`` (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_score(own, model, "score").select("doc_id", "score")


def op2_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from trusted positives and unlabelled documents."""
    docs = read_table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
