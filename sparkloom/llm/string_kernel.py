"""Toxicity by a support vector machine over a subsequence string kernel.

A sentence is a run of segments: words, long words cut into overlapping parts, and runs of single characters joined
("i d i o t").  The kernel of two segments counts their common subsequences of ORDER characters (word ends are characters too), an
occurrence with g characters skipped weighing DECAY**g, g <= GAPS; each segment's feature vector is divided by the
root of its squared occurrence weights.  So an insult with gaps or inserted characters still meets its plain form.

Training takes labelled documents' sentences as bags: the toxic ones hold a toxic segment, as a rule, the others seldom one (labels may be wrong).  Seeds are
words whose beginnings are significantly more common in toxic documents; Nyström landmarks are taken from seeds and from
ordinary words; the machine is fitted on landmark features, rescores the bags, and takes hard segments of clean
bags and best segments of toxic bags into the next round.  A segment that bags of both kinds hold is evidence for both: its trust (``trusted``) follows from how much larger a share of the toxic bags
has it, and weighs its support on the toxic side, the rest on the other; so an insult survives some clean labels, and a common word is never one.  As the kernel is a product of explicit (sparse)
features, the sum over landmarks collapses into one weight per subsequence, kept in a table of 2**TABLE_BITS hashed
entries: scoring a segment costs a table read per occurrence, whatever the number of landmarks.

A document scores by its best segment over the whole text, through a Platt sigmoid.

Bounds: a fit learns from a bounded sample of labelled documents and segments, given by ``Bounds``; all documents are scored by all their segments.

Defined cases: null or empty texts score as having no evidence; null doc_ids are scored, not learnt from, and not held out; repeated rows score alike, and of rows of one doc_id one text (of the least hash) is learnt from; labels that are null or contradict each
other are not learnt from; without both classes among labels every score is 0; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.llm.common import append, batch_of, cut, read_table, remove, small_batches
from sparkloom.llm.learning import fold, learnable, platt, sample_ids, sigmoid, squared_hinge

ORDER, GAPS, DECAY = 4, 2, 0.6
TABLE_BITS = 20
LONGEST = 24
STEP = 12
STEPS_BETWEEN = [d for d in product(range(1, GAPS + 2), repeat=ORDER - 1) if sum(d) - (ORDER - 1) <= GAPS]
_SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
THRESHOLD = 0.5


@lru_cache(None)
def alphabet() -> np.ndarray:
    """Codes 1..63 of code points: 1 word end, 2-27 a-z, 28 digits, 29 other ASCII, the rest folded into 30-63."""
    out = 30 + np.arange(0x110000) % 34
    out[:128] = 29
    out[48:58] = 28
    out[97:123] = np.arange(2, 28)
    out[0] = 1
    return out.astype(np.int32)


def segments(token: str) -> list[str]:
    """The parts of a lower-cased token: edges stripped, long ones cut with overlap; with marks inside, also without these."""
    word = token.strip(_EDGES)
    inner = word if word.isalnum() else "".join(c for c in word if c.isalnum())
    out = []
    for w in (word,) if inner == word else (word, inner):
        out += [w] if len(w) <= LONGEST else [w[i : i + LONGEST] for i in range(0, len(w) - LONGEST + STEP, STEP)]
    return out


def tokens(text: str) -> set[str]:
    """Distinct lower-cased tokens of a text, spelled-out words joined."""
    low = text.lower()
    out = set(low.split())
    for run in _SPELLED.findall(low):
        out.add("".join(run.split()))
    return out


def _matrix(words: list[str]) -> np.ndarray:
    joined = "".join("\0" + w + "\0" for w in words)
    codes = alphabet()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    lengths = np.array([len(w) + 2 for w in words])
    out = np.zeros((len(words), LONGEST + 2), np.int32)
    inside = np.arange(LONGEST + 2)[None, :] < lengths[:, None]
    out[inside] = codes
    return out


def occurrences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Per gap pattern: table entries [word, place], which of them exist, and the weight."""
    c = _matrix(words).astype(np.uint32)
    width = c.shape[1]
    for steps in STEPS_BETWEEN:
        at, n = [0, *np.cumsum(steps)], width - sum(steps)
        code = np.zeros((len(words), n), np.uint32)
        for a in at:
            code = code * np.uint32(64) + c[:, a : a + n]
        exists = c[:, at[-1] : at[-1] + n] > 0
        entry = (code * np.uint32(2654435761)) >> np.uint32(32 - TABLE_BITS)
        yield entry, exists, DECAY ** (sum(steps) - (ORDER - 1))


def norms(words: list[str]) -> np.ndarray:
    lengths = np.array([len(w) + 2 for w in words])
    total = np.zeros(len(words))
    for steps in STEPS_BETWEEN:
        total += np.maximum(0, lengths - sum(steps)) * DECAY ** (2 * (sum(steps) - (ORDER - 1)))
    return np.sqrt(np.maximum(total, 1e-12))


def against(words: list[str], table: np.ndarray, chunk: int = 20_000) -> np.ndarray:
    """Inner product of each word's normed features with a weight table."""
    out = np.zeros(len(words))
    for i in range(0, len(words), chunk):
        part = words[i : i + chunk]
        total = np.zeros(len(part))
        for entry, exists, weight in occurrences(part):
            total += weight * np.where(exists, table[entry], 0).sum(1)
        out[i : i + chunk] = total / norms(part)
    return out


def features(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Entries and values of one word's normed feature vector (entries may repeat)."""
    entries, values = [], []
    for entry, exists, weight in occurrences([word]):
        own = entry[exists]
        entries.append(own)
        values.append(np.full(len(own), weight))
    return np.concatenate(entries), np.concatenate(values) / norms([word])[0]


class Machine:
    """The collapsed decision function: f(segment) = features . table + bias, and its sigmoid."""

    def __init__(self, table: np.ndarray, bias: float, a: float, b: float, empty: float):
        self.table, self.bias, self.a, self.b, self.empty = table.astype(np.float32), bias, a, b, empty

    def of_tokens(self, items: list[str]) -> list[float]:
        parts, owner = [], []
        for i, t in enumerate(items):
            for s in segments(t):
                parts.append(s)
                owner.append(i)
        if not parts:
            return []
        f = against(parts, self.table) + self.bias
        best = np.full(len(items), self.empty)
        np.maximum.at(best, np.array(owner), f)
        return best.tolist()

    def probability(self, f: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * f + self.b)


def _kernel(words: list[str], landmarks: list[str], chunk: int = 150) -> np.ndarray:
    """Kernel values [word, landmark]: only occurrences whose entry some landmark has are followed."""
    rows, columns, values = [], [], []
    for j, mark in enumerate(landmarks):
        e, v = features(mark)
        rows.append(e)
        columns.append(np.full(len(e), j))
        values.append(v)
    entries, place = np.unique(np.concatenate(rows), return_inverse=True)
    dense = np.zeros((len(entries) + 1, len(landmarks)), np.float32)
    np.add.at(dense, (place, np.concatenate(columns)), np.concatenate(values))
    where = np.full(1 << TABLE_BITS, len(entries), np.int32)
    where[entries] = np.arange(len(entries))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for i in range(0, len(words), chunk):
        part = words[i : i + chunk]
        owner, at, weights = [], [], []
        for entry, exists, weight in occurrences(part):
            hit = np.where(exists, where[entry], len(entries))
            r, c = np.nonzero(hit < len(entries))
            owner.append(r)
            at.append(hit[r, c])
            weights.append(np.full(len(r), weight, np.float32))
        owner, at, weights = np.concatenate(owner), np.concatenate(at), np.concatenate(weights)
        if not len(owner):
            continue
        order = np.argsort(owner, kind="stable")
        owner = owner[order]
        head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out[i + owner[head]] = np.add.reduceat(dense[at[order]] * weights[order][:, None], head, axis=0)
        out[i : i + len(part)] /= norms(part)[:, None]
    return out


@dataclass(frozen=True)
class Bounds:
    """What one fit learns from, at most."""

    #: labelled documents (those with the least hashes of their ids)
    toxic: int = 2000
    clean: int = 4000
    #: landmarks of the Nyström approximation, half of them toxic segments
    landmarks: int = 800
    rounds: int = 4
    #: the best-supported toxic segments, and how many of these also with a character inserted
    most_toxic: int = 2500
    varied: int = 60
    #: clean segments: the most common ones, some at random, and in each round so many hard ones besides
    common: int = 1500
    random: int = 2000
    hard: int = 2000


#: a segment of both kinds of bags is learnt as a toxic one from this trust on
TRUST = 0.5


def trusted(toxic: int, clean: int, a: Column | str = "a", b: Column | str = "b") -> Column:
    """0 to 1: how far the bags that hold a segment (``a`` of the toxic ones, ``b`` of the clean ones) speak for it being toxic.

    1 if no clean bag holds it.  Else the shares of toxic and of clean bags that do are compared, two standard errors to the segment's disadvantage: a wrong label or two don't matter to an insult that is
    common among toxic bags, and chance doesn't make one of a rare word.
    """
    a, b = (F.col(x).cast("double") if isinstance(x, str) else x for x in (a, b))
    p = F.greatest(a - 2 * F.sqrt(a), F.lit(0.0)) / max(toxic, 1)
    q = (b + 2 * F.sqrt(b) + 1) / max(clean, 1)
    return F.when(a == 0, 0.0).when(b == 0, 1.0).otherwise(F.greatest((p - q) / (p + q), F.lit(0.0)))


def _with_insertion(word: str, rng: np.random.Generator) -> str:
    at = int(rng.integers(1, len(word)))
    letter = word[at] if rng.random() < 0.3 else chr(97 + int(rng.integers(26)))
    return (word[:at] + letter + word[at:])[:LONGEST]


def bag_of(text: str | None) -> set[str]:
    """The distinct segments of a text."""
    return {s for t in tokens(text or "") for s in segments(t) if s}


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, y, seg: the distinct segments of each text."""
    for batch in batches:
        for doc, text, y in zip(*(c.to_pylist() for c in batch.columns)):
            own = sorted(bag_of(text))
            if own:
                yield batch_of(["doc", "y", "seg"], [pa.array([doc] * len(own), pa.int64()), pa.array([y] * len(own), pa.int32()), pa.array(own, pa.string())])


def vocabulary(bags: DataFrame, toxic: int, clean: int) -> DataFrame:
    """seg, a and b (toxic and clean bags that hold it), trust, and strength: the significance of the segment's best beginning (3 to 8 characters), 0 if it is in no toxic bag.  ``bags``: doc, y, seg."""
    counts, _ = cut(bags.groupBy("seg").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")), "segments")
    lengths = F.when(F.length("seg") >= 3, F.sequence(F.lit(3), F.least(F.length("seg"), F.lit(8))))
    with_beginnings = lambda df: df.withColumn("begin", F.explode(F.transform(lengths, lambda n: F.substring("seg", F.lit(1), n))))
    of_toxic = with_beginnings(counts.where("a > 0").select("seg"))
    begun = with_beginnings(bags).select("doc", "y", "begin").join(of_toxic.select("begin").distinct(), "begin", "left_semi").distinct()
    begun = begun.groupBy("begin").agg(F.sum("y").cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    share = toxic / (toxic + clean)
    z = F.when(F.col("p") > 1, (F.col("p") - share * F.col("n")) / F.sqrt(share * (1 - share) * F.col("n") + 0.5)).otherwise(0.0)
    best = of_toxic.join(begun.select("begin", z.alias("z")), "begin").groupBy("seg").agg(F.max("z").alias("strength"))
    return counts.join(best, "seg", "left").select("seg", "a", "b", trusted(toxic, clean).alias("trust"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


class Machines:
    """Fits machines on chosen segments, one after another."""

    def __init__(self, bounds: Bounds, seed: int):
        self.bounds, self.rng = bounds, np.random.default_rng(seed)

    def fit(self, toxic: dict[str, tuple[int, int, float]], clean: dict[str, int], worst: list[str]) -> tuple[np.ndarray, float]:
        """Table and bias of a machine that tells toxic segments (their support, clean bags and trust) from clean ones (their bags)."""
        bounds, rng = self.bounds, self.rng
        pos = sorted(toxic, key=lambda w: (-toxic[w][0], w))[: bounds.most_toxic]
        doubted = [w for w in pos if toxic[w][1]]  # some clean bags hold them: by the rest of their trust they count there too
        neg = [*sorted(set(clean).difference(doubted)), *doubted]
        half = bounds.landmarks // 2
        marks = list(dict.fromkeys([*pos[: half // 2], *rng.permutation(pos[half // 2 :])[: half // 2].tolist(), *worst[: half // 2], *rng.permutation(neg)[: half // 2].tolist()]))
        plain = [w for w in pos[: bounds.varied] if len(w) >= 4]
        varied = [_with_insertion(w, rng) for w in plain for _ in range(3)]
        words = [*pos, *varied, *neg]
        labels = np.concatenate((np.ones(len(pos) + len(varied)), -np.ones(len(neg))))
        k = _kernel(marks, marks).astype(float)
        values, vectors = np.linalg.eigh((k + k.T) / 2)
        good = values > 1e-5 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        x = np.concatenate((_kernel(words, marks) @ root, np.ones((len(words), 1))), 1)
        weighed = [toxic[w][0] * toxic[w][2] for w in pos] + [0.1 * toxic[w][0] * toxic[w][2] for w in plain for _ in range(3)]
        weighed += [(1 + toxic[w][1]) * (1 - toxic[w][2]) if w in toxic else 1 + clean[w] for w in neg]
        support = np.sqrt(weighed)
        weight = np.where(labels > 0, support / support[labels > 0].sum(), support / support[labels < 0].sum()) * len(words)
        w = squared_hinge(x, labels, weight)
        table, bias = np.zeros(1 << TABLE_BITS), float(w[-1])
        for mark, b in zip(marks, root @ w[:-1]):
            entries, v = features(mark)
            np.add.at(table, entries, b * v)
        return table.astype(np.float32), bias


def train(bags: DataFrame, toxic: int, clean: int, bounds: Bounds = Bounds(), seed: int = 7) -> Machine | None:
    """Fit on the segments of labelled documents, ``toxic`` and ``clean`` of them; None without both classes.  ``bags``: doc, y, seg.

    Counts, significances and scores of segments, and the best of each document, are made where the segments are; the driver gets the chosen segments that ``bounds`` allow, and a number per document.
    """
    if not toxic or not clean:
        return None
    spark = bags.sparkSession
    words, words_path = cut(vocabulary(bags, toxic, clean), "segment-counts")
    ordinary = words.where((F.col("b") > 0) & (F.col("trust") < TRUST))
    common = [(r["seg"], r["b"]) for r in ordinary.orderBy(F.desc("b"), "seg").limit(bounds.common).collect()]
    if not common:
        return None
    clean_words = dict(common) | {r["seg"]: r["b"] for r in ordinary.orderBy(F.xxhash64("seg", F.lit(seed)), "seg").limit(bounds.random).collect()}
    likely = bags.where("y = 1").join(words.where(F.col("trust") >= TRUST).select("seg", "b", "trust", "strength"), "seg")
    top = likely.groupBy("doc").agg(F.max("strength").alias("top"))
    stand = likely.join(top, "doc").where(F.col("strength") >= F.greatest(F.lit(2.0), 0.7 * F.col("top"))).groupBy("seg", "b", "trust").count()
    toxic_words = {r["seg"]: (r["count"], r["b"], r["trust"]) for r in stand.orderBy(F.desc("count"), "seg").limit(bounds.most_toxic).collect()}
    machines, worst, machine = Machines(bounds, seed), [w for w, _ in common], None
    for _ in range(bounds.rounds):
        if not toxic_words:
            break
        table, bias = machines.fit(toxic_words, clean_words, worst)
        scored, path = cut(_scored_segments(words, table, bias), "segment-scores")
        best, best_path = cut(bags.join(scored.select("seg", "f"), "seg").groupBy("doc", "y").agg(F.max("f").alias("best")), "bag-scores")
        least = scored.agg(F.min("f")).first()[0]
        rows = best.orderBy("doc").toPandas()  # a number per document of the sample
        missing = [(1, toxic - int((rows["y"] == 1).sum())), (0, clean - int((rows["y"] == 0).sum()))]  # without segments
        f = np.concatenate((rows["best"].to_numpy(), *[np.full(n, least) for _, n in missing]))
        y = np.concatenate((rows["y"].to_numpy(), *[np.full(n, v) for v, n in missing]))
        a, b = platt(f, np.where(y == 1, 1, -1))
        machine = Machine(table, bias, a, b, float(f[y == 0].min()))
        # next round: hard segments of clean bags, and the best of toxic bags
        usual = scored.where((F.col("b") > 0) & (F.col("trust") < TRUST))
        clean_words |= {r["seg"]: r["b"] for r in usual.where("f > -0.8").orderBy(F.desc("f"), "seg").limit(bounds.hard).collect()}
        loss = F.greatest(F.lit(0.0), 1 + F.col("f")) * F.sqrt("b")
        worst = [r["seg"] for r in usual.orderBy(loss.desc(), "seg").limit(bounds.landmarks // 2).collect()]
        names = list(toxic_words)
        toxic_words = {w: toxic_words[w] for w, x in zip(names, against(names, table) + bias) if x > -0.5}
        good = bags.where("y = 1").join(scored.where((F.col("trust") >= TRUST) & (F.col("f") >= 0)), "seg").join(best.select("doc", "best"), "doc").where("f >= best - 0.3")
        for r in good.select("seg", "f", scored["b"], "trust").distinct().orderBy(F.desc("f"), "seg").limit(bounds.most_toxic).collect():
            toxic_words.setdefault(r["seg"], (1, r["b"], r["trust"]))
        remove(spark, path, best_path)
    remove(spark, words_path)
    return machine


def _scored_segments(words: DataFrame, table: np.ndarray, bias: float) -> DataFrame:
    """``words`` (seg, b, trust) with f, a machine's value of each segment."""
    shared = words.sparkSession.sparkContext.broadcast(table)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = against(batch.column(0).to_pylist(), shared.value) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f)], names=["seg", "b", "trust", "f"])

    return words.select("seg", "b", "trust").mapInArrow(run, "seg string, b long, trust double, f double")


_cache: dict[int, dict[str, float]] = {}


def _scores(shared, most: int = 200_000):
    """A function from a text column to scores; scores of tokens are kept by each worker while there is room, for one machine at a time."""

    def run(column: pa.Array) -> np.ndarray:
        machine: Machine | None = shared.value
        if shared.id not in _cache:
            _cache.clear()
        known = _cache.setdefault(shared.id, {})
        texts = column.to_pylist()
        if machine is None:
            return np.zeros(len(texts))
        best = np.zeros(len(texts))
        for i in range(0, len(texts), 50):
            sets = [tokens(t) if t else set() for t in texts[i : i + 50]]
            if len(known) > most:
                known.clear()
            new = list(set().union(*sets).difference(known))
            known.update(zip(new, machine.of_tokens(new)))
            best[i : i + 50] = [max(map(known.__getitem__, s), default=machine.empty) for s in sets]
        return machine.probability(best)

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bounds: Bounds = Bounds()) -> Machine | None:
    """Learn from labelled documents that are not held out, ``bounds.toxic`` + ``bounds.clean`` of them at most."""
    ids = learnable(labels, label)
    chosen = sample_ids(ids.where("y = 1"), bounds.toxic).union(sample_ids(ids.where("y = 0"), bounds.clean))
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # chosen: toxic + clean rows at most
    rows, path = cut(rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "y"), "labelled")
    n = rows.agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    bags, bags_path = cut(rows.mapInArrow(_bags, "doc long, y int, seg string"), "bags")
    machine = train(bags, n[0], n[1], bounds)
    remove(docs.sparkSession, path, bags_path)
    return machine


def with_score(docs: DataFrame, machine: Machine | None, name: str) -> DataFrame:
    """``docs`` with the score of each row's text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # one table of fixed size
    return append(docs, "text", _scores(_Shared(shared)), name, "double")


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score of each row of ``docs`` (doc_id, text)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_score(own, machine, "score").select("doc_id", "score")


class _Shared:
    """A broadcast with an id that tells caches of different models apart."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id() if broadcast._jbroadcast is not None else 0

    @property
    def value(self):
        return self.broadcast.value

    def __reduce__(self):
        return _restored, (self.broadcast, self.id)


def _restored(broadcast, number: int) -> _Shared:
    out = _Shared.__new__(_Shared)
    out.broadcast, out.id = broadcast, number
    return out


def op8_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
