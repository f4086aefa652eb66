"""Scores against labels: confusion, ranking, thresholds, losses, calibration, and the bookkeeping of training.

Labels: 1, 0, or unknown (null or -1), which takes no part anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from sparkloom.functions.text import bce, sigmoid, softplus
from sparkloom.operators.storage import cut, remove


def known(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label) >= 0)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def confusion(df: DataFrame, threshold: float = 0.5, label: str = "label", p: str = "p") -> DataFrame:
    """Counts and rates; a rate without cases is null, F1 without cases is 0."""
    y, yes = F.col(label) == 1, F.col(p) >= threshold
    c = known(df, label).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y).alias("positives"), F.count_if(y & yes).alias("tp"), F.count_if(~y & yes).alias("fp"), F.count_if(~y & ~yes).alias("tn"), F.count_if(y & ~yes).alias("fn"),
        F.avg(F.pow(F.col(p) - F.col(label), F.lit(2.0))).alias("brier"),
    )
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    bound = F.when((fp == 0) & (fp + tn > 0), 1 - F.pow(F.lit(0.05), ratio(F.lit(1), fp + tn)))
    return c.select(
        "*", ratio(F.col("positives"), F.col("n")).alias("prevalence"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("fpr"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), bound.alias("zero_fp_95pct_upper_bound"),
    )


def ranking(df: DataFrame, label: str = "label", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """auprc and auroc (null unless both classes occur), of all rows or of each group; ties count as one threshold.

    Rows are summed by score before anything is ordered.  Without groups the distinct scores are ordered in two levels: ranges of scores,
    and inside each, so that no single task orders them all.
    """
    by = by or []
    g = known(df, label).groupBy(*by, F.col(p).alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(label).cast("double").alias("pos"))
    if not by:
        g, _ = cut(g.repartitionByRange("p").withColumn("part", F.spark_partition_id()), "scores")  # so that partition numbers stay what they are
        parts = g.groupBy("part").agg(F.sum("n").alias("part_n"), F.sum("pos").alias("part_pos"))
        later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
        parts = parts.select("part", F.coalesce(F.sum("part_n").over(later), F.lit(0.0)).alias("above_n"), F.coalesce(F.sum("part_pos").over(later), F.lit(0.0)).alias("above_pos"))
        w = Window.partitionBy("part").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        g = g.join(F.broadcast(parts), "part")
        cn, cp = F.col("above_n") + F.sum("n").over(w), F.col("above_pos") + F.sum("pos").over(w)
    else:
        w = Window.partitionBy(*by).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cn, cp = F.sum("n").over(w), F.sum("pos").over(w)
    c = g.withColumn("cn", cn).withColumn("cp", cp)
    # positives above each negative, ties by half: the area from the negatives' side
    neg, above = F.col("n") - F.col("pos"), F.col("cp") - F.col("pos")
    sums = c.groupBy(*by).agg(F.sum("pos").alias("np"), F.sum(neg).alias("nn"), F.sum(F.col("pos") * F.col("cp") / F.col("cn")).alias("ap"), F.sum(neg * (above + F.col("pos") / 2)).alias("area"))
    both = (F.col("np") > 0) & (F.col("nn") > 0)
    return sums.select(*by, F.when(both, F.col("ap") / F.col("np")).alias("auprc"), F.when(both, F.col("area") / F.col("np") / F.col("nn")).alias("auroc"))


def _top_score(scores: DataFrame, allowed: int) -> float:
    """The score at place ``allowed`` (from 0), highest first.  ``scores``: p, count.  Ranges of scores are ordered by their counts on the driver, one of them by its scores."""
    ranged, _ = cut(scores.repartitionByRange("p").withColumn("part", F.spark_partition_id()), "scores")
    above = 0
    for r in ranged.groupBy("part").agg(F.sum("count").alias("n")).orderBy(F.desc("part")).collect():  # a row per partition
        if above + r["n"] > allowed:
            part = ranged.where(F.col("part") == r["part"]).withColumn("upto", F.sum("count").over(Window.orderBy(F.desc("p"))))
            return part.where(F.col("upto") > allowed - above).agg(F.max("p")).first()[0]
        above += r["n"]
    raise ValueError("there are no so many scores")


def fpr_threshold(df: DataFrame, target: float, label: str = "label", p: str = "p") -> float:
    """The least number above the first negative score that may not be reached: at most ``target`` of the negatives score as high."""
    if not 0 <= target < 1:
        raise ValueError("the target must be in [0, 1)")
    scores = df.where(F.col(label) == 0).groupBy(F.col(p).alias("p")).count()
    n = scores.agg(F.sum("count")).first()[0]
    if not n:
        raise ValueError("a threshold needs negatives")
    return float(np.nextafter(_top_score(scores, min(int(np.floor(target * n)), n - 1)), np.inf))


def recall_at(df: DataFrame, target: float, label: str = "label", p: str = "p") -> DataFrame:
    """threshold, recall and vd_score (its complement) at a false-positive rate; null without negatives or positives."""
    if df.where(F.col(label) == 0).isEmpty():
        return df.sparkSession.createDataFrame([(None, None, None)], "threshold double, recall double, vd_score double")
    threshold = fpr_threshold(df, target, label, p)
    hit = F.count_if((F.col(label) == 1) & (F.col(p) >= threshold))
    return df.agg(ratio(hit, F.count_if(F.col(label) == 1)).alias("recall")).select(F.lit(threshold).alias("threshold"), "recall", (1 - F.col("recall")).alias("vd_score"))


#: false-positive rates at which recall is reported
RATES = {"recall_at_fpr_1pct": 0.01, "recall_at_fpr_0.1pct": 0.001}


def binary_metrics(df: DataFrame, threshold: float = 0.5, label: str = "label", p: str = "p") -> dict:
    """All figures of scores against labels: counts and rates at ``threshold``, ranking, and recall at fixed false-positive rates (where there are negatives).

    Without known labels only n, auprc and auroc (null).
    """
    data = known(df, label)
    counts = confusion(data, threshold, label, p).first().asDict()
    if not counts["n"]:
        return {"n": 0, "auprc": None, "auroc": None}
    out = counts | ranking(data, label, p).first().asDict()
    if counts["fp"] + counts["tn"]:
        for name, rate in RATES.items():
            out[name] = recall_at(data, rate, label, p).first()["recall"]
        out["vd_score"] = None if out["recall_at_fpr_1pct"] is None else 1 - out["recall_at_fpr_1pct"]
    else:
        out.pop("zero_fp_95pct_upper_bound")
    return out


#: a repetition's draw for a group is a number of 16 bits: so many of them are below 1, 2, ... occurrences (Poisson of mean 1)
POISSON = [round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]
#: draws that one digest has room for
DRAWS = 8


def multiplicities(group: Column, repetitions: int, seed: int) -> Column:
    """How often each repetition takes a group, by hash: 16 bits of the MD5 of (seed, block of repetitions, group) each."""
    blocks = F.sequence(F.lit(0), F.lit(-(-repetitions // DRAWS) - 1))
    digest = F.transform(blocks, lambda b: F.md5(F.concat_ws(":", F.lit(str(seed)), b.cast("string"), group.cast("string")).cast("binary")))
    each = F.flatten(F.transform(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda k: F.conv(F.substring(d, k * 4 + 1, F.lit(4)), 16, 10).cast("int"))))
    count = lambda u: reduce(lambda x, y: x + y, [(u >= t).cast("tinyint") for t in POISSON])
    return F.transform(F.slice(each, 1, repetitions), count)


def _vectors(batch: pa.RecordBatch, repetitions: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and positives of each cell in each repetition."""
    times = batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, repetitions)
    return times * batch.column("n").to_numpy()[:, None], times * batch.column("pos").to_numpy()[:, None]


def _part_totals(batches: Iterator[pa.RecordBatch], repetitions: int) -> Iterator[pa.RecordBatch]:
    """part, n and pos (by repetition): the sums of a task's cells for each range of scores."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        parts, (n, pos) = b.column("part").to_numpy(), _vectors(b, repetitions)
        for part in np.unique(parts):
            own = total.setdefault(int(part), np.zeros((2, repetitions)))
            own += np.stack((n[parts == part].sum(0), pos[parts == part].sum(0)))
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), *(pa.array([list(t[i]) for t in total.values()], pa.list_(pa.float64())) for i in (0, 1))], names=["part", "n", "pos"])


def _part_areas(batches: Iterator[pa.RecordBatch], repetitions: int, above: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """area (by repetition): the sums of positives times precision at their scores, of cells sorted by (part, p descending); equal scores are one threshold, wherever batches end."""
    area, part, score = np.zeros(repetitions), None, None
    seen, tie = np.zeros((2, repetitions)), np.zeros((2, repetitions))

    def close() -> None:
        nonlocal seen, tie
        seen = seen + tie
        area[:] += np.divide(tie[1] * seen[1], seen[0], out=np.zeros(repetitions), where=seen[0] > 0)
        tie = np.zeros((2, repetitions))

    for b in batches:
        parts, ps, (n, pos) = b.column("part").to_numpy(), b.column("p").to_numpy(), _vectors(b, repetitions)
        edges = np.flatnonzero(np.concatenate(([True], (parts[1:] != parts[:-1]) | (ps[1:] != ps[:-1])))) if len(parts) else []
        for at, rows in zip(edges, np.split(np.arange(len(parts)), edges[1:])):
            if (parts[at], ps[at]) != (part, score):
                close()
                if parts[at] != part:
                    seen = above[int(parts[at])].copy()
                part, score = parts[at], ps[at]
            tie += np.stack((n[rows].sum(0), pos[rows].sum(0)))
    close()
    yield pa.RecordBatch.from_arrays([pa.array([area.tolist()], pa.list_(pa.float64()))], names=["area"])


def bootstrap_ap(df: DataFrame, group: str, label: str = "label", p: str = "p", repetitions: int = 200, seed: int = 17) -> DataFrame:
    """low, high: 2.5 and 97.5 % of the average precision over resampled groups.

    A repetition takes each group a Poisson(1) number of times, the limit of drawing as many groups as there are with replacement; a number that depends on seed, repetition and group alone needs no
    draws to be moved.  Rows are summed by (group, score); such a cell has one row with its numbers for all repetitions.  Cells are dealt to ranges of scores; sums of ranges (a row per range and task, of the
    repetitions' length) make what stands above each, and inside a range sums run on for all repetitions at once.  Null with fewer than two groups; repetitions with one class only are left out.
    """
    spark, none = df.sparkSession, "low double, high double"
    data = known(df, label).where(F.col(group).isNotNull() & F.col(p).isNotNull())
    if data.select(group).distinct().limit(2).count() < 2:
        return spark.createDataFrame([(None, None)], none)
    cells = data.groupBy(F.col(group).alias("g"), F.col(p).cast("double").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    times = cells.select("g").distinct().withColumn("times", multiplicities(F.col("g"), repetitions, seed))  # a digest costs more than the join
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged, _ = cut(cells.join(times, "g").repartitionByRange(parts, "p").withColumn("part", F.spark_partition_id().cast("long")), "cells")
    total: dict[int, np.ndarray] = {}
    for r in ranged.select("part", "n", "pos", "times").mapInArrow(lambda b: _part_totals(b, repetitions), "part long, n array<double>, pos array<double>").collect():  # a row per range and task
        total[r["part"]] = total.get(r["part"], 0) + np.stack((np.array(r["n"]), np.array(r["pos"])))
    above, so_far = {}, np.zeros((2, repetitions))
    for part in sorted(total, reverse=True):
        above[part], so_far = so_far, so_far + total[part]
    own = ranged.select("part", "p", "n", "pos", "times").repartition(parts, "part").sortWithinPartitions("part", F.desc("p"))
    areas = own.mapInArrow(lambda b: _part_areas(b, repetitions, above), "area array<double>").collect()  # a row per task
    n, pos = so_far
    both = (pos > 0) & (pos < n)
    aps = (np.sum([r["area"] for r in areas], axis=0) / np.where(pos > 0, pos, 1))[both]
    low, high = (None, None) if not len(aps) else (float(np.quantile(aps, 0.025)), float(np.quantile(aps, 0.975)))
    return spark.createDataFrame([(low, high)], none)


def masked_bce(items: DataFrame, positive_weight: float = 1.0) -> DataFrame:
    """loss: mean over an item's known targets, then the weighted mean over items that have any.  ``items``: item, logit, target, weight."""
    each = items.where("target >= 0").groupBy("item").agg(F.avg(bce(F.col("logit"), F.col("target"), positive_weight)).alias("x"), F.max("weight").alias("w"))
    return each.agg((F.coalesce(F.sum(F.col("x") * F.col("w")), F.lit(0.0)) / F.greatest(F.coalesce(F.sum("w"), F.lit(0.0)), F.lit(1e-8))).alias("loss"))


#: fixed values: weights of the parts of the joint loss
LOSS_WEIGHTS = {"risk": 1.0, "cwe": 0.2, "family": 0.1, "roles": 0.5, "adequacy": 0.3, "edges": 0.3, "pair": 0.2, "teacher": 0.0}


def joint_loss(parts: DataFrame) -> DataFrame:
    """total: weighted sum over heads.  ``parts``: head, loss."""
    weights = F.create_map(*[F.lit(x) for kv in LOSS_WEIGHTS.items() for x in kv])
    return parts.agg(F.sum(F.col("loss") * F.try_element_at(weights, F.col("head"))).alias("total"))


def head_losses(rows: DataFrame, positive_weight: float = 1.0, margin: float = 1.0) -> DataFrame:
    """head, loss: the parts of the joint loss of encoded rows and their outputs, in one aggregation.

    ``rows``: label, adequate, teacher_probability, cwe, family, roles, weight (and graph, whose edges' evidence may be known) of model rows; ``out``: logits risk, adequacy, cwe, family, roles (and edges).  A row's loss in a
    head is the mean over its known targets, a head's the mean of its rows weighted by ``weight``, 0 without any.  Where a row has ``mate_out`` and a pair_relation, its pair counts: higher by ``margin``, or invariant.
    """
    one = lambda f, y: (F.array(f), F.array(y))
    out = F.col("out")
    heads = {
        "risk": one(out["risk"], F.col("label")), "adequacy": one(out["adequacy"], F.col("adequate")), "teacher": one(out["risk"], F.col("teacher_probability")), "cwe": (out["cwe"], F.col("cwe")),
        "family": (out["family"], F.col("family")), "roles": (F.flatten(out["roles"]), F.flatten("roles")),
    }
    if "graph" in rows.columns and "edges" in rows.schema["out"].dataType.fieldNames():
        heads["edges"] = (out["edges"], F.transform(F.col("graph")["edges"], lambda e: e["evidence"]))
    w = F.coalesce(F.col("weight"), F.lit(1.0)).cast("double")
    sums = []
    for head, (f, y) in heads.items():
        known = F.filter(F.zip_with(f, y, lambda a, b: F.when(b >= 0, bce(a.cast("double"), b.cast("double"), positive_weight if head == "risk" else 1.0))), lambda x: x.isNotNull())
        mean = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x) / F.size(known)
        counts = F.size(known) > 0
        sums += [F.sum(F.when(counts, mean * w)).alias(f"{head}_x"), F.sum(F.when(counts, w)).alias(f"{head}_w")]
    if "mate_out" in rows.columns:
        a, b = out["risk"].cast("double"), F.col("mate_out")["risk"].cast("double")
        told = F.when(F.col("pair_relation") == "higher", softplus(margin - (a - b))).when(F.col("pair_relation") == "invariant", F.pow(sigmoid(a) - sigmoid(b), F.lit(2.0)))
        heads["pair"] = None
        sums += [F.sum(told).alias("pair_x"), F.count(told).cast("double").alias("pair_w")]
    loss = lambda h: F.coalesce(F.col(f"{h}_x"), F.lit(0.0)) / F.greatest(F.coalesce(F.col(f"{h}_w"), F.lit(0.0)), F.lit(1e-8))
    return rows.agg(*sums).select(F.inline(F.array(*[F.struct(F.lit(h).alias("head"), loss(h).alias("loss")) for h in heads])))


def pair_loss(pairs: DataFrame, margin: float = 1.0) -> DataFrame:
    """loss over pairs (a, b, relation 0 higher or 1 invariant)."""
    ranked = softplus(margin - (F.col("a") - F.col("b")))
    same = F.pow(sigmoid(F.col("a")) - sigmoid(F.col("b")), F.lit(2.0))
    return pairs.agg(F.avg(F.when(F.col("relation") == 0, ranked).otherwise(same)).alias("loss"))


def supervision(targets: DataFrame) -> DataFrame:
    """head, slot, positive, negative counts of known targets.  ``targets``: head, slot, target."""
    return targets.groupBy("head", "slot").agg(F.count_if(F.col("target") > 0.5).alias("positive"), F.count_if((F.col("target") >= 0) & (F.col("target") <= 0.5)).alias("negative"))


def merged_supervision(*counts: DataFrame) -> DataFrame:
    """The sum of several supervision counts."""
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.groupBy("head", "slot").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


def supported_slots(counts: DataFrame) -> DataFrame:
    return counts.where("positive > 0 and negative > 0").select("head", "slot")


def mean_loss(parts: DataFrame, loss: str = "loss", n: str = "n") -> DataFrame:
    """validation_loss: the sum of losses over their number of terms (tokens or records), 0 without any; and that number.  ``parts``: sums of losses and their n."""
    total = F.coalesce(F.sum(n), F.lit(0))
    return parts.agg((F.coalesce(F.sum(loss), F.lit(0.0)) / F.greatest(total, F.lit(1))).alias("validation_loss"), total.alias("n"))


def tokens_seen(steps: DataFrame, run: str = "run", tokens: str = "tokens") -> DataFrame:
    """``steps`` (run, step, tokens) with the tokens seen up to and with each step."""
    return steps.withColumn("seen", F.sum(tokens).over(Window.partitionBy(run).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def learning_rate_factor(step: Column, seen: Column, warmup: int = 200, most_steps: int = 1000, target_tokens: int = 0, floor: float = 0.1) -> Column:
    """Linear up to ``warmup`` (1 at least), then a cosine down to ``floor``, by tokens seen where there is a target, else by steps."""
    warmup = max(1, warmup)
    done = seen / float(target_tokens) if target_tokens else (step - warmup) / float(max(1, most_steps - warmup))
    done = F.least(F.greatest(done, F.lit(0.0)), F.lit(1.0))
    return F.when(step <= warmup, step / float(warmup)).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(np.pi) * done)))


def _chained(maxima: DataFrame, run: str, min_delta: float) -> DataFrame:
    """(run, step) of the records: the first evaluation, and from each the first one that is better by more than ``min_delta``.

    ``maxima``: run, step, score, ascending in both.  Where a record leads to is found in the order of scores, so each row has one pointer; pointers are doubled until every chain is walked.
    """
    spark = maxima.sparkSession
    asked = maxima.select(run, (F.col("score") + min_delta).alias("score"), F.lit(0).alias("kind"), "step").union(maxima.select(run, "score", F.lit(1).alias("kind"), "step"))
    higher = Window.partitionBy(run).orderBy(F.desc("score"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a question comes before its equals
    pointer, path = cut(asked.withColumn("next", F.min(F.when(F.col("kind") == 1, F.col("step"))).over(higher)).where("kind = 0").select(run, "step", "next"), "pointers")
    found, found_path = cut(maxima.groupBy(run).agg(F.min("step").alias("step")), "records")
    n = found.count()
    while True:
        step, old = found.join(pointer, [run, "step"]).where("next is not null").select(run, F.col("next").alias("step")), found_path
        found, found_path = cut(found.union(step).distinct(), "records")
        more = found.count()
        remove(spark, old)
        if more == n:
            remove(spark, path)
            return found
        n, old = more, path
        jump = pointer.select(F.col(run), F.col("step").alias("next"), F.col("next").alias("after"))
        pointer, path = cut(pointer.join(jump, [run, "next"], "left").select(run, "step", F.col("after").alias("next")), "pointers")
        remove(spark, old)


def progress(steps: DataFrame, run: str = "run", min_delta: float = 0.0) -> DataFrame:
    """Per run, in order of step: whether a score is a new best (by more than ``min_delta``), and bad evaluations since.  ``steps``: run, step (each once in a run), score.

    Without a delta a best is a new running maximum.  With one the rule depends on its own past, but bests are running maxima still, and those are few: they are chained (see ``_chained``).
    """
    w = Window.partitionBy(run).orderBy("step")
    top = F.max("score").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = steps.select(run, F.col("step").cast("bigint").alias("step"), F.col("score").cast("double").alias("score"), F.coalesce(F.col("score") > top, F.lit(True)).alias("is_best"), F.row_number().over(w).alias("__n"))
    if min_delta > 0:
        rows, _ = cut(rows, "progress")
        records = _chained(rows.where("is_best").select(run, "step", "score"), run, min_delta).withColumn("__record", F.lit(True))
        rows = rows.join(records, [run, "step"], "left").withColumn("is_best", F.coalesce("__record", F.lit(False))).drop("__record")
    best = F.max(F.when(F.col("is_best"), F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("bad", F.col("__n") - best).drop("__n")


def retained(checkpoints: DataFrame, run: str = "run", keep: int = 3) -> DataFrame:
    """The last ``keep`` checkpoints of a run (the newest one always), and its best (the earliest of equals).  ``checkpoints``: run, step, score."""
    keep = max(1, keep)
    last = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("step")))
    best = F.row_number().over(Window.partitionBy(run).orderBy(F.desc("score"), "step"))
    return checkpoints.withColumn("__last", last).withColumn("__best", best).where((F.col("__last") <= keep) | (F.col("__best") == 1)).drop("__last", "__best")


def calibrated(df: DataFrame, temperature: float, bias: float, threshold: float, logit: str = "logit") -> DataFrame:
    """probability of logit / temperature + bias, and whether it reaches the threshold."""
    return df.withColumn("probability", sigmoid(F.col(logit) / temperature + bias)).withColumn("status", F.when(F.col("probability") >= threshold, "finding_candidate").otherwise("no_finding_under_supplied_context"))


def fit_calibration(df: DataFrame, logit: str = "logit", label: str = "label", steps: int = 25) -> tuple[float, float]:
    """Temperature and bias that minimise cross-entropy, by Newton steps; each step is one aggregation over all rows."""
    data = known(df, label).select(F.col(logit).cast("double").alias("x"), F.col(label).cast("double").alias("y"))
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = sigmoid(a * F.col("x") + b)
        g, w = q - F.col("y"), q * (1 - q)
        s = data.agg(F.avg(g * F.col("x")), F.avg(g), F.avg(w * F.col("x") * F.col("x")), F.avg(w * F.col("x")), F.avg(w)).first()
        if s[0] is None:
            raise ValueError("calibration needs labelled rows")
        step = np.linalg.solve(np.array([[s[2] + 1e-9, s[3]], [s[3], s[4] + 1e-9]]), np.array([s[0], s[1]]))
        a, b = float(np.clip(a - step[0], 0.05, 20)), b - float(step[1])
        if np.abs(step).max() < 1e-10:
            break
    return 1 / a, b


def top_k(df: DataFrame, by: str, score: str, k: int, tie: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
