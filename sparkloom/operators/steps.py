"""Training in steps: mini-batches in a seeded order, AdamW on the driver, validation, patience, checkpoints, and runs that go on where they stopped.

Weights and moments have a fixed size.  An epoch's order is written as a table in parts of consecutive batches, sorted by batch, so that nothing is read more often than once.
Steps between two checkpoints are one job to each part: its tasks hold a share of each batch's rows, exchange the sums of a step, and move the same model alike (Spark's barrier mode).
Models whose sums are too large to be exchanged, and steps that lie across the end of a part, are one aggregation each (see ``linear``); both ways give the same weights, bit by bit.
Checkpoints hold weights, moments, and the place in the stream (epoch, batch), so that a run that was stopped and resumed has the same weights, bit by bit, as one that was not.
"""

from __future__ import annotations

import json
import math
import os
import secrets
import socket
import time
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import asdict, dataclass
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.functions.text import bce, sigmoid
from sparkloom.operators import batch, linear
from sparkloom.operators.encode import encode
from sparkloom.operators.metrics import binary_metrics, mean_loss, merged_supervision, supervision
from sparkloom.operators.record import completed, validated
from sparkloom.operators.report import runtime
from sparkloom.operators.storage import cut, new_path, remove
from sparkloom.operators.training import comparable, resolve, save_checkpoint, targets_of
from sparkloom.sources.files import append_event, exists, read_document, write_document

#: fixed values: the optimizer's
BETAS, EPSILON = (0.9, 0.95), 1e-8
#: rows of a part of an epoch's table; the least rows of a step for each task; weights beyond which sums are not exchanged by tasks
PART_ROWS, TASK_ROWS, EXCHANGED = 1 << 19, 128, 1 << 17


@dataclass(frozen=True)
class Settings:
    stage: str = "sft"
    bits: int = 16
    weaknesses: bool = False
    batch_size: int = 256
    #: batches to a step
    accumulation: int = 1
    learning_rate: float = 0.05
    weight_decay: float = 0.1
    clip_norm: float = 1.0
    warmup: int = 200
    max_steps: int = 1000
    #: tokens after which a run ends (0: steps alone decide)
    target_tokens: int = 0
    floor: float = 0.1
    evaluate_every: int = 200
    #: validation rows (0: all), drawn by hash
    validation_rows: int = 0
    #: evaluations without a new best after which a run ends (0: never)
    patience: int = 0
    min_delta: float = 0.0
    keep: int = 3
    seed: int = 17

    def __post_init__(self):
        if self.stage not in ("sft", "align", "security"):
            raise ValueError("a linear model is trained on labels: sft, align or security")
        if min(self.batch_size, self.accumulation, self.evaluate_every, self.max_steps) < 1:
            raise ValueError("batch_size, accumulation, evaluate_every and max_steps are 1 at least")


def rate(step: int, seen: int, s: Settings) -> float:
    """The learning rate of a step: up in ``warmup`` steps, then down a cosine to ``floor`` of it, by tokens seen where there is a target."""
    warmup = max(1, s.warmup)
    if step <= warmup:
        return s.learning_rate * step / warmup
    done = seen / s.target_tokens if s.target_tokens else (step - warmup) / max(1, s.max_steps - warmup)
    return s.learning_rate * (s.floor + (1 - s.floor) * 0.5 * (1 + math.cos(math.pi * min(max(done, 0.0), 1.0))))


@dataclass
class State:
    """What a step changes: the model and its moments, the steps done, the tokens seen."""

    model: linear.Linear
    m: np.ndarray
    v: np.ndarray
    step: int
    seen: int

    def arrays(self) -> np.ndarray:
        return np.stack((self.model.weights, self.m, self.v))


def ended(state: State, s: Settings) -> bool:
    return state.step >= s.max_steps or bool(s.target_tokens and state.seen >= s.target_tokens)


def advance(state: State, got: dict, s: Settings) -> tuple[State, dict]:
    """The state after a step with the sums of its rows, and the step's event; where its loss or gradient is not finite, the state before it."""
    model, step, lr = state.model, state.step + 1, rate(state.step + 1, state.seen, s)
    scale = linear.head_weights(model.heads) / np.maximum(got["weight"], 1e-8)
    gradient, loss = got["gradient"] * scale, float((got["loss"] * scale).sum())
    norm = float(np.sqrt((gradient**2).sum()))
    if not math.isfinite(loss) or not math.isfinite(norm):
        return state, {"step": step, "loss": None}
    gradient *= min(1.0, s.clip_norm / (norm + 1e-6))
    m, v = BETAS[0] * state.m + (1 - BETAS[0]) * gradient, BETAS[1] * state.v + (1 - BETAS[1]) * gradient**2
    decay = np.full((len(m), 1), lr * s.weight_decay)
    decay[-1] = 0  # the bias doesn't decay
    moved = model.weights * (1 - decay) - lr * (m / (1 - BETAS[0] ** step)) / (np.sqrt(v / (1 - BETAS[1] ** step)) + EPSILON)
    after = State(linear.Linear(moved, model.heads), m, v, step, state.seen + got["tokens"])
    return after, {"step": step, "seen_tokens": after.seen, "loss": loss, "gradient_norm": norm, "learning_rate": lr}


def tasks_of(spark: SparkSession, s: Settings) -> int:
    """How many tasks share a step: no more than surely run at once, none if executors come and go."""
    conf, cores = spark.sparkContext.getConf(), spark.sparkContext.defaultParallelism
    if conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 0
    if conf.contains("spark.default.parallelism"):
        executors = spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()
        cores = min(cores, max(1, len(executors) - 1) * int(conf.get("spark.executor.cores", "1")))
    cores = cores // int(conf.get("spark.task.cpus", "1")) if cores > 2 else 1  # a cluster of one core says 2
    return max(1, min(cores, s.batch_size * s.accumulation // TASK_ROWS))


@contextmanager
def exchange(context: BarrierTaskContext, secret: bytes) -> Iterator[Callable[[np.ndarray], np.ndarray]]:
    """A function that every task of a barrier stage calls with whole numbers and that returns the sum of all.

    The tasks are connected to the first one by the addresses that Spark gives; ``allGather`` alone tells them the port, as each of its rounds takes a second.  A task that fails closes its connections, so that the others fail too and Spark repeats the stage.
    """
    host, mine, n = context.getTaskInfos()[0].address.rsplit(":", 1)[0].strip("[]"), context.partitionId(), len(context.getTaskInfos())
    with ExitStack() as stack:
        first = stack.enter_context(Listener((host, 0), "AF_INET6" if ":" in host else "AF_INET", backlog=n, authkey=secret)) if mine == 0 else None
        port = int(context.allGather(str(first.address[1]) if first else "")[0])
        peers = [stack.enter_context(first.accept() if first else Client((host, port), "AF_INET6" if ":" in host else "AF_INET", authkey=secret)) for _ in range(n - 1 if first else 1)]
        for p in peers:  # small messages are sent at once
            with socket.socket(fileno=os.dup(p.fileno())) as s:
                s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

        def summed(x: np.ndarray) -> np.ndarray:
            if first:
                for p in peers:
                    x = x + np.frombuffer(p.recv_bytes(), np.int64)
            for p in peers:
                p.send_bytes(x.tobytes())
            return x if first else np.frombuffer(peers[0].recv_bytes(), np.int64)

        yield summed


def _by_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows that are sorted by batch (the last column), a piece for each batch that an Arrow batch has rows of."""
    for rows in batches:
        names = rows.column(rows.num_columns - 1).to_numpy()
        starts = np.flatnonzero(np.diff(names, prepend=names[:1] - 1))
        for a, b in zip(starts, [*starts[1:], len(names)]):
            yield int(names[a]), rows.slice(a, b - a)


def advance_together(rows: DataFrame, tasks: int, first: int, count: int, state: State, s: Settings) -> tuple[State, list[dict]]:
    """``count`` steps over ``rows``, from batch ``first`` on, in one job; fewer where the run ends or a step is not finite.  The state after them, and an event for each.

    Rows are dealt to ``tasks``, which must run at once.  In each step a task adds up its share, gets the sums of all, and moves its copy of the model; copies that differ at the end are an error.
    """
    spark, shape, secret = rows.sparkSession, state.model.weights.shape, secrets.token_bytes(32)
    shared = spark.sparkContext.broadcast(state)  # of the model's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, now, events, pieces = BarrierTaskContext.get(), shared.value, [], _by_batch(batches)
        piece = next(pieces, None)
        with exchange(context, secret) as summed:
            while len(events) < count and not ended(now, s):
                end, own = first + (len(events) + 1) * s.accumulation, linear.Tally(shape)
                while piece and piece[0] < end:
                    if not own.broken:
                        own.add(now.model, piece[1])
                    piece = next(pieces, None)
                now, event = advance(now, linear.Tally.of(summed(own.numbers()), shape).sums(), s)
                events.append(event)
                if event["loss"] is None:
                    break
        told = [(json.dumps(events), now.arrays().tobytes())] if context.partitionId() == 0 else [(None, None)]
        yield pa.RecordBatch.from_pylist([{"digest": now.model.digest(), "events": e, "arrays": a} for e, a in told], pa.schema([("digest", pa.string()), ("events", pa.string()), ("arrays", pa.binary())]))

    dealt = linear.narrow(rows, state.model.heads, "batch").repartition(tasks).sortWithinPartitions("batch")
    got = dealt.mapInArrow(run, "digest string, events string, arrays binary", barrier=True).collect()  # one row a task, one model
    shared.unpersist()
    if len({r["digest"] for r in got}) != 1:
        raise RuntimeError(f"after step {state.step} the models of {len(got)} tasks differ")
    told = next(r for r in got if r["arrays"] is not None)
    events = json.loads(told["events"])
    weights, m, v = np.frombuffer(told["arrays"]).reshape(3, *shape)
    done = [e for e in events if e["loss"] is not None]
    return State(linear.Linear(weights, state.model.heads), m, v, state.step + len(done), done[-1]["seen_tokens"] if done else state.seen), events


class Stream:
    """Batches of rows, epoch after epoch, from a place (epoch, batch) on; ``most`` bounds how many are asked for, and the others aren't written."""

    def __init__(self, rows: DataFrame, settings: Settings, epoch: int = 0, at: int = 0, most: int = 1 << 62):
        self.rows = rows.select("id", "input_ids", "label", "cwe", "weight", F.size("input_ids").alias("length"))
        self.settings, self.epoch, self.at, self.most, self.path = settings, epoch, at, most, None
        self.span, self.tasks = max(1, PART_ROWS // settings.batch_size), tasks_of(rows.sparkSession, settings)

    def _open(self) -> None:
        """The epoch's table, written when it is first needed."""
        if self.path:
            return
        s, spark = self.settings, self.rows.sparkSession
        self.batches = max(1, batch.epoch_length(self.rows, s.batch_size, s.seed, self.epoch))
        order = batch.epoch_batches(self.rows, "length", s.batch_size, s.seed, self.epoch).drop("length", "id").withColumn("part", F.expr(f"batch div {self.span}").cast("int"))
        order = order.where(F.col("batch").between(self.at, min(self.batches, self.at + self.most) - 1))
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.path = new_path(spark, "epoch")
        order.repartitionByRange(parts, "batch", "slot").sortWithinPartitions("part", "batch", "slot").write.partitionBy("part").parquet(self.path)
        self.table = spark.read.schema(order.schema).parquet(self.path)

    def _batches(self, n: int) -> DataFrame:
        """The rows of the next batches."""
        last = self.at + n - 1
        return self.table.where(F.col("part").between(self.at // self.span, last // self.span) & F.col("batch").between(self.at, last))

    def _pass(self, n: int) -> None:
        self.at, self.most = self.at + n, self.most - n
        if self.at == self.batches:
            self.epoch, self.at = self.epoch + 1, 0
            self.close()

    def sums(self, model: linear.Linear) -> dict:
        """The sums of the next step's batches, which may reach into the next epoch."""
        left, out = self.settings.accumulation, None
        while left:
            self._open()
            n = min(left, self.batches - self.at)
            own = linear.sums(self._batches(n), model)
            out = own if out is None else {k: out[k] + own[k] for k in own}
            left -= n
            self._pass(n)
        return out

    def advance(self, state: State, most: int) -> tuple[State, list[dict]]:
        """Some of the next ``most`` steps, one at least: those of a part together."""
        self._open()
        s = self.settings
        n = min(most, (min(self.batches, (self.at // self.span + 1) * self.span) - self.at) // s.accumulation)
        if n > 1 and self.tasks and state.model.weights.size <= EXCHANGED:
            epoch, first = self.epoch, self.at
            state, events = advance_together(self._batches(n * s.accumulation), self.tasks, first, n, state, s)
            self._pass(len(events) * s.accumulation)
            return state, [e | {"epoch": self.epoch if e is events[-1] else epoch} for e in events]
        state, event = advance(state, self.sums(state.model), s)
        return state, [event | {"epoch": self.epoch}]

    def close(self) -> None:
        if self.path:
            remove(self.rows.sparkSession, self.path)
        self.path = None


def validate(validation: DataFrame, model: linear.Linear, length: int, settings: Settings) -> dict:
    rows = batch.sampled(validation, settings.validation_rows, settings.seed) if settings.validation_rows else validation
    # drawn and scored once; the metrics read narrow rows
    out, path = cut(linear.scored(rows, model, length).withColumn("p", sigmoid(F.col("logit"))), "validation")
    loss = out.where("label >= 0").agg(F.sum(bce(F.col("logit"), F.col("label").cast("double"))).alias("loss"), F.count(F.lit(1)).alias("n"))
    figures = {**binary_metrics(out), "validation_loss": mean_loss(loss).first()["validation_loss"]}
    remove(validation.sparkSession, path)
    return figures


def _counts(rows: DataFrame, before: dict) -> dict:
    """Positive and negative targets by head and slot, added to those of an earlier stage."""
    spark = rows.sparkSession
    told = [(h, i, p, n) for h, c in before.items() for i, (p, n) in enumerate(zip(c["positive"], c["negative"]))]
    counts = merged_supervision(supervision(targets_of(rows)), spark.createDataFrame(told, "head string, slot int, positive long, negative long"))
    out: dict = {}
    for r in counts.orderBy("head", "slot").collect():  # a row per head and slot
        own = out.setdefault(r["head"], {"positive": [], "negative": []})
        own["positive"].append(r["positive"])
        own["negative"].append(r["negative"])
    return out


def load(spark: SparkSession, path: str, prefer: str = "best") -> tuple[linear.Linear, dict]:
    """The model of a run or checkpoint, and its document."""
    where = resolve(spark, path, prefer)
    about = read_document(spark, f"{where}/metadata.json")
    return linear.load(spark, f"{where}/model", about["size"], about["heads"])[0], about


def train_steps(
    rows: DataFrame, validation: DataFrame, train_manifest: dict, validation_manifest: dict, run: str, settings: Settings = Settings(), init: str | None = None, resume: bool = False, stop_after: int | None = None
) -> dict:
    """Train until the steps, the tokens or the patience end, or ``stop_after`` steps of this call; step, seen_tokens, last_saved_step and validation are returned.

    ``init``: the run or checkpoint whose best weights a new run starts from.  ``resume``: go on with this run from its latest checkpoint; its settings, stage and data must be the same.
    Every evaluation writes a checkpoint; a new best is one by more than ``min_delta``.  A loss or gradient that is not finite is an error.
    """
    if init and resume:
        raise ValueError("a run is either started from other weights or resumed")
    comparable(train_manifest, validation_manifest, settings.stage)
    spark, s = rows.sparkSession, settings
    if exists(spark, f"{run}/latest.json") and not resume:
        raise FileExistsError(f"{run} has checkpoints: resume it, or take another folder")
    heads = linear.heads_of(s.weaknesses)
    data = {"train_data": train_manifest["data"], "validation_data": validation_manifest["data"], "tokenizer_sha256": train_manifest["tokenizer_sha256"]}
    length = max(train_manifest["max_length"], validation_manifest["max_length"])
    model, moments = linear.Linear.zero(s.bits, heads), []
    place = {"step": 0, "seen_tokens": 0, "epoch": 0, "batch": 0, "best_score": None, "bad_evaluations": 0}
    earlier: dict = {}
    if init or resume:
        where = resolve(spark, init or run, "latest" if resume else "best")
        about = read_document(spark, f"{where}/metadata.json")
        if about["size"] != model.size or about["heads"] != heads:
            raise ValueError("the checkpoint's model has another size or other heads")
        if about["tokenizer_sha256"] != data["tokenizer_sha256"]:
            raise ValueError("the checkpoint was trained with another tokenizer")
        model, found = linear.load(spark, f"{where}/model", model.size, heads)
        earlier = about["supervision"]
        if resume:
            if about["settings"] != asdict(s):
                raise ValueError("a run is resumed with the settings that it was started with")
            if any(about[k] != v for k, v in data.items()):
                raise ValueError("a run is resumed on the data that it was started on")
            place, moments, earlier = about["state"], found, about["inherited_supervision"]
    state = State(model, *(moments or [np.zeros_like(model.weights), np.zeros_like(model.weights)]), place["step"], place["seen_tokens"])
    counts = _counts(rows, earlier)
    last = s.max_steps if stop_after is None else min(s.max_steps, place["step"] + stop_after)
    stream = Stream(rows, s, place["epoch"], place["batch"], (last - place["step"]) * s.accumulation)
    best, bad, saved, figures, events = place["best_score"], place["bad_evaluations"], place["step"] if resume else -1, None, []
    try:
        while state.step < last and not ended(state, s) and not (s.patience and bad >= s.patience):
            state, new = stream.advance(state, min(last, (state.step // s.evaluate_every + 1) * s.evaluate_every) - state.step)
            events += [e for e in new if e["loss"] is not None]
            if new[-1]["loss"] is None:
                raise FloatingPointError(f"step {new[-1]['step']}: the loss or its gradient is not finite")
            step, seen = state.step, state.seen
            if step % s.evaluate_every == 0 or step >= last or ended(state, s):
                figures = validate(validation, state.model, length, s)
                score = -figures["validation_loss"] if figures.get("auprc") is None else figures["auprc"]
                better = best is None or score > best + s.min_delta
                best, bad = (score, 0) if better else (best, bad + 1)
                events[-1] |= {"validation": figures, "best": better, "early_stopped": bool(s.patience and bad >= s.patience)}
                about = {
                    "format": 1, "stage": s.stage, "step": step, "seen_tokens": seen, "score": score, "settings": asdict(s), "size": model.size, "heads": heads, "weights_sha256": state.model.digest(), **data,
                    "state": {"step": step, "seen_tokens": seen, "epoch": stream.epoch, "batch": stream.at, "best_score": best, "bad_evaluations": bad},
                    "vocab_size": train_manifest["vocab_size"], "max_length": train_manifest["max_length"], "supervision": counts, "inherited_supervision": earlier, "validation": figures,
                }
                save_checkpoint(spark, run, lambda at: linear.save(spark, at, state.model, state.m, state.v), about, s.keep, better)  # noqa: B023
                saved = step
    finally:
        stream.close()
        if events:
            append_event(spark, f"{run}/events", events)
    write_document(spark, f"{run}/settings.json", asdict(s))
    return {"step": state.step, "seen_tokens": state.seen, "last_saved_step": saved, "validation": figures, "weights_sha256": state.model.digest()}



def doctor(spark: SparkSession, steps: int = 2, length: int = 128, records: int = 64) -> dict:
    """Exercise the real way of a record from its text to a trained and reloaded model, and time its steps.

    A record with labels, evidence and a graph is encoded ``records`` times with names of its own; a model is trained on the rows, saved, loaded and compared.  Returned: runtime, features, seconds of a step, tokens a second, losses,
    and the greatest difference of a logit after loading, of which anything but 0 is an error.
    """
    if steps < 1 or length < 64 or length % 8:
        raise ValueError("steps is 1 at least, length a multiple of 8 from 64 on")
    code = F.concat(F.lit("int f"), F.col("id"), F.lit("(int i){ int a[4]={1,2,3,4}; return a[i]; }"))
    at = F.instr(code, "a[i]") - 1
    node = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    edge = F.struct(F.lit(0).alias("src"), F.lit(1).alias("dst"), F.lit("ast_child").alias("type"), F.lit(1).alias("evidence"))
    df = spark.range(records).select(F.concat(F.lit("d"), "id").alias("id"), F.lit("diagnostic").alias("group_id"), (F.col("id") % 2).cast("int").alias("label"), code.alias("code"), at.alias("at"))
    df = df.withColumns({
        "adequate": F.lit(1), "cwes": F.when(F.col("label") == 1, F.array(F.lit("CWE-125"))), "known_cwes": F.array(F.lit("CWE-416")),
        "evidence": F.array(F.struct(F.col("at").alias("start"), (F.col("at") + 4).alias("end"), F.create_map(F.lit("risky_operation"), F.lit(1), F.lit("guard"), F.lit(0)).alias("roles"))),
        "graph": F.struct(F.array(node(F.lit(0), F.length("code")), node(F.col("at"), F.col("at") + 4)).alias("nodes"), F.array(edge).alias("edges")),
    }).drop("at")
    rows, path = cut(encode(validated(completed(df)), length), "doctor")
    settings = Settings(bits=12, batch_size=max(1, records // 2), warmup=1, max_steps=steps, weaknesses=True)
    model, m = linear.Linear.zero(settings.bits, linear.heads_of(True)), None
    stream, losses, tokens, began = Stream(rows, settings), [], 0, time.time()
    for step in range(1, steps + 1):
        got = stream.sums(model)
        scale = linear.head_weights(model.heads) / np.maximum(got["weight"], 1e-8)
        losses.append(float((got["loss"] * scale).sum()))
        m = got["gradient"] * scale
        model, tokens = linear.Linear(model.weights - rate(step, tokens, settings) * m, model.heads), tokens + got["tokens"]
    took = time.time() - began
    stream.close()
    saved = new_path(spark, "doctor-model")
    linear.save(spark, saved, model)
    ids = np.array([r[0] for r in rows.select("input_ids").limit(2).collect()][:1])
    apart = float(np.abs(model.logits(ids) - linear.load(spark, saved, model.size, model.heads)[0].logits(ids)).max())
    figures = rows.agg(F.count_if(F.col("graph").isNotNull()).alias("graphs"), F.count(F.lit(1)).alias("n")).first()
    remove(spark, path, saved)
    if apart or figures["graphs"] != records or not all(map(math.isfinite, losses)):
        raise RuntimeError(f"the check failed: logits differ by {apart}, {figures['graphs']} of {records} graphs, losses {losses}")
    return {**runtime(spark), "features": model.size, "rows": figures["n"], "steps": steps, "losses": losses, "seconds_a_step": took / steps, "tokens_a_second": tokens / took, "logit_error_after_loading": apart}
