"""Settings of a training run, read from a document, and the parameters of encoders of many sizes, counted by joins of their shapes."""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.operators.steps import Settings

#: fixed values: the full encoder's sizes
FULL = {
    "vocab_size": 32768, "dim": 640, "layers": 16, "ffn_dim": 1664, "global_every": 4, "graph_dim": 128, "graph_heads": 4, "relations": 16, "task_dim": 256, "edge_dim": 64, "families": 12, "cwes": 64, "evidence_roles": 8,
}


def read_settings(text: str) -> Settings:
    """The ``training`` mapping of a JSON or (where the library is there) YAML document; names that are no settings are an error."""
    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:
        found = json.loads(text)
    if not isinstance(found, dict) or not isinstance(found.get("training", {}), dict):
        raise ValueError("a configuration is a mapping")
    own = found.get("training", {})
    if unknown := set(own) - {f.name for f in fields(Settings)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Settings(**own)


def shapes() -> list[tuple[str, str, Column, Column, bool]]:
    """part, name, numbers, times, whether it only serves pretraining: of all weights, by the columns of ``FULL``."""
    c = {k: F.col(k).cast("long") for k in FULL}
    d, g, t, one = c["dim"], c["graph_dim"], c["task_dim"], F.lit(1).cast("long")
    adapters = F.floor(c["layers"] / c["global_every"])
    fixed = lambda n: F.lit(n).cast("long")
    return [
        ("token", "embedding", c["vocab_size"] * d, one, False), ("kind", "embedding", fixed(32) * d, one, False), ("role", "embedding", fixed(8) * d, one, False), ("language", "embedding", fixed(8) * d, one, False),
        ("blocks", "attention", fixed(4) * d * d, c["layers"], False), ("blocks", "feed_forward", fixed(3) * d * c["ffn_dim"], c["layers"], False), ("blocks", "norms", fixed(2) * d, c["layers"], False),
        ("adapters", "norms", d + g, adapters, False), ("adapters", "down_up", fixed(2) * d * g, adapters, False), ("adapters", "attention", fixed(4) * g * g, adapters, False),
        ("adapters", "relations", c["relations"] * (g + c["graph_heads"]), adapters, False), ("adapters", "gate", one, adapters, False), ("final_norm", "norm", d, one, False),
        ("heads", "project", d * t + t, one, False), ("heads", "outputs", (t + 1) * (c["families"] + c["cwes"] + c["evidence_roles"] + 2), one, False), ("heads", "edges", fixed(2) * d * c["edge_dim"] + c["relations"], one, False),
        ("mlm", "transform", d * d + d, one, True), ("mlm", "norm", d, one, True), ("mlm", "bias", c["vocab_size"], one, True),
    ]


def parameters(models: DataFrame, key: str) -> DataFrame:
    """key, part, name, numbers, times and pretraining_only of each model; sizes that ``models`` (key, and some of ``FULL``) lacks are the full encoder's."""
    given = {k: F.col(k) if k in models.columns else F.lit(v) for k, v in FULL.items()}
    rows = [F.struct(F.lit(p).alias("part"), F.lit(n).alias("name"), a.alias("numbers"), b.alias("times"), F.lit(only).alias("pretraining_only")) for p, n, a, b, only in shapes()]
    return models.select(key, *[c.alias(k) for k, c in given.items()]).select(key, F.inline(F.array(*rows)))


def parameter_counts(sizes: DataFrame, key: str) -> DataFrame:
    """training_model and inference_model of each key: all parameters, and those that are needed after pretraining."""
    n = F.col("numbers") * F.col("times")
    return sizes.groupBy(key).agg(F.sum(n).alias("training_model"), F.sum(F.when(~F.col("pretraining_only"), n)).alias("inference_model"))
