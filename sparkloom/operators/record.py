"""The canonical record: fixed names, structure, defaults and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Names of evidence roles, graph relations and weakness slots, in slot order.
ROLES = ["origin", "transformation", "risky_operation", "guard", "allocation", "release", "use", "size_bounds"]
RELATIONS = [
    "ast_child", "ast_parent", "cfg_next", "cfg_previous", "definition_use", "use_definition", "control_true", "control_false",
    "argument_parameter", "parameter_argument", "return_use", "use_return", "memory_dependence", "memory_dependence_reverse", "self", "other",
]
WEAKNESSES = [
    20, 22, 23, 36, 59, 77, 78, 79, 89, 94, 119, 120, 121, 122, 125, 126, 129, 131, 134, 170, 190, 191, 194, 195, 196, 197, 200, 209, 252, 253, 269, 276,
    285, 287, 295, 310, 319, 327, 362, 367, 369, 400, 401, 404, 415, 416, 426, 427, 476, 502, 590, 601, 611, 617, 665, 681, 682, 704, 754, 755, 772, 787, 788, 908,
]
FAMILIES = 12
SPLITS = ["train", "validation", "calibration", "test"]

_TEXT, _INT, _DOUBLE, _FLAG = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_TEXTS = T.ArrayType(_TEXT)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SPAN = _struct(start=_INT, end=_INT)
EVIDENCE = T.ArrayType(_struct(start=_INT, end=_INT, roles=T.MapType(_TEXT, _INT)))
GRAPH = _struct(nodes=T.ArrayType(SPAN), edges=T.ArrayType(_struct(src=_INT, dst=_INT, type=_TEXT, evidence=_INT)))
CORE = _struct(
    id=_TEXT, group_id=_TEXT, repo=_TEXT, code=_TEXT, language=_TEXT, source=_TEXT, label=_INT, adequate=_INT, teacher_probability=_DOUBLE, weight=_DOUBLE, split=_TEXT, incident=_TEXT, incidents=_TEXTS,
    commit=_TEXT, source_path=_TEXT, license=_TEXTS, cwes=_TEXTS, known_cwes=_TEXTS, cwe_complete=_FLAG, family_labels=T.MapType(_TEXT, _INT), target_span=SPAN, evidence=EVIDENCE, graph=GRAPH,
)
CANONICAL = T.StructType([*CORE.fields, T.StructField("mate", CORE), T.StructField("pair_relation", T.StringType()), T.StructField("pair_verified", T.BooleanType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])


def core(**fields: Column) -> Column:
    """A record without a mate as a struct; fields that are not given are null."""
    return F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CORE.fields])


def completed(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All canonical columns, absent ones null, the defaults of id, weight and target span, and the columns to ``keep`` besides."""
    have = set(df.columns)
    out = df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CANONICAL.fields], *(keep or []))
    whole = F.struct(F.lit(0).alias("start"), F.length("code").alias("end"))
    return out.withColumns({"id": F.coalesce("id", F.sha2("code", 256)), "weight": F.coalesce("weight", F.lit(1.0)), "target_span": F.coalesce("target_span", whole)})


def violations(of=F.col, paired: bool = True, blank: str = "") -> Column:
    """Names of the broken rules of a record, in the order of checking; empty if it is valid.  ``blank``: which code may be blank, ``empty`` (nothing at all, or null) or ``any`` (white space too); the whole span of such code may be empty."""
    if blank not in ("", "empty", "any"):
        raise ValueError(f"blank is '', 'empty' or 'any', not {blank!r}")
    code, length = of("code"), F.length(of("code"))
    tri = lambda c: c.isNotNull() & ~c.isin(0, 1)
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    teacher, weight, span = of("teacher_probability"), F.coalesce(of("weight"), F.lit(1.0)), of("target_span")
    spans_bad = F.exists(F.coalesce(of("evidence"), F.array().cast(EVIDENCE)), lambda e: ~((e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= length)))
    roles_bad = F.exists(F.coalesce(of("evidence"), F.array().cast(EVIDENCE)), lambda e: F.exists(F.map_entries(e["roles"]), lambda r: ~r["key"].isin(ROLES) | r["value"].isNull() | ~r["value"].isin(0, 1)))
    span_bad = span.isNotNull() & ~((span["start"] >= 0) & (span["start"] < span["end"]) & (span["end"] <= length))
    if blank:
        span_bad = span_bad & ~((length == 0) & (span["start"] == 0) & (span["end"] == 0))
    no_code = ~code.rlike(r"[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
    code_bad = {"": code.isNull() | no_code, "empty": (length > 0) & no_code, "any": F.lit(False)}[blank]
    rules = [
        ("code", code_bad),
        ("group_id", of("group_id").isNull() | (of("group_id") == "")),
        ("label", tri(of("label"))), ("adequate", tri(of("adequate"))),
        ("teacher_probability", teacher.isNotNull() & ~(finite(teacher) & teacher.between(0, 1))),
        ("weight", ~(finite(weight) & (weight > 0))),
        ("target_span", span_bad),
        ("evidence", spans_bad), ("evidence_roles", roles_bad),
    ]
    if paired:
        mate = of("mate")
        rules.append(("pair", mate.isNotNull() & ~F.coalesce(of("pair_relation").isin("higher", "invariant") & of("pair_verified"), F.lit(False))))
        rules.append(("mate", mate.isNotNull() & (F.size(violations(lambda n: mate[n], False)) > 0)))
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())


def validated(df: DataFrame, strict: bool = True, keep: list[str] | None = None, blank: str = "") -> DataFrame:
    """The completed records; a broken one is an error, or with ``strict`` off gets its broken rules in ``violations``.  ``blank``: see ``violations``."""
    out = completed(df, keep).withColumn("violations", violations(blank=blank))
    if not strict:
        return out
    message = F.concat(F.col("id"), F.lit(": "), F.array_join("violations", ", "))
    return out.where(F.when(F.size("violations") > 0, F.raise_error(message).cast("boolean")).otherwise(True)).drop("violations")
