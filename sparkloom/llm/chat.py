"""Chat formatting by relational expressions alone: no Python runs on the executors.

Turns of a conversation are collected as structs and sorted, adjacent turns of one role are merged by slices of the sorted array, and the pieces are concatenated:

    [INST]role[/INST]first text<s>second text of the same role</s>[INST]next role[/INST]...</s>

A mark that occurs in a role or a text is broken by a backslash after its first character, and a backslash is doubled, so no text can end a turn or begin one, and taking the backslashes out
gives the text back.  Marks neither hold nor overlap one another (``Template`` checks it), so splitting the output at its marks is exact.

The loss mask is a list of spans (start, size) in UTF-8 bytes of the formatted conversation, one for each text of a learnt role, without the marks around it.

Defined cases: a null text and a null role are empty ones; turns stand in the order of ``turn``, nulls first, equal ones by role, then by escaped text; repeated rows are turns of their own; rows with null
conv_id are one conversation; an empty table gives no rows; other columns are never read.  A conversation is one value, so its turns meet in one row (2 GB at most, as any string of Spark); rows are escaped
before they are dealt out and collected partially where they are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkloom.llm.common import read_table

#: of a running sum: so many values are summed one by one, then the sums of such runs
RUN = 256


@dataclass(frozen=True)
class Template:
    head: str = "[INST]"
    body: str = "[/INST]"
    then: str = "<s>"
    end: str = "</s>"
    reserved: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def __post_init__(self):
        for a in self.marks:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"a mark has two characters or more and no backslash: {a}")
        for a, b in permutations(self.marks, 2):
            if a in b or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"marks hold or overlap one another: {a}, {b}")
        if any(a.endswith(a[:k]) for a in self.marks for k in range(1, len(a))):
            raise ValueError("a mark overlaps itself")

    @property
    def marks(self) -> tuple[str, ...]:
        return (self.head, self.body, self.then, self.end, *self.reserved)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


def escaped(text: Column, template: Template) -> Column:
    marks = "|".join(_quoted(m) for m in template.marks)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"(?s)(?={marks})(.)", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _summed(values: Column) -> Column:
    """total, and the running sums, of a short array."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("sums"))
    return F.aggregate(values, zero, lambda a, v: F.struct((a["total"] + v).alias("total"), F.array_append(a["sums"], a["total"] + v).alias("sums")))


def with_running(df: DataFrame, values: str, name: str) -> DataFrame:
    """Running sums of an array of longs, in two levels: an array grows by copies, so long ones are summed in runs."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest((F.size(values) - 1), F.lit(0)), F.lit(RUN)), lambda at: _summed(F.slice(F.col(values), at + 1, RUN)))
    df = df.withColumn("__runs", cut)
    df = df.withColumn("__before", _summed(F.transform("__runs", lambda r: r["total"]))["sums"])
    sums = F.transform("__runs", lambda r, k: F.transform(r["sums"], lambda s: s + F.when(k == 0, F.lit(0).cast("long")).otherwise(F.col("__before")[k - 1])))
    return df.withColumn(name, F.flatten(sums)).drop("__runs", "__before")


def formatted(rows: DataFrame, template: Template = Template(), learnt: tuple[str, ...] = ("assistant",), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, and loss: array of (start, size) in UTF-8 bytes of ``formatted``."""
    empty, t = F.lit(""), template
    own = rows.select(
        F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), escaped(F.coalesce(role, empty), t).alias("role"), escaped(F.coalesce(text, empty), t).alias("text"), F.coalesce(F.col(role).isin(*learnt), F.lit(False)).alias("learnt")).alias("one"),
    )
    df = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    at = lambda i: F.col("turns")[i]
    begins = lambda i: (i == 0) | (at(i)["role"] != at(i - 1)["role"])
    df = df.withColumn("firsts", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), begins))
    after = lambda k: F.when(k + 1 < F.size("firsts"), F.col("firsts")[k + 1]).otherwise(F.size("turns"))
    merged = F.transform("firsts", lambda i, k: F.struct(at(i)["role"].alias("role"), F.transform(F.slice("turns", i + 1, after(k) - i), lambda x: x["text"]).alias("texts")))
    block = lambda b: F.concat(F.lit(t.head), b["role"], F.lit(t.body), F.array_join(b["texts"], t.then), F.lit(t.end))
    size = lambda s: len(s.encode())
    lead = lambda x, i: F.when(begins(i), F.when(i == 0, 0).otherwise(size(t.end)) + size(t.head) + F.octet_length(x["role"]) + size(t.body)).otherwise(size(t.then))
    df = df.withColumns({"merged": merged, "sizes": F.transform("turns", lambda x, i: (lead(x, i) + F.octet_length(x["text"])).cast("long"))})
    df = with_running(df, "sizes", "ends").withColumn("formatted", F.array_join(F.transform("merged", block), ""))
    spans = F.transform("turns", lambda x, i: F.struct(x["learnt"].alias("learnt"), (F.col("ends")[i] - F.octet_length(x["text"])).cast("int").alias("start"), F.octet_length(x["text"]).alias("size")))
    loss = F.transform(F.filter(spans, lambda s: s["learnt"]), lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size")))
    return df.select("conv_id", "formatted", loss.alias("loss"))


def read_back(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, turns (role, text) and learnt (the texts under the loss mask, unescaped), from ``formatted`` and ``loss`` alone."""
    blocks = F.split("formatted", _quoted(template.end))
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)
    parts = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(template.head) + 1)), _quoted(template.body)))
    one = lambda p: F.transform(F.split(p[1], _quoted(template.then)), lambda x: F.struct(unescaped(p[0]).alias("role"), unescaped(x).alias("text")))
    spans = lambda whole: F.transform("loss", lambda s: unescaped(F.substring(whole, s["start"] + 1, s["size"]).cast("string")))
    df = chats.withColumn("parts", parts)
    learnt = F.transform(F.array(F.col("formatted").cast("binary")), spans)[0]  # the bytes are taken once
    return df.select("conv_id", "formatted", F.flatten(F.transform("parts", one)).alias("turns"), learnt.alias("learnt"))


#: rows that every run formats besides the table's: they hold the template's own marks
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the extra one, formatted and read back."""
    extra = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({c}L, {n}L, '{r}', '{t}')" for c, n, r, t in EXTRA) + " AS t(conv_id, turn, role, text)")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    back = read_back(formatted(rows))
    df = back.withColumns({"told": F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "lost": F.array_join("learnt", "")})
    return df.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("told", 256).alias("turns_sha256"), F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql() -> str:
    t = Template()
    short = "replace({0}, chr(92), chr(92) || chr(92))"
    for m in t.marks:
        short = f"replace({short}, '{m}', '{m[0]}' || chr(92) || '{m[1:]}')"
    values = ", ".join(f"({c}, {n}, '{r}', '{x}')" for c, n, r, x in EXTRA)
    first = len(t.head) + len(t.body) + len(t.end)
    return f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {values}))),
e AS (SELECT *, {short.format("role")} AS role_e, {short.format("text")} AS text_e FROM r),
s AS (SELECT *, lag(role) OVER w AS last_role FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role_e, text_e))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role_e, text_e)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role_e, text_e) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text_e) + CASE WHEN last_role IS DISTINCT FROM role THEN {first} + length(role_e) ELSE {len(t.then)} END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""


ORACLE_SQL = _sql()
