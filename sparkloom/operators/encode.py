"""Records to model rows: token windows, masks, targets of three states, and graphs anchored in tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from sparkloom.functions.text import kind, kinds_by_char, tiles
from sparkloom.operators.record import FAMILIES, RELATIONS, ROLES, WEAKNESSES
from sparkloom.operators.storage import cut, spread
from sparkloom.operators.tokens import Bytes, byte_offsets  # noqa: F401

PAD, MASK, CLS, SEP = 0, 1, 2, 3
#: ids below are special tokens
FIRST_MASKABLE = 16
SELF = RELATIONS.index("self")


def windows(df: DataFrame, ids: str, length: int) -> DataFrame:
    """A row per run of ``length`` - 2 tokens: window_start, and the framed ids."""
    width = length - 2
    starts = F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1, F.lit(width)))
    # cut inside the generator, so that no window carries all of its record's ids
    framed = lambda s: F.struct(s.alias("window_start"), F.concat(F.array(F.lit(CLS)), F.slice(ids, s + 1, F.lit(width)), F.array(F.lit(SEP))).alias("input_ids"))
    return df.select("*", F.inline(F.transform(starts, framed)))


def fits(ids: str, length: int) -> Column:
    """A supervised record is used whole or not at all."""
    return (F.size(ids) > 0) & (F.size(ids) + 2 <= length)


def supervised(df_columns: list[str]) -> Column:
    """Whether any label, score, weakness, family, evidence, mate or edge evidence is known."""
    known = [F.col(c).isNotNull() for c in ("label", "teacher_probability", "adequate", "mate") if c in df_columns]
    known += [F.coalesce(F.size(c) > 0, F.lit(False)) for c in ("evidence", "cwes", "known_cwes", "family_labels") if c in df_columns]
    if "graph" in df_columns:
        known.append(F.coalesce(F.exists(F.col("graph")["edges"], lambda e: e["evidence"].isNotNull()), F.lit(False)))
    out = F.lit(False)
    for k in known:
        out = out | k
    return out


def overlaps(start: Column, end: Column, a: Column, b: Column) -> Column:
    return (end > a) & (start < b)


def target_mask(offsets: Column, a: Column, b: Column) -> Column:
    return F.transform(offsets, lambda o: overlaps(o["start"], o["end"], a, b))


def bound(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it (a lambda's body is evaluated for each of its elements)."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def token_kinds(code: Column, offsets: Column) -> Column:
    """The kind of the lexeme over each token's first character; 0 for empty tokens."""
    of = lambda kinds: F.transform(offsets, lambda o: F.when(o["end"] > o["start"], F.coalesce(F.get(kinds, o["start"]), F.lit(0))).otherwise(0))
    return bound(kinds_by_char(code), of)


def lexeme_spans(df: DataFrame, key: str, code: str = "code") -> DataFrame:
    """key, start, stop, kind of the lexemes of each text: sums of the lengths of its tiles."""
    # texts are dealt by key before they become many rows, which then stay where they are
    tiles_ = spread(df.select(key, code), key).select(key, F.posexplode(tiles(F.col(code))).alias("pos", "token"))
    stop = F.sum(F.length("token")).over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return tiles_.select(key, (stop - F.length("token")).alias("start"), stop.alias("stop"), kind(F.col("token")).alias("kind")).where("kind != 0")


def evidence_roles(offsets: Column, evidence: Column) -> Column:
    """Per token and role: the value of the last annotation over it, -1 where none says anything."""

    def of_token(o: Column) -> Column:
        hit = F.filter(evidence, lambda e: overlaps(o["start"], o["end"], e["start"], e["end"]) & (o["end"] > o["start"]))
        unknown = F.array(*[F.lit(-1.0).cast("float")] * len(ROLES))
        last = lambda roles, role: F.aggregate(roles, F.lit(-1), lambda acc, r: F.coalesce(F.try_element_at(r, F.lit(role)), acc)).cast("float")
        # annotations over the token are looked up once for all roles
        return bound(F.transform(hit, lambda e: e["roles"]), lambda roles: F.when(F.size(roles) == 0, unknown).otherwise(F.array(*[last(roles, r) for r in ROLES])))

    return F.transform(offsets, of_token)


def weakness_targets(cwes: Column, known: Column, complete: Column) -> Column:
    """1 for weaknesses that the record has, 0 for those known to be absent, -1 for the rest; names without a slot are ignored."""
    none = F.array().cast("array<string>")
    cwes, known, complete = F.coalesce(cwes, none), F.coalesce(known, none), F.coalesce(complete, F.lit(False))
    names = F.array(*[F.lit(f"CWE-{n}") for n in WEAKNESSES])
    return F.transform(names, lambda c: F.when(F.array_contains(cwes, c), 1.0).when(complete | F.array_contains(known, c), 0.0).otherwise(-1.0).cast("float"))


def family_targets(labels: Column) -> Column:
    """1, 0 or -1 (unknown) for each family; slots beyond them and other values are an error."""
    slots = F.sequence(F.lit(0), F.lit(FAMILIES - 1))
    names = [str(i) for i in range(FAMILIES)]
    odd = F.exists(F.map_entries(labels), lambda e: ~e["key"].isin(names) | e["value"].isNull() | ~e["value"].isin(0, 1))
    message = F.concat(F.lit("family labels are 0 or 1 in slots 0 to 11: "), F.to_json(labels))
    own = F.when(F.coalesce(odd, F.lit(False)), F.raise_error(message).cast("map<string,int>")).otherwise(labels)
    return F.transform(slots, lambda i: F.coalesce(F.try_element_at(own, i.cast("string")).cast("float"), F.lit(-1.0).cast("float")))


def relation_index(name: Column) -> Column:
    """Number of a relation given by name or by number; an unknown one is an error."""
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, RELATIONS)), name), F.lit(0)).cast("int") - 1, F.expr("null").cast("int"))
    number = F.try_to_number(name, F.lit("999")).cast("int")
    own = F.coalesce(at, F.when(number.between(0, len(RELATIONS) - 1), number))
    return F.when(own.isNull(), F.raise_error(F.concat(F.lit("unknown relation: "), F.coalesce(name, F.lit("null")))).cast("int")).otherwise(own)


def anchored_nodes(nodes: DataFrame, tokens: DataFrame, most: int = 256) -> DataFrame:
    """rec, i, lo, hi, k: nodes whose span the tokens cover, the ``most`` smallest of each record, numbered.

    ``nodes``: rec, i, a, b; ``tokens``: rec, t, x, y, whose starts and ends don't decrease with t.  A node's tokens are those from the first that ends after its start to the last that starts before its end.  Both
    are found by a sweep over a record's boundaries: nodes and tokens give two rows each, sorted in either direction, whatever the nodes' widths.
    """
    null = lambda kind: F.lit(None).cast(kind)
    kinds = {c: dict((n if c in "iab" else t).dtypes)[c] for n, t in [(nodes, tokens)] for c in ("i", "a", "b", "t", "x", "y")}
    token = tokens.where("y > x").select(
        "rec", F.explode(F.array(F.struct(F.col("x").alias("pos"), F.lit(False).alias("ends")), F.struct(F.col("y").alias("pos"), F.lit(True).alias("ends")))).alias("e"), F.lit(1).alias("kind"), "t", "x", "y",
        *[null(kinds[c]).alias(c) for c in "iab"],
    )
    node = nodes.select(
        "rec", F.explode(F.array(F.struct(F.col("a").alias("pos"), F.lit(False).alias("ends")), F.struct(F.col("b").alias("pos"), F.lit(True).alias("ends")))).alias("e"), F.lit(0).alias("kind"),
        *[null(kinds[c]).alias(c) for c in "txy"], "i", "a", "b",
    )
    events = token.union(node).select("rec", F.col("e.pos").cast("long").alias("pos"), F.col("e.ends").alias("ends"), "kind", "t", "x", "y", "i", "a", "b")
    is_token = F.col("kind") == 1
    running = lambda *order: Window.partitionBy("rec").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at one position nodes come before tokens, in either direction: a token that only touches a node isn't met
    first = F.min(F.when(is_token & F.col("ends"), F.struct("t", "x"))).over(running(F.desc("pos"), "kind"))
    last = F.max(F.when(is_token & ~F.col("ends"), F.struct("t", "y"))).over(running("pos", "kind"))
    met = events.withColumn("first", first).withColumn("last", last).where("kind = 0")
    spans = met.groupBy("rec", "i", "a", "b").agg(F.max(F.when(~F.col("ends"), F.col("first"))).alias("first"), F.max(F.when(F.col("ends"), F.col("last"))).alias("last"))
    spans = spans.where("first.t <= last.t AND first.x <= a AND last.y >= b").select("rec", "i", F.col("first.t").alias("lo"), (F.col("last.t") + 1).alias("hi"))
    w = Window.partitionBy("rec").orderBy(F.col("hi") - F.col("lo"), "lo", "i")
    return spans.withColumn("k", F.row_number().over(w) - 1).where(F.col("k") < most).select("rec", "i", "lo", "hi", "k")


def remapped_edges(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with s and d, the numbers of their ends among the chosen nodes; null where an end was not chosen.  ``edges``: rec, o, src, dst, rel."""
    # a record's chosen nodes (``most`` of ``anchored_nodes`` at most) are one row, so edges meet them by record and stay where their record is
    numbers = chosen.groupBy("rec").agg(F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("long"), "k"))).alias("numbers"))
    of = lambda end: F.try_element_at("numbers", F.col(end).cast("long"))
    return edges.join(numbers, "rec", "left").select("rec", "o", of("src").alias("s"), of("dst").alias("d"), "rel")


def capped_neighbours(remapped: DataFrame, most: int = 16) -> DataFrame:
    """rec, d, s, rel, o, rn: the first ``most`` - 1 different edges into each node, in edge order; one place is the node's own."""
    first = remapped.where("s is not null and d is not null").groupBy("rec", "s", "d", "rel").agg(F.min("o").alias("o"))
    w = Window.partitionBy("rec", "d").orderBy("o")
    return first.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most - 1)


def token_nodes(chosen: DataFrame, fan: int = 4) -> DataFrame:
    """rec, t, k: the first ``fan`` nodes over each token."""
    w = Window.partitionBy("rec", "t").orderBy("k")
    return chosen.select("rec", "k", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("t")).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= fan).drop("rn")


def map_graph(nodes: DataFrame, tokens: DataFrame, edges: DataFrame, most_nodes: int = 256, most_neighbours: int = 16, fan: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chosen nodes, neighbours (with each node's own place first) and nodes over tokens."""
    chosen, _ = cut(anchored_nodes(nodes, tokens, most_nodes), "nodes")  # read by all three
    chosen = spread(chosen, "rec")  # once, where they are few: what follows goes by record
    near = capped_neighbours(remapped_edges(edges, chosen), most_neighbours).select("rec", "d", "s", "rel", "rn")
    own = chosen.select("rec", F.col("k").alias("d"), F.col("k").alias("s"), F.lit(SELF).alias("rel"), F.lit(0).alias("rn"))
    return chosen, own.union(near), token_nodes(chosen, fan)


def span_means(vectors: DataFrame, spans: DataFrame) -> DataFrame:
    """rec, span, mean: the mean of the vectors at [lo, hi); spans over no vector are left out.  ``vectors``: rec, t, vec; ``spans``: rec, span, lo, hi.

    Vectors and both ends of spans pass by in the order of their places while a sum of the record's vectors runs on; a span's mean comes from the sums at its two ends, however wide it is and however many others overlap it.
    Null vectors are none; lengths may differ, and a mean at a place is over the vectors that reach it and have a number there (null without any); what is not finite counts in its own spans only.
    """
    kinds = dict(spans.dtypes)
    v = vectors.select("rec", F.col("t").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(kinds["span"]).alias("span"), F.col("vec").cast("array<double>").alias("vec"))
    ends = F.array(F.struct(F.col("lo").cast("long").alias("at"), F.lit(-1).alias("kind")), F.struct(F.col("hi").cast("long").alias("at"), F.lit(0).alias("kind")))
    s = spans.where("lo < hi").select("rec", F.explode(ends).alias("e"), "span").select("rec", "e.at", "e.kind", "span", F.lit(None).cast("array<double>").alias("vec"))
    events = v.union(s).repartition("rec").sortWithinPartitions("rec", "at", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec, new, count, total = None, True, 0, np.zeros(0)
        # by place in a vector: vectors that reach it, numbers, NaN, positive and negative infinities so far
        seen = np.zeros((5, 0), np.int64)
        for batch in batches:
            recs, kind = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            lists = batch.column(4)
            values, known, offsets, given = lists.values.to_numpy(zero_copy_only=False), np.asarray(lists.values.is_valid()), lists.offsets.to_numpy(), lists.is_valid().to_pylist()
            at, sums, counts, by_place = [], [], [], []
            for i in range(batch.num_rows):
                if new or recs[i] != rec:
                    rec, new, count, total, seen = recs[i], False, 0, np.zeros(0), np.zeros((5, 0), np.int64)
                if kind[i] != 1:
                    at.append(i)
                    sums.append(total.tolist())
                    counts.append(count)
                    by_place.append(seen.ravel().tolist())
                elif given[i]:
                    own, told = values[offsets[i] : offsets[i + 1]], known[offsets[i] : offsets[i + 1]]
                    if len(own) > len(total):
                        total, seen = np.pad(total, (0, len(own) - len(total))), np.pad(seen, ((0, 0), (0, len(own) - len(total))))
                    finite = told & np.isfinite(own)
                    total[: len(own)] += np.where(finite, own, 0.0)
                    seen[:, : len(own)] += np.stack((np.ones(len(own), bool), told, told & np.isnan(own), told & (own == np.inf), told & (own == -np.inf)))
                    count += 1
            rows = pa.array(at, pa.int64())
            columns = [batch.column(0).take(rows), batch.column(3).take(rows), batch.column(2).take(rows), pa.array(sums, pa.list_(pa.float64())), pa.array(counts, pa.int64()), pa.array(by_place, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["rec", "span", "kind", "s", "n", "seen"])

    sums = events.mapInArrow(run, f"rec {dict(vectors.dtypes)['rec']}, span {kinds['span']}, kind int, s array<double>, n long, seen array<long>")
    one = lambda k: F.max(F.when(F.col("kind") == k, F.struct("n", "s", "seen")))
    met = sums.groupBy("rec", "span").agg(one(-1).alias("low"), one(0).alias("high")).withColumn("n", F.col("high.n") - F.col("low.n")).where("n > 0")

    def within(row: int, i: Column) -> Column:
        """How many of the span's vectors count in a row of ``seen`` at a place."""
        of = lambda end: F.coalesce(F.get(F.col(end)["seen"], i + row * F.size(F.col(end)["s"])), F.lit(0))
        return F.when(i < F.size("low.s"), of("high") - of("low")).otherwise(of("high"))

    def mean(x: Column, i: Column) -> Column:
        nan, up, down, n = within(2, i), within(3, i), within(4, i), within(1, i)
        plain = (x - F.coalesce(F.get("low.s", i), F.lit(0.0))) / F.nullif(n, F.lit(0))
        return F.when((nan > 0) | ((up > 0) & (down > 0)), float("nan")).when(up > 0, float("inf")).when(down > 0, float("-inf")).otherwise(plain)

    reached = F.filter(F.transform("high.s", lambda x, i: F.struct(within(0, i).alias("n"), mean(x, i).alias("mean"))), lambda p: p["n"] > 0)
    return met.select("rec", "span", F.transform(reached, lambda p: p["mean"]).alias("mean"))


GRAPH = (
    "struct<spans:array<struct<lo:int,hi:int>>,neighbors:array<array<struct<node:int,relation:int>>>,token_nodes:array<array<int>>,"
    "edges:array<struct<src:int,dst:int,relation:int,evidence:int>>>"
)
DIAGNOSTICS = "struct<graph_nodes_dropped:int,graph_edges_dropped:int,graph_overlaps_dropped:int>"


def _places(groups: np.ndarray) -> np.ndarray:
    """How many earlier elements are of the same group."""
    order = np.argsort(groups, kind="stable")
    sizes = np.unique(groups[order], return_counts=True)[1]
    out = np.empty(len(groups), np.int64)
    out[order] = np.arange(len(groups)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return out


def window_graph(nodes: np.ndarray, edges: np.ndarray, offsets: np.ndarray, length: int, most_nodes: int, most_neighbours: int, fan: int) -> tuple[dict | None, dict]:
    """The part of a graph that one window's tokens carry, and what was dropped.

    ``nodes``: rows of (start, end) in a text of ``length`` characters; ``edges``: rows of (source, target, relation, evidence, -1 unknown); ``offsets``: rows of (start, end) per token, empty ones carry nothing.
    """
    if ((nodes[:, 0] < 0) | (nodes[:, 0] >= nodes[:, 1]) | (nodes[:, 1] > length)).any():
        raise ValueError("a graph node's span is not within its text")
    full = np.flatnonzero(offsets[:, 1] > offsets[:, 0])
    if not len(full):
        return None, {"graph_nodes_dropped": len(nodes)}
    first = np.searchsorted(offsets[full, 1], nodes[:, 0], side="right")
    last = np.searchsorted(offsets[full, 0], nodes[:, 1], side="left") - 1
    met = np.flatnonzero(first <= last)
    held = met[(offsets[full[first[met]], 0] <= nodes[met, 0]) & (offsets[full[last[met]], 1] >= nodes[met, 1])]
    lo, hi = full[first[held]], full[last[held]] + 1
    chosen = np.lexsort((held, lo, hi - lo))[:most_nodes]
    if not len(chosen):
        return None, {"graph_nodes_dropped": len(nodes)}
    lo, hi = lo[chosen], hi[chosen]
    number = np.full(len(nodes), -1)
    number[held[chosen]] = np.arange(len(chosen))
    inside = (edges[:, :2] >= 0) & (edges[:, :2] < len(nodes))
    ends = np.where(inside, number[np.where(inside, edges[:, :2], 0)], -1)
    both = np.flatnonzero((ends >= 0).all(1))
    triples = np.concatenate((ends[both], edges[both, 2:3]), 1)
    fresh = np.sort(np.unique(triples, axis=0, return_index=True)[1]) if len(triples) else np.zeros(0, np.int64)
    kept = fresh[_places(triples[fresh, 1]) < most_neighbours - 1]
    if not np.isin(edges[both[kept], 3], (-1, 0, 1)).all():
        raise ValueError("an edge's evidence is 0, 1 or unknown")
    neighbours: list[list[dict]] = [[{"node": i, "relation": SELF}] for i in range(len(chosen))]
    out = []
    for (src, dst, relation), evidence in zip(triples[kept].tolist(), edges[both[kept], 3].tolist()):
        neighbours[dst].append({"node": src, "relation": relation})
        out.append({"src": src, "dst": dst, "relation": relation, "evidence": evidence})
    widths = hi - lo
    tokens = np.repeat(lo - (np.cumsum(widths) - widths), widths) + np.arange(int(widths.sum()))
    room = _places(tokens) < fan
    token_nodes: list[list[int]] = [[] for _ in range(len(offsets))]
    for t, i in zip(tokens[room].tolist(), np.repeat(np.arange(len(chosen)), widths)[room].tolist()):
        token_nodes[t].append(i)
    spans = [{"lo": a, "hi": b} for a, b in zip(lo.tolist(), hi.tolist())]
    dropped = {"graph_nodes_dropped": len(nodes) - len(chosen), "graph_edges_dropped": len(edges) - len(both) + len(fresh) - len(kept), "graph_overlaps_dropped": int((~room).sum())}
    return {"spans": spans, "neighbors": neighbours, "token_nodes": token_nodes, "edges": out}, dropped


def with_window_graphs(df: DataFrame, out: str, graph: str, offsets: str, length: str, most_nodes: int, most_neighbours: int, fan: int = 4, none: bool = False) -> DataFrame:
    """``df`` with ``out``, a struct of graph and diagnostics (both null without nodes), of the columns ``graph``, ``offsets`` and ``length``.  Edges have their relations as numbers.  ``none``: no row has a graph."""
    at = [df.columns.index(c) for c in (graph, offsets, length)]
    kind = T._parse_datatype_string(f"struct<graph:{GRAPH},diagnostics:{DIAGNOSTICS}>")
    if none:
        return df.withColumn(out, F.struct(F.lit(None).cast(GRAPH).alias("graph"), F.lit(None).cast(DIAGNOSTICS).alias("diagnostics")))
    schema = T.StructType([*df.schema.fields, T.StructField(out, kind)])

    def pairs(rows, *names: str) -> np.ndarray:
        return np.array([[-1 if r[n] is None else r[n] for n in names] for r in rows or ()], np.int64).reshape(-1, len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            found = []
            if batch.column(at[0]).null_count == batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, to_arrow_type(kind))], names=[*batch.schema.names, out])
                continue
            for g, o, n in zip(*(batch.column(i).to_pylist() for i in at)):
                own = drops = None
                if g and g["nodes"]:
                    own, drops = window_graph(pairs(g["nodes"], "start", "end"), pairs(g["edges"], "src", "dst", "type", "evidence"), pairs(o, "start", "end"), n, most_nodes, most_neighbours, fan)
                found.append({"graph": own, "diagnostics": drops})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, to_arrow_type(kind))], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def _side(of, tokens: Column, code_hash: Column, chars: Column, length: int, pretrain: bool) -> dict[str, Column]:
    """Columns of one encoded window of a record; ``of`` gives the record's fields, ``tokens`` the window's start, ids, offsets and kinds, and n, the number of all the record's tokens."""
    zero = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end")))
    span, none = F.coalesce(of("target_span"), F.struct(F.lit(0).alias("start"), chars.alias("end"))), F.array(F.lit(0))
    inner = target_mask(tokens["offsets"], span["start"], span["end"])
    offsets = F.concat(zero, tokens["offsets"], zero)
    unknown = lambda n: F.array(*[F.lit(-1.0).cast("float")] * n)
    known = lambda c, kind: F.lit(-1).cast(kind) if pretrain else F.coalesce(of(c).cast(kind), F.lit(-1).cast(kind))
    edge = F.array(F.lit(False))
    evidence = F.coalesce(of("evidence"), F.array().cast("array<struct<start:int,end:int,roles:map<string,int>>>"))
    graph = of("graph")
    numbered = F.struct(
        graph["nodes"].alias("nodes"),
        F.transform(graph["edges"], lambda e: F.struct(e["src"].alias("src"), e["dst"].alias("dst"), relation_index(e["type"]).alias("type"), e["evidence"].alias("evidence"))).alias("edges"),
    )
    return {
        "id": F.concat(of("id"), F.lit(":window"), tokens["start"].cast("string")) if pretrain else of("id"), "group_id": of("group_id"), "repo": of("repo"), "split": of("split"), "code_hash": code_hash,
        "input_ids": F.concat(F.array(F.lit(CLS)), tokens["ids"], F.array(F.lit(SEP))), "offsets": offsets, "kind_ids": F.concat(none, tokens["kinds"], none),
        "role_ids": F.concat(none, F.transform(inner, lambda x: F.when(x, 1).otherwise(2)), none), "language": F.lower(F.coalesce(of("language"), F.lit("c"))).isin("c++", "cpp").cast("int"),
        "target_mask": F.concat(edge, inner, edge), "label": known("label", "int"), "adequate": known("adequate", "int"), "teacher_probability": known("teacher_probability", "double"),
        "weight": F.coalesce(of("weight"), F.lit(1.0)), "cwe": unknown(len(WEAKNESSES)) if pretrain else weakness_targets(of("cwes"), of("known_cwes"), of("cwe_complete")),
        "family": unknown(FAMILIES) if pretrain else family_targets(of("family_labels")),
        "roles": F.array_repeat(unknown(len(ROLES)), F.size(offsets)) if pretrain else evidence_roles(offsets, evidence),
        "raw_graph": F.when(graph.isNotNull(), numbered), "code_length": chars, "input_was_windowed": F.lit(pretrain) & (tokens["n"] + 2 > length),
    }


def _windows_of(tokens: Column, length: int, pretrain: bool) -> Column:
    """An array of a record's windows, each with its own tokens only: all for pretraining, else the one of a record that fits."""
    part = F.lit(length - 2)

    def cut(t: Column) -> Column:
        n = F.size(t["ids"])
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, part)) if pretrain else F.when((n > 0) & (n + 2 <= length), F.array(F.lit(0)))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(t["ids"], s + 1, part).alias("ids"), F.slice(t["offsets"], s + 1, part).alias("offsets"), F.slice(t["kinds"], s + 1, part).alias("kinds"), n.alias("n")))

    return bound(tokens, cut)


def encode(records: DataFrame, length: int = 512, pretrain: bool = False, tokenizer=None, most_nodes: int = 256, most_neighbours: int = 16, graphs: bool = True) -> DataFrame:
    """Model rows of canonical records: windows when ``pretrain``, whole records that fit and touch their target otherwise.

    Besides the columns of a window: ``roles`` per token, ``graph`` (what the window's tokens carry of the record's graph) with ``diagnostics``, ``window_start``, and for verified pairs ``mate``
    (the other record's row) with ``pair_relation``.  A pair whose mate does not fit is left out.  When ``pretrain`` nothing supervised is kept.  Without ``graphs`` (no record has one) nothing goes through Python.
    """
    if length < 8 or length % 8:
        raise ValueError("length must be a multiple of 8, 8 at least")
    paired = not pretrain and "mate" in records.columns
    mate = F.col("mate") if paired else None
    texts = {"__own": F.col("code")} | ({"__other": mate["code"]} if paired else {})
    df = (tokenizer or Bytes()).tokens(records, texts)
    tokens = lambda n: F.struct(F.col(n)["ids"].alias("ids"), F.col(n)["offsets"].alias("offsets"), token_kinds(texts[n], F.col(n)["offsets"]).alias("kinds"))
    # all tokens of a record are cut to windows inside a generator, so that no later step computes or carries them again
    df = df.withColumns({"__hash": F.sha2("code", 256), "__chars": F.length("code")}).withColumn("__w", F.explode(_windows_of(tokens("__own"), length, pretrain))).drop("__own")
    own = _side(F.col, F.col("__w"), F.col("__hash"), F.col("__chars"), length, pretrain)
    columns = [*[c.alias(n) for n, c in own.items()], F.col("__w.start").alias("window_start")]
    if paired:
        df = df.withColumns({"__mate_hash": F.sha2(mate["code"], 256), "__mate_chars": F.length(mate["code"])}).withColumn("__v", F.explode_outer(_windows_of(tokens("__other"), length, False)))
        df = df.where(mate.isNull() | F.col("__v").isNotNull())
        other = _side(lambda n: mate[n], F.col("__v"), F.col("__mate_hash"), F.col("__mate_chars"), length, False)
        columns += [F.when(mate.isNotNull(), F.struct(*[c.alias(n) for n, c in other.items() if n not in ("raw_graph", "code_length")])).alias("mate"), F.when(mate.isNotNull(), F.col("pair_relation")).alias("pair_relation")]
        columns += [F.when(mate.isNotNull(), other[n]).alias(f"__mate_{n}") for n in ("raw_graph", "code_length", "offsets")]
    df = df.select(*columns)
    touched = lambda c: F.exists(c, lambda x: x)
    if not pretrain:
        df = df.where(touched(F.col("target_mask")))
    if paired:
        df = df.where(F.col("mate").isNull() | touched(F.col("mate")["target_mask"]))
    df = with_window_graphs(df, "__mapped", "raw_graph", "offsets", "code_length", most_nodes, most_neighbours, none=not graphs)
    df = df.withColumns({"graph": F.col("__mapped")["graph"], "diagnostics": F.col("__mapped")["diagnostics"]}).drop("__mapped", "raw_graph", "code_length")
    if paired:
        df = with_window_graphs(df, "__mapped", "__mate_raw_graph", "__mate_offsets", "__mate_code_length", most_nodes, most_neighbours, none=not graphs)
        other = F.col("mate").withField("graph", F.col("__mapped")["graph"]).withField("diagnostics", F.col("__mapped")["diagnostics"])
        df = df.withColumn("mate", F.when(F.col("mate").isNotNull(), other)).drop("__mapped", "__mate_raw_graph", "__mate_offsets", "__mate_code_length")
    return df


def gathered(values: DataFrame, picks: DataFrame) -> DataFrame:
    """The values (rec, k, vec) that picks (rec, place, k) name: rec, place, vec."""
    return picks.join(values, ["rec", "k"]).select("rec", "place", "vec")


def graph_aggregate(edges: DataFrame, values: DataFrame) -> DataFrame:
    """One hop over a graph: rec, d, dim, x, the sum of the neighbours' vectors weighted by the softmax of the scores of the edges into each node.

    ``edges``: rec, d, s, score; ``values``: rec, k, vec.
    """
    scaled = edges.withColumn("w", F.exp(F.col("score") - F.max("score").over(Window.partitionBy("rec", "d"))))
    weights = scaled.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("rec", "d")))
    # a record's vectors are one row: edges meet them where their record is
    own = values.groupBy("rec").agg(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("long"), "vec"))).alias("vecs"))
    met = weights.join(own, "rec").withColumn("vec", F.try_element_at("vecs", F.col("s").cast("long")))
    return met.select("rec", "d", "w", F.posexplode("vec").alias("dim", "v")).groupBy("rec", "d", "dim").agg(F.sum(F.col("w") * F.col("v").cast("double")).alias("x"))
