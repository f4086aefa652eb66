"""Leak-free partitions: identities, components, contradictions, duplicates, assignment and audit.

Order: contradictory labels are set aside first, then duplicates, then components are dealt to partitions, so that all records that
share a group, an incident, a repository or a lexical fingerprint stay together.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from sparkloom.functions.text import fingerprint, partition_of, repo_identity, unit_hash
from sparkloom.operators.components import connected_components
from sparkloom.operators.record import validated
from sparkloom.operators.storage import cut
from sparkloom.sources.files import read_numbered, write_document

PARTITIONS = ["train", "validation", "calibration", "test"]


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """A rank of rows by file and place in it, in the same order on every run over the same files; ``df`` reads files of any format.

    Parquet tells a row's place in its file.  Elsewhere rows are read in order inside each split of a file, so the split's place and a number that grows inside it rank them (see ``files.read_numbered`` for line numbers).
    """
    meta = F.col("_metadata")
    try:
        return df.withColumn(name, F.struct(meta["file_path"].alias("file"), meta["row_index"].alias("row")))
    except AnalysisException as e:
        if e.getCondition() != "FIELD_NOT_FOUND":
            raise
    return df.withColumn(name, F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("row")))


def identity_keys(of=F.col, by_repo: bool = True, repo: Column | None = None, fp: Column | None = None) -> Column:
    """Typed keys of a record, its group first; records that share one belong together."""
    none = F.array().cast("array<string>")
    typed = lambda kind, c: F.when(c.isNotNull() & (c != ""), F.array(F.concat(F.lit(kind + ":"), c))).otherwise(none)
    own = repo_identity(of("repo")) if repo is None else repo
    parts = [F.array(F.concat(F.lit("group:"), of("group_id"))), typed("incident", of("incident")), F.transform(F.coalesce(of("incidents"), none), lambda x: F.concat(F.lit("incident:"), x))]
    if by_repo:
        unknown = F.raise_error(F.concat(of("id"), F.lit(": the repository is unknown"))).cast("array<string>")
        parts.append(F.when(own == "", unknown).otherwise(F.array(F.concat(F.lit("repo:"), own))))
    parts.append(F.array(F.concat(F.lit("lex:"), fingerprint(of("code")) if fp is None else fp)))
    return F.array_distinct(F.concat(*parts))


def with_aliases(df: DataFrame, aliases: DataFrame, column: str = "repo", most: int = 1_000_000) -> DataFrame:
    """``column`` replaced by its canonical name (aliases: repo, canonical); a checked small table is broadcast, a larger one joined."""
    known = aliases.select(F.col("repo").alias("__alias"), F.col("canonical").alias("__canonical"))
    known = F.broadcast(known) if known.limit(most + 1).count() <= most else known
    return df.join(known, F.col(column) == F.col("__alias"), "left").withColumn(column, F.coalesce("__canonical", column)).drop("__alias", "__canonical")


def components(keyed: DataFrame, anchor: str = "anchor", keys: str = "keys") -> DataFrame:
    """(key, root) of every identity key: root is the least key of the component."""
    edges, _ = cut(keyed.select(F.col(anchor).alias("a"), F.explode(keys).alias("b")).distinct(), "keys")  # keys are computed once
    alone = edges.select(F.col("a").alias("key")).union(edges.select(F.col("b"))).distinct()
    linked = connected_components(edges)
    return alone.join(linked.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"))


def contradictions(df: DataFrame, fp: str = "fp", label: str = "label") -> DataFrame:
    """Fingerprints with both labels."""
    return df.groupBy(fp).agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo != hi").select(fp)


def best_of_each(df: DataFrame, key: str, score: Column, ordinal: str) -> DataFrame:
    """One row per key: the highest score, the first of equals.  Winners are found by a partial aggregation of (key, score, ordinal), so no task sorts a key's rows."""
    best = df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.struct((-score).alias("s"), F.col(ordinal).alias("o"))).alias("__best"))
    return best.select(*[F.col(key) if c == key else F.col("__best")[c].alias(c) for c in df.columns])


def counted(rows: DataFrame, fp: str = "fp", label: str = "label", ordinal: str = "ordinal") -> DataFrame:
    """split (but for components: by fingerprint alone) and n per label, of narrow rows (fp, label, ordinal), in one aggregation by fingerprint.

    Contradictory fingerprints keep all their rows, the others their best one.
    """
    known = F.col(label).isNotNull()
    one = rows.groupBy(fp).agg(
        F.min(label).alias("lo"), F.max(label).alias("hi"), F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"), F.count_if(~known).alias("nn"),
        F.min_by(label, F.struct((~known).cast("int").alias("s"), F.col(ordinal).alias("o"))).alias("best"),
    )
    aside = F.array(*[F.struct(F.lit("quarantine").alias("split"), F.lit(y).cast("int").alias("label"), F.col(n).alias("n")) for y, n in ((0, "n0"), (1, "n1"), (None, "nn"))])
    part = partition_of(unit_hash(17, F.concat(F.lit("lex:"), fp)))
    kept = F.array(F.struct(part.alias("split"), F.col("best").cast("int").alias("label"), F.lit(1).cast("long").alias("n")))
    rows = one.select(F.inline(F.when(F.col("lo") != F.col("hi"), aside).otherwise(kept)))
    return rows.where("n > 0").groupBy("split", "label").agg(F.sum("n").alias("n"))


def score(has_mate: Column, label: Column, evidence: Column) -> Column:
    return 100 * has_mate.cast("int") + 10 * label.isNotNull().cast("int") + F.when(evidence.isNull(), 0).otherwise(F.size(evidence))


def split_corpus(records: DataFrame, seed: int = 17, by_repo: bool = True, respect_splits: bool = False, aliases: DataFrame | None = None) -> DataFrame:
    """Records with split (a partition or quarantine), split_component and fp; duplicates are left out.

    ``records``: canonical columns and an ``ordinal`` that tells rows apart.  Code is read and fingerprinted once; all decisions are made on a narrow table, which then meets the records by ordinal.
    """
    has_mate = "mate" in records.columns
    df = records.withColumn("__repo", repo_identity(F.col("repo")))
    if aliases is not None:
        df = with_aliases(df, aliases, "__repo")
    fp, mate = fingerprint(F.col("code")), F.col("mate") if has_mate else None
    keys = identity_keys(F.col, by_repo, F.col("__repo"), F.col("fp"))
    evidence = F.col("evidence") if "evidence" in records.columns else F.lit(None).cast("array<int>")
    narrow = df.withColumns({
        "fp": fp, "mate_fp": F.when(mate.isNotNull(), fingerprint(mate["code"])) if has_mate else F.lit(None).cast("string"), "mate_label": mate["label"] if has_mate else F.lit(None).cast("int"),
        "score": score(mate.isNotNull() if has_mate else F.lit(False), F.col("label"), evidence),
    })
    if has_mate:
        keys = F.array_distinct(F.concat(keys, F.when(mate.isNotNull(), identity_keys(lambda n: mate[n], by_repo)).otherwise(F.array().cast("array<string>"))))
    given = F.col("split") if respect_splits else F.lit(None).cast("string")
    narrow, _ = cut(narrow.select("ordinal", "fp", "mate_fp", "label", "mate_label", "score", given.alias("given"), F.concat(F.lit("group:"), F.col("group_id")).alias("anchor"), keys.alias("keys")), "split")
    roots = components(narrow).withColumnRenamed("key", "anchor")
    judged = narrow.select("fp", "label")
    if has_mate:
        judged = judged.union(narrow.where("mate_fp is not null").select("mate_fp", "mate_label"))
    bad = contradictions(judged.where("label is not null"))
    own = narrow.join(bad.withColumn("__own", F.lit(True)), "fp", "left")
    aside = F.coalesce("__own", F.lit(False))
    if has_mate:
        own = own.join(bad.select(F.col("fp").alias("mate_fp"), F.lit(True).alias("__mate")), "mate_fp", "left")
        aside = aside | F.coalesce("__mate", F.lit(False))
    own = own.select("ordinal", "fp", "score", "anchor", aside.alias("aside"))
    kept = best_of_each(own.where("not aside"), "fp", F.col("score"), "ordinal").unionByName(own.where("aside"))
    placed = kept.join(roots, "anchor")
    part = partition_of(unit_hash(seed, F.col("root")))
    if respect_splits:
        told = narrow.where("given is not null").join(roots, "anchor").groupBy("root").agg(F.min("given").alias("given"), F.max("given").alias("__other"))
        overlap = F.raise_error(F.concat(F.lit("given partitions overlap in one component: "), F.col("given"), F.lit(", "), F.col("__other"))).cast("string")
        unknown = F.raise_error(F.concat(F.lit("unknown partition: "), F.col("given"))).cast("string")
        told = told.select("root", F.when(F.col("given") != F.col("__other"), overlap).when(~F.col("given").isin(PARTITIONS), unknown).otherwise(F.col("given")).alias("given"))
        placed = placed.join(told, "root", "left")
        part = F.coalesce("given", part)
    made = placed.select("ordinal", "fp", F.when(F.col("aside"), "quarantine").otherwise(part).alias("split"), F.sha2("root", 256).alias("split_component"))
    return records.drop("fp", "split", "split_component").join(made, "ordinal")


def component_sizes(records: DataFrame, by: str = "split_component") -> DataFrame:
    """components: how many have a record; largest: the most records that one has."""
    return records.groupBy(by).count().agg(F.count(F.lit(1)).alias("components"), F.max("count").alias("largest"))


def leaks(rows: DataFrame, most: int | None = 100) -> DataFrame:
    """key, first_split, first_id, split, id: records whose key was first seen in another partition.

    ``rows``: key, split, id, ordinal.  The first id shown is the latest earlier record of the first partition.  Only keys that occur in several partitions are looked at; their rows are
    range-partitioned by (key, ordinal), so that a very common key is spread over tasks: the latest id inside a range comes from a window, the one of earlier ranges from a row per range.
    """
    spark = rows.sparkSession
    rows, _ = cut(rows.select("key", "split", "id", "ordinal"), "leaks")  # keys are computed once
    first = rows.groupBy("key").agg(F.min_by("split", "ordinal").alias("first_split"), F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo != hi").select("key", "first_split")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    seen, _ = cut(rows.join(first, "key").repartitionByRange(partitions, "key", "ordinal").withColumn("part", F.spark_partition_id()), "leaks")
    own = Window.partitionBy("key", "part").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.last(F.when(F.col("split") == F.col("first_split"), F.col("id")), ignorenulls=True).over(own)
    last = seen.where("split = first_split").groupBy("key", "part").agg(F.max_by("id", "ordinal").alias("last_id"))
    ranges = seen.select("key", "part").distinct().join(last, ["key", "part"], "left")
    before = F.last("last_id", ignorenulls=True).over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    found = seen.withColumn("inside", inside).where("split != first_split").join(ranges.select("key", "part", before.alias("before")), ["key", "part"])
    found = found.select("key", "first_split", F.coalesce("inside", "before").alias("first_id"), "split", "id", "ordinal")
    return found if most is None else found.orderBy("ordinal", "key").limit(most)


def unknown_partitions(records: DataFrame) -> DataFrame:
    """Records without one of the four partitions."""
    return records.where(F.col("split").isNull() | ~F.col("split").isin(PARTITIONS))


def concatenated(*tables: DataFrame) -> DataFrame:
    """All rows of several tables, in their order: the ordinal becomes (table, ordinal); columns that one lacks are null there."""
    out = None
    for i, t in enumerate(tables):
        own = t.withColumn("ordinal", F.struct(F.lit(i).alias("table"), F.col("ordinal").alias("row")))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def audit_report(*tables: DataFrame, by_repo: bool = True, aliases: DataFrame | None = None, most: int = 100) -> dict:
    """passed, and examples (kind, partitions, ids) of records of one identity in different partitions, over all tables; unknown partitions are an error."""
    records = concatenated(*tables)
    wrong = unknown_partitions(records).select("id", "split").first()
    if wrong:
        raise ValueError(f"record {wrong['id']} has no known partition: {wrong['split']}")
    df = records.withColumn("__repo", repo_identity(F.col("repo")))
    if aliases is not None:
        df = with_aliases(df, aliases, "__repo")
    keys = identity_keys(F.col, by_repo, F.col("__repo"))
    if "mate" in records.columns:
        mate = F.col("mate")
        keys = F.array_distinct(F.concat(keys, F.when(mate.isNotNull(), identity_keys(lambda n: mate[n], by_repo)).otherwise(F.array().cast("array<string>"))))
    rows = df.select(F.explode(keys).alias("key"), "split", "id", "ordinal")
    found = [{"kind": r["key"].split(":", 1)[0], "partitions": [r["first_split"], r["split"]], "ids": [r["first_id"], r["id"]]} for r in leaks(rows, most).collect()]
    return {"passed": not found, "examples": found}


def audit(*tables: DataFrame, by_repo: bool = True, aliases: DataFrame | None = None) -> dict:
    """The report; an error if it did not pass."""
    report = audit_report(*tables, by_repo=by_repo, aliases=aliases)
    if not report["passed"]:
        raise ValueError(f"leak: {report['examples'][0]}")
    return report


#: what the partitions do not promise
LIMITATIONS = ("near clones are not looked for", "repository aliases are the caller's", "a function inside a larger file has another fingerprint", "components are dealt by hash, not by date")


def split_files(inputs: list[DataFrame | str], path: str, seed: int = 17, by_repo: bool = True, respect_splits: bool = False, aliases: DataFrame | None = None, schema=None) -> dict:
    """Checked records of all inputs, dealt to partitions and written to a folder for each (an existing target is an error), with a manifest, which is returned.

    ``inputs``: tables of canonical columns and an ordinal, or paths of JSON lines (read by ``schema``, or one that is inferred).  The manifest has the inputs' order, seed, key, and counts: source_rows,
    records of each partition, conflicting_labels_quarantined, lexical_duplicates_removed, and the components of what was dealt to partitions.
    """
    spark = next((t.sparkSession for t in inputs if isinstance(t, DataFrame)), None) or SparkSession.active()
    told = [t if isinstance(t, str) else f"table {i}" for i, t in enumerate(inputs)]
    records = concatenated(*[read_numbered(spark, t, schema) if isinstance(t, str) else t for t in inputs])
    checked, _ = cut(validated(records, keep=["ordinal"]), "records")  # inputs are read and checked once
    out = split_corpus(checked, seed, by_repo, respect_splits, aliases)
    out.drop("ordinal").write.mode("errorifexists").partitionBy("split").parquet(path)
    written, rows = spark.read.parquet(path), checked.count()
    counts = {r["split"]: r["count"] for r in written.groupBy("split").count().collect()}  # five rows
    sizes = component_sizes(written.where("split != 'quarantine'")).first()
    manifest = {
        "inputs": told, "seed": seed, "group_key": "repository, group, incidents and fingerprint" if by_repo else "group, incidents and fingerprint", "respect_source_splits": respect_splits, "source_rows": rows, "records": counts,
        "conflicting_labels_quarantined": counts.get("quarantine", 0), "lexical_duplicates_removed": rows - sum(counts.values()), "components": sizes["components"], "largest_component_records": sizes["largest"] or 0,
        "limitations": list(LIMITATIONS),
    }
    write_document(spark, f"{path}.manifest", manifest)
    return manifest
