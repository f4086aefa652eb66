"""Imports as one call: adapter, filters, limit, checks, counters, records and a manifest.

A release is a table, or a folder of Parquet files that is read in waves: files in the order of their names, WAVE of them at first and more each time, until enough records came out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from sparkloom.operators.record import completed, violations
from sparkloom.operators.storage import remove
from sparkloom.sources import adapters, files
from sparkloom.sources.database import read_query

LICENCE_COLUMNS = ("licenses", "license", "detected_licenses")
LANGUAGE_COLUMNS = ("lang", "language")


def filter_counts(df: DataFrame, allowed: list[str], licence: str | None, language: str | None) -> dict:
    """Columns for scanned, license_filtered and language_filtered (of those with a good licence)."""
    good, known = adapters.licence_ok(df, licence, allowed), adapters.language_ok(language)
    return {"scanned": F.count(F.lit(1)), "license_filtered": F.count_if(~good), "language_filtered": F.count_if(good & ~known)}


def _checked(records: DataFrame) -> DataFrame:
    """Canonical columns with the adapter's own ones besides; a broken record is an error."""
    have = completed(records)
    extra = [c for c in records.columns if c not in have.columns]
    out = completed(records, extra).withColumn("__broken", violations())
    message = F.concat(F.col("id"), F.lit(": "), F.array_join("__broken", ", "))
    return out.where(F.when(F.size("__broken") > 0, F.raise_error(message).cast("boolean")).otherwise(True)).drop("__broken")


def convert(source: DataFrame, path: str, form: str, split: str | None = None, source_hash: str | None = None) -> dict:
    """Records of one of the known formats, written to ``path``; the manifest with source_rows, emitted_rows and labeled_rows is returned."""
    if form not in adapters.ADAPTERS:
        raise ValueError(f"{form} is none of {sorted(adapters.ADAPTERS)}")
    spark, seen, made = source.sparkSession, Observation(), Observation()
    rows = adapters.ADAPTERS[form](source.observe(seen, F.count(F.lit(1)).alias("source_rows")))
    if split:
        rows = rows.withColumn("split", F.lit(split))
    out = _checked(rows).observe(made, F.count(F.lit(1)).alias("emitted_rows"), F.count_if(F.col("label").isNotNull()).alias("labeled_rows"))
    out.write.mode("errorifexists").parquet(path)
    manifest = {"format": form, "split": split, "source_hash": source_hash, "stats": {**seen.get, **made.get}, "license_note": "licences of the sources need a review of their own"}
    files.write_document(spark, f"{path}.manifest", manifest)
    return manifest


#: files of the first wave of a scan; every further wave has GROWTH times as many
WAVE, GROWTH = 2, 4


def release_files(spark: SparkSession, folder: str) -> list[str]:
    """The data files of a mirrored release, in the order of their names."""
    return sorted(spark.read.parquet(folder).inputFiles())


def _plain(path: str) -> str:
    """A file's path, however many slashes follow the scheme."""
    return re.sub(r"^(\w+):/+", r"\1:/", path)


def _records_of(rows: DataFrame, name: str, form: str, allowed: list[str]) -> tuple[DataFrame, dict]:
    """Canonical records of the rows that pass, and the counters of all rows."""
    if form != "code":
        return adapters.ADAPTERS[form](rows), {"scanned": F.count(F.lit(1))}
    licence, language = (next((c for c in names if c in rows.columns), None) for names in (LICENCE_COLUMNS, LANGUAGE_COLUMNS))
    counts = filter_counts(rows, allowed, licence, language)
    return adapters.code(rows.where(adapters.licence_ok(rows, licence, allowed) & adapters.language_ok(language)), name), counts


def scan_release(spark: SparkSession, folder: str, path: str, name: str, form: str, limit: int, allowed: list[str], extra: dict) -> dict:
    """Write the first ``limit`` records, in the order of files and rows, and read no more waves of files than that takes; the counters are those of a scan that stops at the last record.

    A wave is counted by file first (filters and columns are pushed down into the files); a row per file goes to the driver.  Then the files before the last are taken whole, and the last up to the row of the last record.
    """
    names, at, size, left, read = release_files(spark, folder), 0, WAVE, limit, 0
    table = spark.read.schema(spark.read.parquet(folder).schema)
    stats: dict[str, int] = {}
    while at < len(names) and left > 0:
        wave = names[at : at + size]
        read += len(wave)
        rows = table.parquet(*wave)
        own = F.col("_metadata.file_path").alias("file")
        _, counts = _records_of(rows, name, form, allowed)
        passed = F.lit(True)
        if form == "code":
            licence, language = (next((c for c in x if c in rows.columns), None) for x in (LICENCE_COLUMNS, LANGUAGE_COLUMNS))
            passed = adapters.licence_ok(rows, licence, allowed) & adapters.language_ok(language)
        by_file = {_plain(r["file"]): r for r in rows.groupBy(own).agg(F.count_if(passed).alias("emitted"), *[c.alias(n) for n, c in counts.items()]).collect()}  # a row per file of the wave
        whole, last, upto = [], None, None
        for f in wave:
            r = by_file.get(_plain(f))
            if r is None or left <= 0:
                continue
            if r["emitted"] <= left:
                whole.append(f)
                left -= r["emitted"]
                for n in (*counts, "emitted"):
                    stats[n] = stats.get(n, 0) + r[n]
            else:
                last = f
                one = table.parquet(f)
                upto = one.where(passed).select(F.col("_metadata.row_index").alias("row")).orderBy("row").limit(left).agg(F.max("row")).first()[0]
                part = one.where(F.col("_metadata.row_index") <= upto).agg(*[c.alias(n) for n, c in counts.items()]).first()
                for n in counts:
                    stats[n] = stats.get(n, 0) + part[n]
                stats["emitted"] = stats.get("emitted", 0) + left
                left = 0
        for files_, most in ((whole, None), ([last] if last else [], upto)):
            if files_:
                part = table.parquet(*files_)
                part = part if most is None else part.where(F.col("_metadata.row_index") <= most)
                records, _ = _records_of(part, name, form, allowed)
                _checked(records).withColumns(extra).write.mode("append").parquet(path)
        at, size = at + size, size * GROWTH
    return {**stats, "files": len(names), "files_read": read}


def from_release(
    source: DataFrame | str, path: str, name: str, form: str = "code", revision: str | None = None, split: str = "train", limit: int = 20_000, allowed: list[str] | None = None, terms_acknowledged: bool = False
) -> dict:
    """Records of a mirrored release: for code, licences and languages are filtered first; at most ``limit`` records are emitted.

    ``source``: a table, or the folder of the release's files, of which no more are read than ``limit`` takes (see ``scan_release``).
    Error: terms that were not acknowledged, no revision, a limit below 1, code without allowed licences, or nothing left.
    """
    if not terms_acknowledged:
        raise ValueError("review the terms of the release, then acknowledge them")
    if limit <= 0:
        raise ValueError("a positive limit is needed")
    if not revision:
        raise ValueError("a release is imported at a fixed revision")
    if form == "code" and not allowed:
        raise ValueError("code needs a list of allowed licences")
    spark = SparkSession.active() if isinstance(source, str) else source.sparkSession
    told = {"source_revision": F.lit(revision), "upstream_split": F.lit(split)}
    if isinstance(source, str):
        if form == "megavul":
            raise ValueError("a row of this form gives several records; give the release as a table")
        if files.exists(spark, path):
            raise FileExistsError(path)
        seen = scan_release(spark, source, path, name, form, limit, allowed or [], told)
        seen.pop("emitted", None)
    else:
        watch = Observation()
        _, counts = _records_of(source, name, form, allowed or [])
        made, _ = _records_of(source.observe(watch, *[c.alias(n) for n, c in counts.items()]), name, form, allowed or [])
        _checked(made).withColumns(told).limit(limit).write.mode("errorifexists").parquet(path)
        seen = None
    if not files.exists(spark, path):
        raise ValueError("no row passed the checks and filters")
    n = spark.read.parquet(path).count()
    if not n:
        remove(spark, path)
        raise ValueError("no row passed the checks and filters")
    stats = {**(watch.get if seen is None else seen), "emitted": n}
    manifest = {"dataset": name, "revision": revision, "split": split, "stats": stats, "allowed_licences": sorted(a.strip().lower() for a in allowed or [])}
    files.write_document(spark, f"{path}.manifest", manifest)
    return manifest


def from_database(spark: SparkSession, database: str, path: str, query: str, schema: str, key: str | None = None, parts: int | None = None) -> dict:
    """Unlabelled patch candidates of a SELECT on a database file (id, code, repo, incident, and language, commit_hash, before_change where it yields them).

    ``key``, an integer column of the result, lets ``parts`` tasks read it (see ``database.read_query``).
    """
    rows = adapters.patch_records(read_query(spark, database, query, schema, key, parts))
    _checked(rows).write.mode("errorifexists").parquet(path)
    n = spark.read.parquet(path).count()
    manifest = {"source": "read-only database export", "database_sha256": files.files_hash(spark, f"file://{database}"), "rows": n, "query": query, "labels": "unknown until reviewed"}
    files.write_document(spark, f"{path}.manifest", manifest)
    return manifest
