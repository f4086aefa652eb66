"""Helpers shared by the operators: table reads and Arrow batches; shared storage is that of the library."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from sparkloom.operators.storage import cut, new_path, remove, shared_dir, small_batches  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column, without Python strings; a null is an empty span."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    buffers = column.buffers()
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    if column.null_count:
        # spans of nulls are empty in practice; make sure of it by compaction
        lengths = np.diff(offsets)
        gone = ~np.asarray(column.is_valid())
        if lengths[gone].any():
            keep = np.repeat(~gone, lengths)
            data = data[offsets[0] : offsets[-1]][keep]
            lengths = np.where(gone, 0, lengths)
            offsets = np.concatenate(([0], np.cumsum(lengths)))
    return data, offsets


def slices_by_bytes(offsets: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (or one longer row), covering all rows."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


def append(docs: DataFrame, column: str, compute: Callable[[pa.Array], object], name: str, kind: str) -> DataFrame:
    """``docs`` with one more column, computed in Arrow batches from ``column``; all others pass through as they are."""
    at = docs.columns.index(column)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = compute(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, new if isinstance(new, pa.Array) else pa.array(new)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def batch_of(names: Iterable[str], arrays: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names=list(names))
