"""Read-only scans of database files, a range of keys in each task."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FETCH = 5_000


def _open(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    db.execute("PRAGMA query_only = 1")
    return db


def _names(schema: T.StructType) -> str:
    return ", ".join('"' + f.name.replace('"', '""') + '"' for f in schema.fields)


class KeyRange(InputPartition):
    """Keys from ``low`` to ``high``, both included; None: no key at all."""

    def __init__(self, low: int | None, high: int | None):
        super().__init__((low, high))
        self.low, self.high = low, high


class QueryReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.query, self.key = schema, options["path"], options["query"], options.get("key")
        self.parts = int(options.get("parts", 8))

    def partitions(self) -> list[KeyRange]:
        """Equal ranges between the least and the greatest key, and the rows without one; one range of everything where there is no key."""
        if not self.key:
            return [KeyRange(None, None)]
        with _open(self.path) as db:
            low, high = db.execute(f'SELECT min("{self.key}"), max("{self.key}") FROM ({self.query})').fetchone()
        if low is None:
            return [KeyRange(None, None)]
        if not isinstance(low, int) or not isinstance(high, int):
            raise ValueError(f"{self.key} is no integer key")
        n = min(self.parts, high - low + 1)
        cuts = [low + (high - low + 1) * i // n for i in range(n + 1)]
        return [*(KeyRange(a, b - 1) for a, b in zip(cuts, cuts[1:])), KeyRange(None, None)]

    def read(self, partition: KeyRange):
        text = f"SELECT {_names(self.schema)} FROM ({self.query})"
        values: tuple = ()
        if partition.low is not None:
            text, values = f'{text} WHERE "{self.key}" BETWEEN ? AND ?', (partition.low, partition.high)
        elif self.key:
            text = f'{text} WHERE "{self.key}" IS NULL'
        with _open(self.path) as db:
            cursor = db.execute(text, values)
            while rows := cursor.fetchmany(FETCH):
                yield from rows


class QuerySource(DataSource):
    """Options: path, query (a SELECT), key (an integer column of its result) and parts."""

    @classmethod
    def name(cls) -> str:
        return "sparkloom_query"

    def reader(self, schema: T.StructType) -> QueryReader:
        return QueryReader(schema, dict(self.options))


def read_query(spark: SparkSession, path: str, query: str, schema: str, key: str | None = None, parts: int | None = None) -> DataFrame:
    """Rows of a SELECT on a database file that the driver and all executors can open, read-only.

    ``key``: an integer column of the result; its range is cut into ``parts`` (the session's parallelism by default), each read by a task of its own through the database's index, and rows without a key by
    one more.  Without a key a single task reads everything.  Values come out as the file has them: the schema's types must fit.
    """
    if not query.lstrip().lower().startswith("select"):
        raise ValueError("only SELECT is allowed")
    spark.dataSource.register(QuerySource)
    kind = T._parse_datatype_string(schema)
    if key and key not in kind.fieldNames():
        raise ValueError(f"{key} is no column of the result")
    options = {"path": path, "query": query.rstrip().rstrip(";"), "parts": str(parts or spark.sparkContext.defaultParallelism)} | ({"key": key} if key else {})
    return spark.read.format("sparkloom_query").schema(kind).options(**options).load()
