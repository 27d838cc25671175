"""SQLite tables as a Spark source: ``spark.read.format("sqlite").option("table", "part").load("/shared/*.db")``.

A table is read in ranges of its rowid, so a large file is many tasks and a task holds a batch of rows. Files are opened
read-only where they lie: all executors have to see the folder. Without a schema that of the first file counts; a given
schema prunes columns, and may name ``rowid``. Values are cast to the column's type by SQLite; null stays null. A file
without the table, or a pattern without files, is an error.
"""

from __future__ import annotations

import glob
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions.workers import share_code

#: Rowids of a task, tasks of a file (wider ranges beyond), rows of a batch.
RANGE, MOST_RANGES, BATCH = 1 << 18, 1 << 14, 1 << 12
_CASTS = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(Path(path).resolve().as_uri() + "?mode=ro", uri=True)
    con.text_factory = lambda raw: raw.decode("utf-8", "replace")
    return con


def spark_type(declared: str) -> str:
    """By SQLite's rules of affinity; numeric columns are text, which loses nothing."""
    kind = declared.upper()
    if "INT" in kind:
        return "bigint"
    if any(x in kind for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if "BLOB" in kind or not kind:
        return "binary"
    return "double" if any(x in kind for x in ("REAL", "FLOA", "DOUB")) else "string"


@dataclass
class Range(InputPartition):
    path: str
    low: int | None
    high: int | None


class SQLiteReader(DataSourceReader):
    def __init__(self, paths: list[str], table: str, schema: StructType, size: int):
        self.paths, self.table, self.schema, self.size = paths, table, schema, size

    def partitions(self) -> list[Range]:
        found = []
        for path in self.paths:
            with closing(opened(path)) as con:
                try:
                    low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                except sqlite3.OperationalError as e:
                    if "rowid" not in str(e):
                        raise
                    found.append(Range(path, None, None))  # a table WITHOUT ROWID is one task
                    continue
            if low is not None:
                size = max(self.size, (high - low) // MOST_RANGES + 1)
                found += [Range(path, at, at + size) for at in range(low, high + 1, size)]
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        columns = ", ".join(f"CAST(t.{quoted(f.name)} AS {_CASTS.get(f.dataType.simpleString(), 'TEXT')})" for f in self.schema)
        where, bounds = ("", ()) if partition.low is None else (" WHERE t.rowid >= ? AND t.rowid < ?", (partition.low, partition.high))
        with closing(opened(partition.path)) as con:
            rows = con.execute(f"SELECT {columns or '1'} FROM {quoted(self.table)} AS t{where}", bounds)
            while part := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)


class SQLiteSource(DataSource):
    """Options: path (a file or a pattern), table, rows (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def _paths(self) -> list[str]:
        paths = sorted(glob.glob(self.options["path"]))
        if not paths:
            raise FileNotFoundError(self.options["path"])
        return paths

    def schema(self) -> str:
        with closing(opened(self._paths()[0])) as con:
            columns = con.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']!r}")
        return ", ".join(f"`{c[1]}` {spark_type(c[2])}" for c in columns)

    def reader(self, schema: StructType) -> SQLiteReader:
        return SQLiteReader(self._paths(), self.options["table"], schema, int(self.options.get("rows", RANGE)))


def sqlite_table(spark: SparkSession, path: str, table: str, schema: str | None = None):
    """The DataFrame of a table of one file or of all that match a pattern."""
    share_code(spark)
    spark.dataSource.register(SQLiteSource)
    read = spark.read.format("sqlite").option("table", table)
    return (read.schema(schema) if schema else read).load(path)
