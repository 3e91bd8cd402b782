"""SQLite index files as a Spark data source: spark.read.format("library_sqlite").option("path", ...).option("table", ...).load().

The driver reads the schema and the range of row ids; each partition reads a range on its own connection, read-only. The file must be in a
place that all executors see.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 200_000


def _kind(declared: str) -> str:
    """Spark type by SQLite's rules of affinity."""
    d = (declared or "").upper()
    if "INT" in d:
        return "bigint"
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return "string"
    if "BLOB" in d or not d:
        return "binary"
    return "double"


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class LibrarySqlite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "library_sqlite"

    def schema(self) -> str:
        with connect(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_xinfo({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{c[1]}` {_kind(c[2])}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rows", ROWS))
        self.columns = [(f.name, f.dataType.typeName()) for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [InputPartition((0, -1))]
        return [InputPartition((at, min(high, at + self.rows - 1))) for at in range(low, high + 1, self.rows)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        low, high = partition.value
        names = ", ".join(_quoted(n) for n, _ in self.columns)
        db = connect(self.path)
        try:
            for row in db.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (low, high)):
                yield tuple(_cast(v, kind) for v, (_, kind) in zip(row, self.columns))
        finally:
            db.close()


def _cast(value, kind: str):
    """SQLite columns may hold any type; what doesn't fit the declared one becomes null."""
    try:
        if value is None:
            return None
        if kind == "long":
            return int(value)
        if kind == "double":
            return float(value)
        if kind == "string":
            return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
        return value if isinstance(value, bytes) else str(value).encode()
    except (TypeError, ValueError):
        return None


def read_sqlite(spark: SparkSession, path: str, table: str, rows: int = ROWS) -> DataFrame:
    spark.dataSource.register(LibrarySqlite)
    return spark.read.format("library_sqlite").option("path", path).option("table", table).option("rows", str(rows)).load()


def attach(spark: SparkSession, path: str, alias: str) -> list[str]:
    """Temp views alias_table of all tables of a file; their names."""
    with connect(path) as db:
        tables = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    for table in tables:
        read_sqlite(spark, path, table).createOrReplaceTempView(f"{alias}_{table}")
    return [f"{alias}_{t}" for t in tables]


def detach(spark: SparkSession, alias: str, tables: list[str]) -> None:
    for name in tables:
        spark.catalog.dropTempView(name)


def write_sqlite(df: DataFrame, path: str, table: str, key: str | None = None) -> int:
    """Append rows to a table of a local file, on the driver, row by row as they come; returns how many were written. A file is one
    writer's: this is an export, not a store for large tables."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "string": "TEXT", "binary": "BLOB", "boolean": "INTEGER"}
    columns = ", ".join(f"{_quoted(c)} {kinds.get(k, 'REAL')}" + (" PRIMARY KEY" if c == key else "") for c, k in df.dtypes)
    n = 0
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE IF NOT EXISTS {_quoted(table)} ({columns})")
        marks = ", ".join("?" * len(df.columns))
        for row in df.toLocalIterator(prefetchPartitions=True):
            db.execute(f"INSERT OR REPLACE INTO {_quoted(table)} VALUES ({marks})", tuple(bytes(v) if isinstance(v, bytearray) else v for v in row))
            n += 1
    db.close()
    return n
