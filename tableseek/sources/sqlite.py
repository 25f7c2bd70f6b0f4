"""SQLite files as a Spark data source: rows, tables, columns, keys.

One input partition per database table (rows) or database file (catalog), so the reading
spreads over the executors; filters on db_id and table_name prune partitions.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMAS = {
    "rows": "db_id string, table_name string, rowid bigint, values map<string, string>",
    "tables": "db_id string, table_name string",
    "columns": "db_id string, table_name string, position int, column_name string, declared_type string, is_primary_key boolean",
    "fks": "db_id string, child string, parent string, fk_id int, seq int, child_column string, parent_column string",
}


def local_path(uri: str) -> str:
    parsed = urlparse(uri)
    return unquote(parsed.path) if parsed.scheme == "file" else uri


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _connect(path: str) -> sqlite3.Connection:
    if not Path(path).exists():
        raise FileNotFoundError(path)
    connection = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    connection.text_factory = lambda raw: raw.decode("utf-8", errors="replace")
    return connection


def _tables(connection: sqlite3.Connection) -> list[str]:
    query = "SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name"
    return [r[0] for r in connection.execute(query)]


@dataclass
class FilePart(InputPartition):
    db_id: str
    path: str
    table: str | None = None


class SQLiteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.what = options.get("what", "rows")
        self.files = [line.split("=", 1) for line in options["files"].split("\n") if line]
        self.dbs: set[str] | None = None
        self.names: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if column not in ("db_id", "table_name") or (column == "table_name" and self.what == "fks"):
                yield f
                continue
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            current = self.dbs if column == "db_id" else self.names
            merged = wanted if current is None else current & wanted
            if column == "db_id":
                self.dbs = merged
            else:
                self.names = merged

    def partitions(self) -> list[InputPartition]:
        parts = []
        for db_id, path in self.files:
            if self.dbs is not None and db_id not in self.dbs:
                continue
            if self.what != "rows":
                parts.append(FilePart(db_id, path))
                continue
            connection = _connect(path)
            names = [t for t in _tables(connection) if self.names is None or t in self.names]
            connection.close()
            parts += [FilePart(db_id, path, t) for t in names]
        return parts or [FilePart("", "")]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        if not partition.path:
            return
        connection = _connect(partition.path)
        try:
            if self.what == "rows":
                yield from self._rows(connection, partition)
            else:
                for table in _tables(connection):
                    if self.names is None or table in self.names:
                        yield from getattr(self, f"_{self.what}")(connection, partition.db_id, table)
        finally:
            connection.close()

    def _rows(self, connection: sqlite3.Connection, part: FilePart) -> Iterator[tuple]:
        table = _quoted(part.table)
        try:
            cursor = connection.execute(f"SELECT rowid, * FROM {table}")
            keyed = True
        except sqlite3.OperationalError:  # tables without a row id
            cursor, keyed = connection.execute(f"SELECT * FROM {table}"), False
        names = [c[0] for c in cursor.description][1 if keyed else 0:]
        for position, row in enumerate(cursor):
            key, values = (row[0], row[1:]) if keyed else (position, row)
            yield part.db_id, part.table, key, {n: None if v is None else str(v) for n, v in zip(names, values, strict=True)}

    def _tables(self, connection: sqlite3.Connection, db_id: str, table: str) -> Iterator[tuple]:
        yield db_id, table

    def _columns(self, connection: sqlite3.Connection, db_id: str, table: str) -> Iterator[tuple]:
        for position, name, declared, _, _, key in connection.execute(f"PRAGMA table_info({_quoted(table)})"):
            yield db_id, table, position, name, declared, bool(key)

    def _fks(self, connection: sqlite3.Connection, db_id: str, table: str) -> Iterator[tuple]:
        for fk_id, seq, parent, child_column, parent_column, *_ in connection.execute(
            f"PRAGMA foreign_key_list({_quoted(table)})"
        ):
            yield db_id, table, parent, fk_id, seq, child_column, parent_column


class SQLiteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_files"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "rows")]

    def reader(self, schema) -> SQLiteReader:
        return SQLiteReader(dict(self.options))


def read_sqlite(spark: SparkSession, files: dict[str, str], what: str = "rows") -> DataFrame:
    """files maps db_id to a path every executor can open; what is rows, tables, columns or fks."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SQLiteSource)
    listing = "\n".join(f"{db}={local_path(path)}" for db, path in files.items())
    return spark.read.format("sqlite_files").option("what", what).option("files", listing).load()


def resolved_foreign_keys(fks: DataFrame, columns: DataFrame) -> DataFrame:
    """Foreign keys whose implicit parent columns are filled from the parent's primary key."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    order = Window.partitionBy("db_id", "table_name").orderBy("position")
    keys = columns.filter("is_primary_key").select(
        "db_id", F.col("table_name").alias("parent"), (F.row_number().over(order) - 1).alias("seq"), F.col("column_name").alias("_pk")
    )
    joined = fks.join(keys, ["db_id", "parent", "seq"], "left")
    return joined.withColumn("parent_column", F.coalesce("parent_column", "_pk")).drop("_pk")
