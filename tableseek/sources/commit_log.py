"""A versioned table in a folder: data folders are staged freely, one small entry a version says which of them count.

``_log/<version>.json`` names the folders of a version with counts and parameters. An entry is written beside its name
and renamed to it without overwriting, so a version exists whole or not at all, two writers cannot both make it, and a
writer that dies leaves the version before it readable. Readers resolve the newest entry; staged folders that no entry
names are invisible and can be removed by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class CommitConflict(RuntimeError):
    """Another writer made this version first."""


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._fs_path, conf = hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
        home = self._fs_path(self.path)
        self._fs = home.getFileSystem(conf)
        self._files = hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 0)

    def _entry(self, version: int):
        return self._fs_path(f"{self.path}/_log/{version:020d}.json")

    def versions(self) -> list[int]:
        folder = self._fs_path(f"{self.path}/_log")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int) -> dict[str, Any]:
        stream = self._fs.open(self._entry(version))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def latest(self) -> dict[str, Any] | None:
        """The newest entry; its ``version`` counts from 1."""
        versions = self.versions()
        return self.read(versions[-1]) if versions else None

    def stage(self, label: str) -> str:
        """Name of a data folder of its own, relative to the table; it counts from the commit that names it."""
        return f"{label}-{uuid.uuid4().hex}"

    def full(self, folder: str) -> str:
        return f"{self.path}/{folder}"

    def commit(self, content: dict[str, Any], after: int) -> int:
        """Makes version ``after`` + 1, which must not exist."""
        version = after + 1
        staged = self._fs_path(f"{self.path}/_log/.{version}-{uuid.uuid4().hex}")
        stream = self._fs.create(staged, False)
        try:
            stream.write(bytearray(json.dumps({**content, "version": version}, sort_keys=True).encode()))
        finally:
            stream.close()
        try:
            self._files.rename(staged, self._entry(version), self._no_options)
        except Exception as error:
            self._fs.delete(staged, False)
            if version in self.versions():
                raise CommitConflict(f"version {version} of {self.path} exists already") from error
            raise
        return version

    def load(self, folders: list[str], schema: str | None = None) -> DataFrame:
        """Rows of several data folders; each may be partitioned in itself."""
        found = None
        for folder in folders:
            reader = self.spark.read if schema is None else self.spark.read.schema(schema)
            rows = reader.parquet(self.full(folder))
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            raise ValueError(f"{self.path} names no folder")
        return found

    def vacuum(self, keep: set[str]) -> list[str]:
        """Removes the data folders that are not named; the caller knows that no writer is at work."""
        home, gone = self._fs_path(self.path), []
        for status in self._fs.listStatus(home):
            name = status.getPath().getName()
            if name != "_log" and name not in keep:
                self._fs.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)
