"""Writers: corpora, checkpoints with resume, manifests, shards and leaderboards."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableseek.session import materialize
from tableseek.sources.commit_log import CommitLog


def write_corpus(docs: DataFrame, path: str) -> None:
    """JSON lines, non-ASCII kept; an existing corpus is never overwritten."""
    docs.write.mode("errorifexists").json(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def write_manifest(values: DataFrame, path: str) -> None:
    values.coalesce(1).write.mode("errorifexists").json(path)


def manifest_differences(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Keys of two manifests(key, value) that differ or exist on one side only."""
    both = stored.select("key", F.col("value").alias("stored")).join(
        expected.select("key", F.col("value").alias("expected")), "key", "full_outer"
    )
    return both.filter(~F.col("stored").eqNullSafe(F.col("expected")))


def check_manifest(stored: DataFrame, expected: DataFrame) -> None:
    different = manifest_differences(stored, expected).limit(20).collect()
    if different:
        raise ValueError(f"metadata differs: {[(r['key'], r['stored'], r['expected']) for r in different]}")


class StagedWriter:
    """An output in parts (epochs, waves of shards, sets of databases) with a commit log.

    A part is written to a folder of its own and appears with one commit, so a writer that dies leaves the parts before
    it; the next one finds out what is there. Parameters are kept in the log, and a run with other ones is refused.
    ``finish`` marks the output complete without moving or rewriting anything.
    """

    def __init__(self, spark: SparkSession, path: str, parameters: dict[str, str]):
        self.spark, self.log = spark, CommitLog(spark, path)
        self.entry = self.log.latest() or {"version": 0, "parameters": parameters, "parts": {}, "complete": False}
        _check_parameters(self.entry["parameters"], parameters)

    @property
    def parts(self) -> dict[str, dict[str, str]]:
        """Folders of each part by table name."""
        return self.entry["parts"]

    def write(self, part: str, tables: dict[str, DataFrame], partition_by: list[str] | None = None) -> None:
        """Tables of a part, side by side, as one version. A part that is there already is left alone."""
        if part in self.parts:
            return
        if self.entry["complete"]:
            raise ValueError(f"{self.log.path} is complete and has no part {part}")
        folders = {}
        for name, rows in tables.items():
            folders[name] = self.log.stage(name)
            held = rows.repartition(*partition_by) if partition_by else rows
            writer = held.write.partitionBy(*partition_by) if partition_by else held.write
            writer.parquet(self.log.full(folders[name]))
        self._commit({**self.entry, "parts": {**self.parts, part: folders}})

    def finish(self, parts: list[str] | None = None, **counts: int) -> None:
        """The completion marker; refused while one of ``parts`` is missing."""
        missing = [p for p in parts or [] if p not in self.parts]
        if missing:
            raise ValueError(f"{self.log.path} lacks {missing}")
        if not self.entry["complete"]:
            self._commit({**self.entry, "complete": True, "counts": counts})

    def table(self, name: str, schema: str | None = None) -> DataFrame | None:
        """Rows of one table over all parts; None where no part has it."""
        folders = [p[name] for p in self.parts.values() if name in p]
        return self.log.load(folders, schema) if folders else None

    def _commit(self, content: dict[str, Any]) -> None:
        self.log.commit(content, self.entry["version"])
        self.entry = self.log.latest()


def _check_parameters(stored: dict[str, str], expected: dict[str, str]) -> None:
    different = sorted(k for k in stored.keys() | expected.keys() if stored.get(k) != expected.get(k))
    if different:
        raise ValueError(f"metadata differs: {[(k, stored.get(k), expected.get(k)) for k in different[:20]]}")


def is_complete(spark: SparkSession, path: str) -> bool:
    return bool((CommitLog(spark, path).latest() or {}).get("complete"))


def read_staged(spark: SparkSession, path: str, expected: dict[str, str], name: str, complete: bool = True) -> DataFrame:
    """One table of a staged output, after its parameters passed the comparison and, by default, once it is complete."""
    entry = CommitLog(spark, path).latest()
    if entry is None or (complete and not entry["complete"]):
        raise ValueError(f"{path} is not complete")
    _check_parameters(entry["parameters"], expected)
    return CommitLog(spark, path).load([p[name] for p in entry["parts"].values() if name in p])


def resume_by_database(
    spark: SparkSession,
    requested: DataFrame,
    build: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    path: str,
    schema: str,
    parameters: dict[str, str],
    max_attempts: int = 1,
) -> DataFrame:
    """Build the databases an output lacks; it is complete once none fails.

    ``build(todo)`` returns rows(db_id, ...) and failures(db_id, error) for the databases asked. Parameters are compared
    with those of earlier runs first. An attempt commits its rows together with the list of databases it finished, those
    without rows too, and none of them is built again. Returns the failures that remain; ``read_staged`` has the rows.
    """
    output = StagedWriter(spark, path, parameters)
    failures = requested.select("db_id").limit(0).withColumn("error", F.lit(""))
    for _ in range(max_attempts):
        if output.entry["complete"]:
            break
        todo, done = requested.select("db_id").distinct(), output.table("done", "db_id string")
        if done is not None:
            todo = todo.join(done, "db_id", "left_anti")
        todo = materialize(todo, "todo")
        built, failures = build(todo)
        failures = materialize(failures, "failures")
        finished = todo.join(failures, "db_id", "left_anti")
        columns = [c.strip().split()[0] for c in schema.split(",")]
        rows = built.select(*columns).join(failures, "db_id", "left_anti")
        output.write(f"attempt {len(output.parts)}", {"rows": rows, "done": finished})
        if failures.isEmpty():
            output.finish()
    return failures


def merge_cache_file(current: DataFrame, path: str, key: str, replace: bool = False) -> DataFrame:
    """Load a stored cache: replace the current one, or fill only keys it lacks."""
    loaded = current.sparkSession.read.parquet(path)
    if replace:
        return loaded
    return current.unionByName(loaded.join(current.select(key), key, "left_anti"))


def write_leaderboard(results: DataFrame, path: str) -> None:
    results.orderBy(F.desc("test_map"), "model").coalesce(1).write.mode("errorifexists").json(path)
