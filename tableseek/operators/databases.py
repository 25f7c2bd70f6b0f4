"""Foreign-key consistent samples of many databases with different schemas at once.

Rows are rows(db_id, table_name, rowid, values MAP<STRING, STRING>), foreign keys are
fks(db_id, fk_id, child, parent, child_columns, parent_columns). All databases advance
together, level by level of their foreign-key graphs, so the number of rounds is the
longest chain of any database and not the number of tables.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.functions.hashing import hash_key
from tableseek.operators.ranking import top_k
from tableseek.session import cut_lineage

ROW = ["db_id", "table_name", "rowid"]


def table_levels(tables: DataFrame, fks: DataFrame) -> tuple[DataFrame, int]:
    """Level of every table: parents below children; tables on cycles share one last level."""
    names = cut_lineage(tables.select("db_id", "table_name").distinct())
    edges = fks.filter(F.col("child") != F.col("parent")).select("db_id", F.col("child").alias("table_name"), "parent")
    known = names.withColumnRenamed("table_name", "parent")
    edges = cut_lineage(edges.distinct().join(known, ["db_id", "parent"], "left_semi"))
    done = None
    for level in count():
        waiting, open_edges = names, edges
        if done is not None:
            waiting = names.join(done, ["db_id", "table_name"], "left_anti")
            placed = done.select("db_id", F.col("table_name").alias("parent"))
            open_edges = edges.join(placed, ["db_id", "parent"], "left_anti")
        ready = waiting.join(open_edges, ["db_id", "table_name"], "left_anti")
        ready = cut_lineage(ready.withColumn("level", F.lit(level)))
        if ready.isEmpty():
            rest = waiting.withColumn("level", F.lit(level))
            return (rest if done is None else done.unionByName(rest)), level
        done = ready if done is None else done.unionByName(ready)


def _key(columns: str) -> Column:
    return F.transform(columns, lambda c: F.try_element_at("values", c))


def _no_null(key: str) -> Column:
    return ~F.exists(key, lambda v: v.isNull())


def _references(rows: DataFrame, fks: DataFrame) -> DataFrame:
    """One row per (row, outgoing foreign key) whose key has no NULL component."""
    outgoing = fks.select("db_id", "fk_id", F.col("child").alias("table_name"), "child_columns")
    keyed = rows.join(outgoing, ["db_id", "table_name"]).select(*ROW, "fk_id", _key("child_columns").alias("_key"))
    return keyed.filter(_no_null("_key"))


def _parent_keys(rows: DataFrame, fks: DataFrame) -> DataFrame:
    incoming = fks.select("db_id", "fk_id", F.col("parent").alias("table_name"), "parent_columns")
    keyed = rows.join(incoming, ["db_id", "table_name"]).select("db_id", "fk_id", _key("parent_columns").alias("_key"))
    return keyed.filter(_no_null("_key")).distinct()


def dangling_rows(rows: DataFrame, parents: DataFrame, fks: DataFrame) -> DataFrame:
    """Keys of rows with a non-null reference that no parent row answers."""
    unanswered = _references(rows, fks).join(_parent_keys(parents, fks), ["db_id", "fk_id", "_key"], "left_anti")
    return unanswered.select(*ROW).distinct()


def sample_databases(rows: DataFrame, fks: DataFrame, max_rows: int, seed: int = 42) -> tuple[DataFrame, int]:
    """At most max_rows rows per table, closed under all foreign keys; and the pruned count.

    Every finished level is checkpointed. A sampled table holds at most max_rows rows, so
    the parent keys of a level are bounded by tables x max_rows.
    """
    levels, last = table_levels(rows.select("db_id", "table_name").distinct(), fks)
    leveled = rows.join(levels, ["db_id", "table_name"])
    parent_level = levels.select("db_id", F.col("table_name").alias("parent"), F.col("level").alias("_pl"))
    child_level = levels.select("db_id", F.col("table_name").alias("child"), F.col("level").alias("_cl"))
    ranked_fks = cut_lineage(fks.join(parent_level, ["db_id", "parent"]).join(child_level, ["db_id", "child"]))
    sampled = None
    for level in range(last + 1):
        current = leveled.filter(F.col("level") == level).drop("level")
        usable = ranked_fks.filter((F.col("_cl") == level) & (F.col("_pl") < level))
        if sampled is not None:
            current = current.join(dangling_rows(current, sampled, usable), ROW, "left_anti")
        hashed = current.withColumn("_h", hash_key("db_id", "table_name", "rowid", seed=seed))
        step = top_k(hashed, ["db_id", "table_name"], ["_h", "rowid"], max_rows, rank="_r").drop("_h", "_r")
        step = cut_lineage(step)
        sampled = step if sampled is None else sampled.unionByName(step)
    return prune(sampled, fks)


def prune(sampled: DataFrame, fks: DataFrame) -> tuple[DataFrame, int]:
    """Drop rows with unanswered references until none is left."""
    removed = 0
    while True:
        bad = cut_lineage(dangling_rows(sampled, sampled, fks))
        n = bad.count()
        if n == 0:
            return sampled, removed
        removed += n
        sampled = cut_lineage(sampled.join(bad, ROW, "left_anti"))


def emit_tables(sampled: DataFrame, columns: DataFrame, fks: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Nested tables out of sampled rows; a requested table without rows keeps empty columns.

    columns(db_id, table_name, position, column_name). Cells are cleaned, NULL becomes
    the empty string. At most max_rows rows and the table's columns are gathered.
    """
    children = fks.select("db_id", F.col("child").alias("table_name"), F.explode("child_columns").alias("column_name")).distinct()
    flagged = columns.join(children.withColumn("_fk", F.lit(True)), ["db_id", "table_name", "column_name"], "left")
    shapes = flagged.groupBy("db_id", "table_name").agg(
        F.array_sort(
            F.collect_list(F.struct("position", F.col("column_name").alias("name"), F.coalesce("_fk", F.lit(False)).alias("fk")))
        ).alias("_cols")
    )
    if requested is not None:
        shapes = requested.select("db_id", "table_name").distinct().join(shapes, ["db_id", "table_name"], "left")
    gathered = sampled.groupBy("db_id", "table_name").agg(
        F.array_sort(F.collect_list(F.struct("rowid", F.map_entries("values").alias("e")))).alias("_rows")
    )
    joined = shapes.join(gathered, ["db_id", "table_name"], "left")
    rows = F.coalesce("_rows", F.array().cast("array<struct<rowid: bigint, e: array<struct<key: string, value: string>>>>"))
    cols = F.coalesce("_cols", F.array().cast("array<struct<position: int, name: string, fk: boolean>>"))
    nested = F.transform(
        cols,
        lambda c: F.struct(
            c["name"].alias("header"),
            F.transform(rows, lambda r: T.clean_text(F.try_element_at(F.map_from_entries(r["e"]), c["name"]))).alias("cells"),
            c["fk"].alias("is_foreign_key"),
        ),
    )
    return joined.select(
        T.table_id("db_id", "table_name").alias("table_id"), "table_name", nested.alias("columns"),
        F.size(rows).cast("bigint").alias("n_rows"),
    )
