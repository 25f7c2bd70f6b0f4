"""Questions against the catalog: gold resolution, filters, split joins, work lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableseek.functions import text as T


def named_or_all(column: str | Column, names: Sequence[str] | None) -> Column:
    """True for the listed names; without a list for every row."""
    column = F.col(column) if isinstance(column, str) else column
    return column.isin(*names) if names else F.lit(True)


def keep_style(excluded: Sequence[str] = ("Multi-turn Dialogue",)) -> Column:
    """False only for the excluded styles; a NULL style is kept."""
    return ~F.coalesce(F.col("style").isin(*excluded), F.lit(False))


def classify_questions(questions: DataFrame, qrels: DataFrame) -> DataFrame:
    """reason = kept, or why the question is dropped."""
    resolved = qrels.select("query_id").distinct().withColumn("_has", F.lit(True))
    joined = questions.join(resolved, "query_id", "left")
    reason = (
        F.when(T.is_missing("question"), "no_question")
        .when(~keep_style(), "excluded_style")
        .when(F.col("_has").isNull(), "no_tables")
        .otherwise("kept")
    )
    return joined.withColumn("reason", reason).drop("_has")


def resolve_gold(questions: DataFrame, catalog: DataFrame) -> DataFrame:
    """Case-insensitive canonical gold tables, first mention kept, mention order as pos.

    Input questions(query_id, db_id, required_tables), catalog(db_id, table_name).
    The list of one question is short, so its rows meet in one small group.
    """
    mentioned = questions.select("query_id", "db_id", F.posexplode("required_tables").alias("pos", "_name"))
    named = mentioned.withColumn("_low", F.lower(F.trim("_name")))
    actual = catalog.select("db_id", "table_name", F.lower("table_name").alias("_low"))
    found = named.join(actual, ["db_id", "_low"])
    return found.groupBy("query_id", "db_id", "table_name").agg(F.min("pos").alias("pos"))


def resolve_split(split: DataFrame, current: DataFrame) -> DataFrame:
    """Join a stored split to current questions by content; unmatched rows keep NULL ids."""
    keyed = current.select(T.question_key("question", "db_id", "required_tables").alias("query_key"), "query_id")
    stored = split.select(T.question_key("question", "db_id", "required_tables").alias("query_key"), "split")
    first = keyed.groupBy("query_key").agg(F.min("query_id").alias("query_id"))
    return stored.join(first, "query_key", "left")


def cache_misses(strings: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct strings that the cache does not hold yet."""
    return strings.select(key).distinct().join(cache, key, "left_anti")


def merge_cache(current: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Existing entries win over loaded ones."""
    return current.unionByName(loaded.join(current.select(key), key, "left_anti"))


def question_tables(qrels: DataFrame, tables: DataFrame) -> DataFrame:
    """Each question's materialized gold tables, long: one row per (query, table)."""
    return qrels.join(tables, "table_id")
