"""Data-quality profiles and audits. All groups are pre-aggregated before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.functions.hashing import hash_key
from tableseek.operators.ranking import range_ordinal


def column_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Wide rows to (column_name, value) as text."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(F.inline(pairs))


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, non-null and distinct values per column in one scan.

    Values are counted per (column, value) first, so a constant column costs one
    row per map task instead of one task for the whole column.
    """
    counted = column_values(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("_n"))
    return counted.groupBy("column_name").agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_nonnull"),
        F.count("value").alias("n_distinct"),
    )


def null_breakdown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(f"_{c}") for c in columns])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"_{c}").alias("n_nonnull")) for c in columns]
    )
    long = counts.select(F.col("_rows").alias("n_rows"), F.inline(pairs))
    pct = F.when(F.col("n_rows") == 0, F.lit(0.0)).otherwise(
        F.round(100.0 * (F.col("n_rows") - F.col("n_nonnull")) / F.col("n_rows"), 4)
    )
    return long.withColumn("null_pct", pct).orderBy(F.desc("null_pct"), "column_name")


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    counted = df.agg(F.count("*").alias("n_rows"), F.count_if(complete).alias("n_complete"))
    pct = F.when(F.col("n_rows") == 0, F.lit(0.0)).otherwise(F.round(100.0 * F.col("n_complete") / F.col("n_rows"), 4))
    return counted.withColumn("complete_pct", pct)


def fully_null_columns(profile: DataFrame, declared: DataFrame) -> DataFrame:
    """Columns with rows but no value, counted by declared type."""
    empty = profile.filter((F.col("n_nonnull") == 0) & (F.col("n_rows") > 0))
    kind = F.upper(F.coalesce("declared_type", F.lit("(none)")))
    return empty.join(declared, "column_name").groupBy(kind.alias("declared_type")).agg(
        F.count("*").alias("n_columns")
    )


def empty_cells(cells: DataFrame) -> DataFrame:
    """Share of empty cells per column, only columns that have any."""
    counted = cells.groupBy("table_id", "col_idx", "header").agg(
        F.count("*").alias("n_cells"), F.count_if(T.is_missing("cell")).alias("n_empty")
    )
    return counted.filter("n_empty > 0").withColumn(
        "empty_pct", F.round(100.0 * F.col("n_empty") / F.col("n_cells"), 4)
    )


def sample_diversity(df: DataFrame, columns: Sequence[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """Distinct values among the first n rows against n random rows; NULL counts as a value."""
    first = df.orderBy(key).limit(n)
    random = df.withColumn("_h", hash_key(key, seed=seed)).orderBy("_h", key).limit(n).drop("_h")

    def distinct(sample: DataFrame, name: str) -> DataFrame:
        values = column_values(sample, columns).distinct()
        return values.groupBy("column_name").agg(F.count("*").alias(name))

    both = distinct(first, "distinct_first").join(distinct(random, "distinct_random"), "column_name")
    gap = (F.col("distinct_random") > 2 * F.col("distinct_first")) & (F.col("distinct_random") > 3)
    return both.withColumn("gap", gap)


def random_values(df: DataFrame, column: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Seeded random values of a column beside its distinct ratio."""
    stats = df.groupBy(column).agg(F.count("*").alias("_n")).agg(
        F.count(column).alias("n_distinct"), F.sum("_n").alias("n_rows")
    )
    ratio = stats.select(F.round(F.col("n_distinct") / F.col("n_rows"), 6)).scalar()
    drawn = df.filter(~T.is_missing(column)).withColumn("_h", hash_key(key, seed=seed)).orderBy("_h", key).limit(n)
    return drawn.select(key, F.col(column).alias("value"), ratio.alias("distinct_ratio"))


def size_distribution(shapes: DataFrame, wide: int = 30, long: int = 100) -> DataFrame:
    """Min, max and mean of rows and columns over shapes(n_rows, n_cols), with outlier counts."""
    return shapes.agg(
        F.count("*").alias("n_tables"),
        F.min("n_rows").alias("min_rows"),
        F.max("n_rows").alias("max_rows"),
        F.round(F.avg("n_rows"), 6).alias("mean_rows"),
        F.min("n_cols").alias("min_cols"),
        F.max("n_cols").alias("max_cols"),
        F.round(F.avg("n_cols"), 6).alias("mean_cols"),
        F.count_if(F.col("n_cols") > wide).alias("n_wide"),
        F.count_if(F.col("n_rows") > long).alias("n_long"),
    )


def key_columns(cells: DataFrame) -> DataFrame:
    """Per column: key-like flag (declared or by header) and distinct ratio. Equal cells are counted first."""
    values = cells.groupBy("table_id", "col_idx", "header", "cell").agg(F.max("is_foreign_key").alias("_fk"), F.count("*").alias("_n"))
    counted = values.groupBy("table_id", "col_idx", "header").agg(
        F.max("_fk").alias("is_fk"), F.round(F.count("cell") / F.sum("_n"), 6).alias("distinct_ratio")
    )
    return counted.withColumn("key_like", F.col("is_fk") | T.is_key_header("header"))


def key_columns_in_record(tables: DataFrame) -> DataFrame:
    """As key_columns, for nested tables (table_id, columns) that fit one record; cells are not moved."""
    n = lambda c: F.size(c["cells"])
    measured = F.transform(
        "columns",
        lambda c, i: F.struct(
            i.alias("col_idx"),
            c["header"].alias("header"),
            c["is_foreign_key"].alias("is_fk"),
            F.when(n(c) > 0, F.round(F.size(F.array_distinct(F.array_compact(c["cells"]))) / n(c), 6)).alias("distinct_ratio"),
        ),
    )
    # the outer form with a test: the plain one would have all columns measured twice, for a test of the list's size
    counted = tables.select("table_id", F.inline_outer(measured)).filter("distinct_ratio IS NOT NULL")
    return counted.withColumn("key_like", F.col("is_fk") | T.is_key_header("header"))


def attractors(matches: DataFrame, target: Sequence[str], source: str, n: int) -> DataFrame:
    """Columns most often matched first, with distinct sources and overall totals."""
    pairs = matches.groupBy(*target, source).agg(F.count("*").alias("_n"))
    counted = pairs.groupBy(*target).agg(F.sum("_n").alias("n_matches"), F.count(source).alias("n_sources"))
    total = counted.agg(F.sum("n_matches")).scalar()
    distinct = counted.agg(F.count("*")).scalar()
    top = counted.orderBy(F.desc("n_matches"), *target).limit(n)
    return top.withColumn("n_total", total).withColumn("n_targets", distinct)


def gold_audit(gold: DataFrame) -> DataFrame:
    """Per split and overall: queries whose gold tables are all / partly empty or missing.

    Input gold(split, query_id, table_id, n_rows), n_rows NULL where the corpus lacks
    the table.
    """
    empty = F.coalesce(F.col("n_rows"), F.lit(0)) == 0
    per_query = gold.groupBy("split", "query_id").agg(
        F.every(empty).alias("all_empty"),
        F.some(empty).alias("some_empty"),
        F.some(F.col("n_rows").isNull()).alias("missing"),
    )
    rolled = per_query.rollup("split").agg(
        F.count("*").alias("n_queries"),
        F.count_if("all_empty").alias("n_all_empty"),
        F.count_if("some_empty").alias("n_some_empty"),
        F.count_if("missing").alias("n_missing"),
    )
    return rolled.withColumn("split", F.coalesce("split", F.lit("total")))


def corpus_totals(tables: DataFrame, links: DataFrame) -> DataFrame:
    """Databases, tables, rows, empty tables, and foreign keys."""
    per_db = tables.groupBy("db_id").agg(
        F.count("*").alias("_t"), F.sum("n_rows").alias("_r"), F.count_if(F.col("n_rows") == 0).alias("_e")
    )
    n_links = links.agg(F.count("*")).scalar()
    return per_db.agg(
        F.count("*").alias("n_databases"),
        F.sum("_t").alias("n_tables"),
        F.sum("_r").alias("n_rows"),
        F.sum("_e").alias("n_empty"),
    ).withColumn("n_links", n_links)


def exact_medians(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean and exact median per group without gathering a group's values."""
    ranked = range_ordinal(df.select(*group, value), group, value, name="_pos")
    stats = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    middle = ranked.join(stats, list(group)).filter((F.col("_pos") == low) | (F.col("_pos") == high))
    return middle.groupBy(*group, "n", "mean").agg(F.avg(value).alias("median"))


def device_summary(readings: DataFrame, min_free_mb: float, max_util: int) -> DataFrame:
    """Free and total devices per host over readings(host, memory_total_mb, memory_used_mb, ...)."""
    free = is_free(min_free_mb, max_util)
    return readings.groupBy("host").agg(
        F.count_if(free & ~F.col("failed")).alias("n_free"),
        F.count("*").alias("n_total"),
        F.count_if("failed").alias("n_failed"),
    )


def is_free(min_free_mb: float, max_util: int) -> Column:
    free_mb = F.col("memory_total_mb") - F.col("memory_used_mb")
    return (free_mb >= min_free_mb) & (F.col("utilization_percent") <= max_util)
