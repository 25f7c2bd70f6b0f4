"""Seeded samples, splits and set operations, independent of partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableseek.functions.hashing import hash_key
from tableseek.operators.ranking import hash_ordinal, row_in_small_group, top_k


def row_sample(
    df: DataFrame, table: Sequence[str], key: Sequence[str], n: int, seed: int | str = 42, eligible: Column | None = None
) -> DataFrame:
    """At most n rows per table in hash order; the table name is part of the hash."""
    rows = df if eligible is None else df.filter(eligible)
    hashed = rows.withColumn("_h", hash_key(*table, *key, seed=seed))
    return top_k(hashed, table, ["_h", *key], n, rank="_rank").drop("_h", "_rank")


def first_rows(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*key).limit(n)


def random_rows(df: DataFrame, key: Sequence[str], n: int, seed: int | str = 42) -> DataFrame:
    """n seeded random rows; at most n rows per map task reach the final merge."""
    return df.withColumn("_h", hash_key(*key, seed=seed)).orderBy("_h", *key).limit(n).drop("_h")


def split_queries(
    queries: DataFrame, key: str, fractions: Mapping[str, float], seed: int = 42, cap: int | None = None
) -> DataFrame:
    """train/val/test by seeded order: half-even rounded cuts, the rest is test."""
    if abs(sum(fractions.values()) - 1.0) > 1e-9:
        raise ValueError("split fractions must sum to one")
    placed = hash_ordinal(queries, [], [key], seed, name="_pos")
    if cap is not None:
        placed = placed.filter(F.col("_pos") < cap)
    total = queries.agg(F.count("*")).scalar()
    n = total if cap is None else F.least(total, F.lit(cap))
    n_train = F.bround(n * F.lit(fractions["train"]), 0)
    n_val = F.bround(n * F.lit(fractions["val"]), 0)
    name = (
        F.when(F.col("_pos") < n_train, "train").when(F.col("_pos") < n_train + n_val, "val").otherwise("test")
    )
    return placed.withColumn("split", name).drop("_pos")


def holdout(tables: DataFrame, key: str, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Hold-out of max(1, floor(n * fraction)) tables from the front of the seeded order."""
    placed = hash_ordinal(tables, [], [key], seed, name="_pos")
    n = tables.agg(F.count("*")).scalar()
    cut = F.greatest(F.lit(1), F.floor(n * F.lit(fraction)))
    return placed.withColumn("held_out", F.col("_pos") < cut).drop("_pos")


def fill_to_size(forced: DataFrame, pool: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """All forced keys, then random pool keys until ``size``; never fewer than the forced part."""
    forced = forced.select(key).distinct()
    rest = pool.select(key).distinct().join(forced, key, "left_anti")
    placed = hash_ordinal(rest, [], [key], seed, name="_pos")
    need = F.lit(size) - forced.agg(F.count("*")).scalar()
    fill = placed.filter(F.col("_pos") < need).select(key, F.lit("fill").alias("origin"))
    return forced.withColumn("origin", F.lit("required")).unionByName(fill)


def fixed_corpus(required: DataFrame, tables: DataFrame, key: str, size: int | None, seed: int = 42) -> DataFrame:
    """Corpus of exactly ``size`` tables with every required one; None keeps all tables."""
    if size is None:
        return tables.select(key).distinct().withColumn("origin", F.lit("fill"))
    n_required = required.select(key).distinct().count()
    if n_required > size:
        raise ValueError(f"{n_required} required tables do not fit a corpus of {size}")
    return fill_to_size(required, tables, key, size, seed)


def validation_corpus(
    positives: DataFrame, tables: DataFrame, key: str, db: str, per_db: int, size: int, seed: int = 42
) -> DataFrame:
    """Forced positives, at most ``per_db`` hard negatives of each positive database, random fill."""
    positives = positives.select(key, db).distinct()
    same_db = tables.join(positives.select(db).distinct(), db, "left_semi").join(positives, key, "left_anti")
    hashed = same_db.withColumn("_h", hash_key(key, seed=f"{seed}h"))
    hard = top_k(hashed, [db], ["_h", key], per_db, rank="_r").select(key)
    forced = positives.select(key).withColumn("origin", F.lit("positive")).unionByName(
        hard.withColumn("origin", F.lit("hard_negative"))
    )
    filled = fill_to_size(forced, tables, key, size, seed).filter(F.col("origin") == "fill")
    return forced.unionByName(filled)


def one_per_group(df: DataFrame, group: Sequence[str], value: str, seed: int | str = 42) -> DataFrame:
    """One seeded pick per group, as a partially aggregated minimum."""
    picked = F.min_by(value, F.struct(hash_key(*group, value, seed=seed), value))
    return df.groupBy(*group).agg(picked.alias(value))


def keep_first(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """First row per key in the given unique order, aggregated map-side."""
    payload = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*payload), F.col(order)).alias("_row")
    return df.groupBy(*key).agg(first).select(*key, "_row.*")


def disjoint_chunks(queries: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """Every query once, in chunks of the seeded order."""
    placed = hash_ordinal(queries, [], [key], seed, name="_pos")
    return placed.withColumn("chunk", F.floor(F.col("_pos") / size)).drop("_pos")


def reshuffled_epochs(queries: DataFrame, key: str, size: int, epochs: int, seed: int = 42) -> DataFrame:
    """Per epoch a new seeded order, truncated to ``size``."""
    per_epoch = queries.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = hash_ordinal(per_epoch, ["epoch"], [key], seed, salt=["epoch"])
    return placed.filter(F.col("pos") < size)


def pilot(tables: DataFrame, db: str, key: str, n_dbs: int, n_tables: int, seed: int = 42) -> DataFrame:
    """A few seeded databases, then a few seeded tables of them."""
    chosen = random_rows(tables.select(db).distinct(), [db], n_dbs, seed)
    return random_rows(tables.join(chosen, db, "left_semi"), [key], n_tables, seed)


def shuffle_cells(cells: DataFrame, seed: int = 42) -> DataFrame:
    """Permute rows and columns of capped tables; rows move together across columns."""
    rows = cells.select("table_id", "row_idx").distinct()
    cols = cells.select("table_id", "col_idx").distinct()
    new_row = row_in_small_group(["table_id"], [hash_key("table_id", F.lit("r"), "row_idx", seed=seed), "row_idx"])
    new_col = row_in_small_group(["table_id"], [hash_key("table_id", F.lit("c"), "col_idx", seed=seed), "col_idx"])
    moved = cells.join(rows.withColumn("_row", new_row - 1), ["table_id", "row_idx"]).join(
        cols.withColumn("_col", new_col - 1), ["table_id", "col_idx"]
    )
    return moved.select("table_id", F.col("_col").alias("col_idx"), F.col("_row").alias("row_idx"), "header", "cell")


def shuffle_tables(tables: DataFrame, seed: int = 42) -> DataFrame:
    """As shuffle_cells, of nested tables (table_id, columns) whose columns are equally long: drawn inside the record,
    so that no cell is moved."""
    def drawn(kind: str, n: Column) -> Column:
        place = lambda i: F.struct(hash_key("table_id", F.lit(kind), i, seed=seed).alias("h"), i.alias("i"))
        every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.sort_array(F.transform(every, place)), lambda x: x["i"])

    rows = F.when(F.size("columns") > 0, F.size(F.col("columns")[0]["cells"])).otherwise(0)
    placed = tables.select("table_id", drawn("r", rows).alias("_rows"), F.transform(drawn("c", F.size("columns")), lambda i: F.get("columns", i)).alias("_cols"))
    # outer explodes with a test: the plain ones would have the draws made twice, for a test of their size
    columns = placed.select("table_id", "_rows", F.posexplode_outer("_cols").alias("col_idx", "_col")).filter("col_idx IS NOT NULL")
    rows = columns.select("table_id", "col_idx", "_col", F.posexplode_outer("_rows").alias("row_idx", "_i")).filter("row_idx IS NOT NULL")
    return rows.select("table_id", "col_idx", "row_idx", F.col("_col")["header"].alias("header"), F.get(F.col("_col")["cells"], F.col("_i")).alias("cell"))


def set_equal(left: Column, right: Column) -> Column:
    return F.array_sort(F.array_distinct(left)) == F.array_sort(F.array_distinct(right))


def conflicting_roots(files: DataFrame) -> DataFrame:
    """Databases found under more than one path, over files(db_id, path)."""
    paths = files.select("db_id", "path").distinct()
    return paths.groupBy("db_id").agg(F.count("*").alias("n_paths")).filter("n_paths > 1")


def checked_roots(files: DataFrame) -> DataFrame:
    """files(db_id, path) with one path per database; the job fails on a database found under two."""
    paths = files.groupBy("db_id").agg(F.min("path").alias("path"), F.max("path").alias("_other"))
    message = F.concat(F.lit("database under more than one path: "), "db_id")
    return paths.select("db_id", F.when(F.col("path") == F.col("_other"), F.col("path")).otherwise(F.raise_error(message)).alias("path"))
