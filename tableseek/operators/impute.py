"""Cyclic imputation of missing cells from a column's own values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.operators.cells import typed_filler
from tableseek.operators.ranking import ordinal, top_k

COLUMN = ["table_id", "header"]
ROWS_PER_PIECE = 65_536


def value_pools(cells: DataFrame, pool_size: int = 2000) -> DataFrame:
    """First pool_size non-missing values per column by row key, with 0-based slot and pool size."""
    real = cells.filter(~T.is_missing("cell")).select(*COLUMN, "row_key", "cell")
    pool = top_k(real, COLUMN, ["row_key"], pool_size, rank="_rank")
    sizes = pool.groupBy(*COLUMN).agg(F.count("*").alias("pool_n"))
    return pool.select(*COLUMN, (F.col("_rank") - 1).alias("slot"), F.col("cell").alias("value")).join(sizes, COLUMN)


def impute(cells: DataFrame, pool_size: int = 2000, seed: int = 42) -> DataFrame:
    """Fill the k-th missing cell of a column with pool[k mod n].

    Input cells(table_id, header, declared_type, row_key, cell) with an integer row_key.
    A column without any value gets a seeded filler of its declared type per row. The
    position k comes from range pieces of the row key, so one table may be very long.
    """
    missing = cells.filter(T.is_missing("cell"))
    counted = ordinal(
        missing.select(*COLUMN, "declared_type", "row_key"), COLUMN, ["row_key"],
        F.floor(F.col("row_key") / ROWS_PER_PIECE), "_k",
    )
    pools = value_pools(cells, pool_size)
    sizes = pools.groupBy(*COLUMN).agg(F.max("pool_n").alias("_n"))
    placed = counted.join(sizes, COLUMN, "left").withColumn("slot", F.col("_k") % F.col("_n"))
    filled = placed.join(pools.select(*COLUMN, "slot", "value"), [*COLUMN, "slot"], "left")
    filler = typed_filler("declared_type", *COLUMN, "row_key", seed=seed)
    new = filled.select(
        *COLUMN, "declared_type", "row_key", F.coalesce("value", filler).alias("cell"), F.lit(True).alias("imputed")
    )
    old = cells.filter(~T.is_missing("cell")).select(
        *COLUMN, "declared_type", "row_key", "cell", F.lit(False).alias("imputed")
    )
    return old.unionByName(new)
