"""Replaced-cell corruption: labelled swaps with another real value of the same header."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.functions.hashing import hash_mod
from tableseek.operators.ranking import hash_ordinal, prefix_sum

# Width of the position pieces used to look a drawn position up among value runs.
RUN_PIECE = 64


def value_runs(real: DataFrame) -> DataFrame:
    """Values per (batch, header) laid out as runs: start position, length, total length."""
    counted = real.groupBy("batch", "header", "cell").agg(F.count("*").alias("run_n"))
    hashed = counted.withColumn("_vh", F.md5("cell"))
    runs = prefix_sum(hashed, ["batch", "header"], ["_vh"], "run_n", F.substring("_vh", 1, 2), "run_start")
    totals = counted.groupBy("batch", "header").agg(F.sum("run_n").alias("pool_n"))
    return runs.drop("_vh").join(totals, ["batch", "header"])


def corrupt_cells(cells: DataFrame, fraction: float = 0.15, seed: int = 42) -> DataFrame:
    """Swap round-half-even(fraction * n) non-empty cells of every column.

    Input cells(batch, table_id, col_idx, header, row_key, cell). A replacement is drawn
    uniformly from the header's pool without the cell's own value; where the pool has no
    other value, the same value is drawn. The pool is never gathered: values are counted
    into runs, the draw picks a position outside the own run, and the position is looked
    up among the runs of its piece.
    """
    real = cells.filter(~T.is_missing("cell"))
    column = ["batch", "table_id", "col_idx"]
    placed = hash_ordinal(real.select(*column, "header", "row_key", "cell"), column, ["row_key"], seed, salt=["table_id", "col_idx"], name="_pos")
    sizes = real.groupBy(*column).agg(F.count("*").alias("_n"))
    quota = F.bround(F.col("_n") * F.lit(fraction), 0)
    chosen = placed.join(sizes, column).filter(F.col("_pos") < quota).drop("_pos", "_n")

    runs = value_runs(real)
    own = chosen.join(runs, ["batch", "header", "cell"])
    others = F.col("pool_n") - F.col("run_n")
    draw = hash_mod(F.greatest(others, F.lit(1)), "table_id", "col_idx", "row_key", seed=f"{seed}r")
    skipped = F.when(draw < F.col("run_start"), draw).otherwise(draw + F.col("run_n"))
    at = F.when(others > 0, skipped).otherwise(F.col("run_start"))
    drawn = own.select(*column, "header", "row_key", at.alias("_at"), F.floor(at / RUN_PIECE).alias("_piece"))

    last_piece = F.floor((F.col("run_start") + F.col("run_n") - 1) / RUN_PIECE)
    pieces = runs.withColumn("_piece", F.explode(F.sequence(F.floor(F.col("run_start") / RUN_PIECE), last_piece)))
    pieces = pieces.select("batch", "header", "_piece", "run_start", "run_n", F.col("cell").alias("replacement"))
    inside = (F.col("_at") >= F.col("run_start")) & (F.col("_at") < F.col("run_start") + F.col("run_n"))
    swaps = drawn.join(pieces, ["batch", "header", "_piece"]).filter(inside).select(*column, "row_key", "replacement")

    labelled = cells.join(swaps, [*column, "row_key"], "left")
    label = F.col("replacement").isNotNull().cast("int")
    return labelled.select(
        *column, "header", "row_key", F.col("cell").alias("original"),
        F.coalesce("replacement", "cell").alias("cell"), label.alias("label"),
    )
