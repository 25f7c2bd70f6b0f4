"""Training batches, shape plans, padding plans and shards as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableseek.functions.text import power_of_two_ceiling
from tableseek.operators.candidates import hard_negatives
from tableseek.operators.ranking import global_ids, hash_ordinal, ordinal
from tableseek.operators.sampling import one_per_group


def fixed_chunks(df: DataFrame, order: Sequence[str], size: int, name: str) -> DataFrame:
    """Consecutive chunks of ``size`` rows in a global order."""
    indexed = global_ids(df, order, name="_idx")
    return indexed.withColumn(name, F.floor(F.col("_idx") / size)).drop("_idx")


def shards(df: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Global index, shard and offset; ``shard`` is the partition column on disk."""
    indexed = global_ids(df, order, name="global_idx")
    return indexed.withColumn("shard", F.floor(F.col("global_idx") / size)).withColumn(
        "offset_in_shard", F.col("global_idx") % size
    )


def gather(asked: DataFrame, placed: DataFrame, size: int) -> DataFrame:
    """Rows by global index; the shard key lets a partitioned table skip other shards."""
    return asked.withColumn("shard", F.floor(F.col("global_idx") / size)).join(placed, ["shard", "global_idx"])


def batch_count(n: str | Column, size: int) -> Column:
    """Full batches plus the remainder where it holds at least two."""
    n = F.col(n) if isinstance(n, str) else n
    return F.floor(n / size) + F.when(n % size >= 2, 1).otherwise(0)


def assigned_batches(qrels: DataFrame, tables: DataFrame, batch_size: int, epoch: int | None = None, seed: int = 42) -> DataFrame:
    """query_id, table_id (its seeded positive) and batch of every query with a non-empty gold table."""
    gold = qrels.join(tables.filter("n_rows > 0").select("table_id"), "table_id", "left_semi")
    pick_seed = seed if epoch is None else f"{seed}e{epoch}"
    positives = one_per_group(gold, ["query_id"], "table_id", seed=pick_seed)
    placed = hash_ordinal(positives, [], ["query_id"], seed=pick_seed, name="_pos")
    return placed.select("query_id", "table_id", F.floor(F.col("_pos") / batch_size).alias("batch"))


def full_batches(assigned: DataFrame) -> DataFrame:
    """batch and query_id of the batches with at least two queries."""
    held = assigned.groupBy("batch").agg(F.collect_list("query_id").alias("_q")).filter(F.size("_q") >= 2)
    return held.select("batch", F.explode("_q").alias("query_id"))


def batch_lists(
    qrels: DataFrame, tables: DataFrame, batch_size: int, n_negatives: int, epoch: int | None = None, seed: int = 42
) -> DataFrame:
    """Per query of a batch: batch, query_id and ``candidates``, the batch's list of (candidate, table_id, positive).

    Each query brings one seeded positive and its hard negatives; a candidate counts as positive for every query of the
    batch that has it as gold. Batches of one query are dropped. A batch meets once, as lists of its queries: it holds at
    most batch_size * (1 + n_negatives) candidates, so no pairs of queries and candidates are shuffled.
    """
    usable = tables.filter("n_rows > 0")
    gold = qrels.join(usable.select("table_id"), "table_id", "left_semi")
    golds = gold.groupBy("query_id").agg(F.collect_set("table_id").alias("gold"))
    negatives = hard_negatives(gold, usable, n_negatives, seed).groupBy("query_id")
    negatives = negatives.agg(F.collect_list(F.struct(F.col("rank").alias("slot"), "table_id")).alias("negatives"))
    assigned = assigned_batches(qrels, tables, batch_size, epoch, seed)
    asked = assigned.join(golds, "query_id").join(negatives, "query_id", "left")
    own = F.array(F.struct(F.lit(0).cast("bigint").alias("slot"), "table_id"))
    brought = F.concat(own, F.coalesce("negatives", F.slice(own, 1, 0)))
    met = asked.groupBy("batch").agg(F.collect_list(F.struct("query_id", "gold", brought.alias("brought"))).alias("_q")).filter(F.size("_q") >= 2)
    listed = F.flatten(F.transform("_q", lambda q: F.transform(q["brought"], lambda b: F.struct(q["query_id"], b["slot"], b["table_id"].alias("table_id")))))
    met = met.withColumn("_t", F.array_distinct(F.transform(F.sort_array(listed), lambda x: x["table_id"])))
    rows = met.select("batch", "_t", F.explode("_q").alias("_one")).select("batch", "_t", "_one.query_id", "_one.gold")
    marked = F.transform("_t", lambda t, i: F.struct(i.cast("bigint").alias("candidate"), t.alias("table_id"), F.array_contains("gold", t).alias("positive")))
    return rows.select("batch", "query_id", marked.alias("candidates"))


def train_batches(
    qrels: DataFrame, tables: DataFrame, batch_size: int, n_negatives: int, epoch: int | None = None, seed: int = 42
) -> DataFrame:
    """Per batch the de-duplicated candidate list crossed with the batch's queries: ``batch_lists`` as rows."""
    lists = batch_lists(qrels, tables, batch_size, n_negatives, epoch, seed)
    return lists.select("batch", "query_id", F.inline("candidates")).select("batch", "query_id", "candidate", "table_id", "positive")


def list_invariants(lists: DataFrame) -> DataFrame:
    """As ``batch_invariants``, of batch_lists: a query's candidates are audited inside its row."""
    places, tables = F.col("candidates.candidate"), F.col("candidates.table_id")
    n = F.size("candidates")
    return lists.agg(
        F.count("*").alias("n_queries"),
        F.count_if(~F.exists("candidates", lambda c: c["positive"])).alias("no_positive"),
        F.count_if((F.array_min(places) != 0) | (F.array_max(places) != n - 1)).alias("bad_index"),
        F.count_if(F.size(F.array_distinct(tables)) != n).alias("duplicate_candidate"),
    )


def batch_invariants(batches: DataFrame) -> DataFrame:
    """Violation counts of prepared batches; every count except n_queries must be 0."""
    per_query = batches.groupBy("batch", "query_id").agg(
        F.some("positive").alias("_has"),
        F.min("candidate").alias("_lo"),
        F.max("candidate").alias("_hi"),
        F.count("*").alias("_n"),
        F.size(F.collect_set("table_id")).alias("_nd"),
    )
    return per_query.agg(
        F.count("*").alias("n_queries"),
        F.count_if(~F.col("_has")).alias("no_positive"),
        F.count_if((F.col("_lo") != 0) | (F.col("_hi") != F.col("_n") - 1)).alias("bad_index"),
        F.count_if(F.col("_nd") != F.col("_n")).alias("duplicate_candidate"),
    )


def size_batches(shapes: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """Tables sorted by (columns, rows) and cut into batches; batch order is seeded."""
    indexed = global_ids(shapes, ["n_cols", "n_rows", "table_id"], name="_idx")
    placed = indexed.select(
        "*", F.floor(F.col("_idx") / size).alias("batch"), (F.col("_idx") % size).alias("slot")
    ).drop("_idx")
    sizes = placed.groupBy("batch").agg(F.count("*").alias("_n")).filter("_n >= 2").select("batch")
    ordered = hash_ordinal(sizes, [], ["batch"], seed, name="batch_order")
    return placed.join(ordered, "batch")


def packing_utilisation(batches: DataFrame) -> DataFrame:
    """Real cells against padded slots per batch."""
    area = F.col("n_cols") * F.col("n_rows")
    grouped = batches.groupBy("batch").agg(
        F.count("*").alias("n_tables"),
        F.sum(area).alias("n_cells"),
        (F.count("*") * F.max("n_cols") * F.max("n_rows")).alias("n_slots"),
    )
    return grouped.withColumn("used_pct", F.round(100.0 * F.col("n_cells") / F.col("n_slots"), 4))


def shape_microbatches(
    shapes: DataFrame, cell_budget: int, max_tables: int, key: str = "table_id", largest: tuple[int, int] | None = None
) -> DataFrame:
    """Micro-batches of tables with the same power-of-two shape, small areas first.

    ``largest`` are the last bins of columns and rows, which take all larger tables, too; None lets bins grow with the tables.
    A shape bin may hold most tables: tables get their corpus index first, and bins
    are ranked in pieces of 65,536 consecutive indices.
    """
    indexed = global_ids(shapes, [key], name="_idx")
    binned = indexed.withColumn("col_bin", power_of_two_ceiling("n_cols")).withColumn(
        "row_bin", power_of_two_ceiling("n_rows")
    )
    if largest is not None:
        for name, last in zip(("col_bin", "row_bin"), largest):
            binned = binned.withColumn(name, F.least(F.col(name), F.lit(last).cast(binned.schema[name].dataType)))
    placed = ordinal(binned, ["col_bin", "row_bin"], ["_idx"], F.floor(F.col("_idx") / 65536), "_pos")
    area = F.col("col_bin") * F.col("row_bin")
    group_size = F.least(F.greatest(F.lit(1), F.floor(F.lit(cell_budget) / area)), F.lit(max_tables))
    grouped = placed.withColumn("_group", F.floor(F.col("_pos") / group_size))
    groups = grouped.select((area).alias("_area"), "col_bin", "row_bin", "_group").distinct()
    numbered = global_ids(groups, ["_area", "col_bin", "row_bin", "_group"], name="microbatch").drop("_area")
    return grouped.join(numbered, ["col_bin", "row_bin", "_group"]).drop("_idx", "_pos", "_group")


def padding_plan(batches: DataFrame, cells: DataFrame) -> DataFrame:
    """Flat destination of every real cell and column in its batch's padded block."""
    extents = batches.groupBy("batch").agg(F.max("n_cols").alias("_mc"), F.max("n_rows").alias("_mr"))
    placed = batches.select("batch", "slot", "table_id", "n_cols").join(extents, "batch")
    real = placed.join(cells, "table_id").filter(F.col("col_idx") < F.col("n_cols"))
    column = F.col("slot") * F.col("_mc") + F.col("col_idx")
    return real.select(
        "batch", "table_id", "col_idx", "row_idx",
        (column * F.col("_mr") + F.col("row_idx")).alias("flat_idx"),
        column.alias("flat_column"),
    )
