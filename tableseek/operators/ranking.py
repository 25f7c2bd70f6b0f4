"""Group ranks, group top-k and global ordinals that hold when one group is huge.

A plain ``row_number`` over a group sends the whole group to one task. Where a
group has no size bound, ``ordinal`` ranks inside (group, bucket) pieces and adds
the row counts of the earlier buckets; the bucket only has to be monotone in the
requested order. Groups that are bounded by construction (rows of one capped
table, tokens of one query) use ``row_in_small_group``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableseek.functions.hashing import hash_key
from tableseek.session import cut_lineage


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def row_in_small_group(group: Sequence[str], order: Sequence[str | Column]) -> Column:
    """1-based rank; only for groups with a bound that does not grow with the data."""
    return F.row_number().over(Window.partitionBy(*group).orderBy(*_cols(order)))


def top_k(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], k: int, rank: str = "rank", pieces: int = 32
) -> DataFrame:
    """First k rows of every group, with their 1-based rank.

    Ranked in two levels: a group's rows are first cut to k within each of its pieces, so a group meets in one task only
    with k rows of each piece. Where Spark's window group limit allows that k, a piece is some tasks' rows, and every task
    keeps k rows of a group before the first shuffle; beyond, pieces are dealt by the hash of the row. One piece ranks in one
    level, which saves a shuffle of all rows: for a small k, since a group then meets in one task with k rows of every task.
    """
    if pieces == 1:
        ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*_cols(order))))
        return ranked.filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))
    if k <= int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        piece = F.pmod(F.spark_partition_id(), F.lit(pieces))
    else:
        keyed = [c for c, kind in df.dtypes if kind.split("<")[0] not in ("map", "variant")]
        piece = F.pmod(F.xxhash64(*keyed), F.lit(pieces))
    first = Window.partitionBy(*group, "_piece").orderBy(*_cols(order))
    some = df.withColumn("_piece", piece).withColumn(rank, F.row_number().over(first)).filter(F.col(rank) <= k)
    ranked = some.drop("_piece", rank).withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*_cols(order))))
    return ranked.filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))


def ordinal(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], bucket: Column, name: str = "pos"
) -> DataFrame:
    """0-based position in the group's order. Group keys must not be NULL.

    One shuffle of the rows by (group, bucket); the bucket sizes come from the same
    shuffle, and only (group, bucket) counts are windowed per group.
    """
    keys = [*group, "_bucket"]
    pieces = df.withColumn("_bucket", bucket)
    local = pieces.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(*_cols(order))))
    sizes = local.groupBy(*keys).agg(F.max("_local").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    joined = local.join(starts, keys)
    return joined.withColumn(name, (F.col("_start") + F.col("_local") - 1).cast("bigint")).drop(
        "_bucket", "_local", "_start"
    )


def prefix_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], weight: str, bucket: Column, name: str = "before"
) -> DataFrame:
    """Sum of ``weight`` over the rows that precede in the group's order, bucketed like ``ordinal``."""
    keys = [*group, "_bucket"]
    running = Window.partitionBy(*keys).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_bucket", bucket).withColumn("_run", F.sum(weight).over(running))
    sizes = local.groupBy(*keys).agg(F.max("_run").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    joined = local.join(starts, keys)
    return joined.withColumn(name, F.col("_start") + F.col("_run") - F.col(weight)).drop("_bucket", "_run", "_start")


def hash_ordinal(
    df: DataFrame,
    group: Sequence[str],
    keys: Sequence[str | Column],
    seed: int | str = 42,
    salt: Sequence[str | Column] = (),
    name: str = "pos",
    hex_digits: int = 2,
) -> DataFrame:
    """Position of every row in the seeded random order of its group.

    md5 is uniform, so its leading hex digits cut any group into equal pieces:
    256 per group by default, 4096 with three digits.
    """
    hashed = df.withColumn("_h", hash_key(*salt, *keys, seed=seed))
    ranked = ordinal(hashed, group, ["_h", *keys], F.substring("_h", 1, hex_digits), name)
    return ranked.drop("_h")


def width_bucket_of(column: str | Column, low: float, high: float, buckets: int = 256) -> Column:
    """Monotone bucket of a number by equal widths; values outside clamp to the ends."""
    column = F.col(column) if isinstance(column, str) else column
    width = max((high - low) / buckets, 1e-300)
    cell = F.floor((column.cast("double") - F.lit(float(low))) / F.lit(width)).cast("bigint")
    return F.least(F.greatest(cell, F.lit(0).cast("bigint")), F.lit(buckets - 1).cast("bigint"))


def range_ordinal(
    df: DataFrame, group: Sequence[str], column: str, ties: Sequence[str] = (), name: str = "pos", buckets: int = 256
) -> DataFrame:
    """Position by ascending numeric column, bucketed at the column's own quantiles.

    The driver receives ``buckets`` split values, never rows.
    """
    probs = [i / buckets for i in range(1, buckets)]
    numeric = df.select(F.col(column).cast("double").alias("_q"))
    splits = sorted(set(numeric.approxQuantile("_q", probs, 0.5 / buckets))) or [0.0]
    bucketizer = Bucketizer(
        splits=[float("-inf"), *splits, float("inf")], inputCol="_q", outputCol="_cut", handleInvalid="keep"
    )
    cut = bucketizer.transform(df.withColumn("_q", F.col(column).cast("double"))).drop("_q")
    return ordinal(cut, group, [column, *ties], F.col("_cut"), name).drop("_cut")


def global_ids(df: DataFrame, order: Sequence[str | Column], start: int = 0, name: str = "id") -> DataFrame:
    """Dense sequential ids in sorted order, without a single-task window.

    Rows are range sorted and tagged with (partition, offset in partition); the tagged
    rows are checkpointed so that both uses below see the same partitions, then the
    row counts of the earlier partitions are added.
    """
    tagged = cut_lineage(df.sort(*order).withColumn("_tag", F.monotonically_increasing_id()))
    part = F.shiftright("_tag", 33)
    offset = F.col("_tag") - F.shiftleft(part, 33)
    sizes = tagged.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    placed = tagged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, (F.col("_start") + offset + start).cast("bigint")).drop("_tag", "_part", "_start")


def small_or_unhinted(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast hint only after a bounded count shows at most ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
