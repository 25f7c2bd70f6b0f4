"""State changes and streaks over readings; the batch twins of the streaming monitor.

A host may own most readings, so windows run inside (host, time piece) and only piece
summaries are windowed per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_piece(ts: str = "ts") -> Column:
    return F.to_date(ts)


def state_changes(readings: DataFrame, piece: Column | None = None, notify_first: bool = True) -> DataFrame:
    """Readings(host, ts, event_id, state) whose state differs from the host's previous one."""
    rows = readings.withColumn("_piece", day_piece() if piece is None else piece)
    inside = Window.partitionBy("host", "_piece").orderBy("ts", "event_id")
    local = rows.withColumn("_i", F.row_number().over(inside)).withColumn("_prev", F.lag("state").over(inside))
    last = rows.groupBy("host", "_piece").agg(F.max_by("state", F.struct("ts", "event_id")).alias("_last"))
    before = Window.partitionBy("host").orderBy("_piece")
    carried = last.select("host", "_piece", F.lag("_last").over(before).alias("_carry"))
    joined = local.join(carried, ["host", "_piece"])
    previous = F.when(F.col("_i") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    marked = joined.withColumn("previous", previous)
    changed = ~F.col("previous").eqNullSafe(F.col("state"))
    if not notify_first:
        changed = changed & F.col("previous").isNotNull()
    return marked.filter(changed).select("host", "ts", "event_id", "previous", "state")


def free_streaks(readings: DataFrame, k: int = 3, piece: Column | None = None) -> DataFrame:
    """Readings(host, ts, event_id, free) at which the k-th consecutive free reading arrives.

    A busy or failed reading resets the streak. A piece passes on its trailing streak; a
    piece without any busy reading adds its whole length to the streak that came in.
    """
    rows = readings.withColumn("_piece", day_piece() if piece is None else piece)
    inside = Window.partitionBy("host", "_piece").orderBy("ts", "event_id")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_i", F.row_number().over(inside))
    local = local.withColumn("_busy", F.max(F.when(~F.col("free"), F.col("_i"))).over(so_far))
    pieces = local.groupBy("host", "_piece").agg(F.max("_i").alias("_n"), F.max("_busy").alias("_last_busy"))
    per_host = Window.partitionBy("host").orderBy("_piece")
    upto, earlier = per_host.rowsBetween(Window.unboundedPreceding, 0), per_host.rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("_total", F.sum("_n").over(upto))
    # Position (in readings of the host) of the last busy reading up to the piece's end.
    reset_at = F.when(F.col("_last_busy").isNotNull(), F.col("_total") - F.col("_n") + F.col("_last_busy"))
    placed = placed.withColumn("_reset", reset_at)
    carried = placed.select(
        "host", "_piece",
        (F.coalesce(F.col("_total") - F.col("_n"), F.lit(0)) - F.coalesce(F.max("_reset").over(earlier), F.lit(0))).alias("_carry"),
    )
    joined = local.join(carried, ["host", "_piece"])
    streak = F.when(F.col("_busy").isNotNull(), F.col("_i") - F.col("_busy")).otherwise(F.col("_i") + F.col("_carry"))
    return joined.withColumn("streak", streak).filter(F.col("streak") == k).select("host", "ts", "event_id", "streak")
