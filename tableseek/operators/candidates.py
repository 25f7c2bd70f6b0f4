"""Candidate pools and negatives with a fixed fan-out per query.

Tables are placed once on a ring: their positions in the seeded order of their
database (or of the whole corpus). A query reads a run of positions from its own
seeded start, so it meets as many tables as it needs and never all tables of a
large database.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableseek.functions.hashing import hash_key, hash_mod
from tableseek.operators.ranking import hash_ordinal

# Tables of one database that a list holds.
LIST = 1000


def group_sizes(tables: DataFrame, group: Sequence[str]) -> DataFrame:
    """Tables per group."""
    return tables.groupBy(*group).agg(F.count("*").alias("_n"))


def ring(tables: DataFrame, group: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """Position of every table in the seeded order of its group."""
    return hash_ordinal(tables.select(*group, key), group, [key], seed, name="_pos")


def draw_from_ring(
    wants: DataFrame, placed: DataFrame, group: Sequence[str], sizes: DataFrame, query: str, seed: int = 42
) -> DataFrame:
    """Read ``_want`` consecutive ring positions per row of wants(query, group, _want).

    Never more positions than the group holds, so no table repeats within a query.
    """
    start = hash_mod(F.col("_n"), query, seed=f"{seed}s")
    sized = wants.join(sizes, list(group)).withColumn("_start", start)
    steps = F.sequence(F.lit(0).cast("bigint"), F.least(F.col("_want"), F.col("_n")) - 1)
    asked = sized.withColumn("_step", F.explode(steps)).withColumn("_pos", F.pmod(F.col("_start") + F.col("_step"), F.col("_n")))
    return asked.join(placed, [*group, "_pos"]).drop("_start", "_n", "_want", "_pos")


def hard_negatives(qrels: DataFrame, tables: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n non-empty tables of the query's own database per query, gold excluded.

    Input qrels(query_id, db_id, table_id), tables(db_id, table_id, n_rows). Each query
    draws n plus its number of gold tables, so n remain after the gold ones are dropped
    wherever the database has that many.
    """
    usable = tables.filter("n_rows > 0").select("db_id", "table_id")
    sizes = group_sizes(usable, ["db_id"])
    wants = qrels.groupBy("query_id", "db_id").agg((F.count("*") + n).alias("_want"))
    drawn = draw_from_ring(wants, ring(usable, ["db_id"], "table_id", seed), ["db_id"], sizes, "query_id", seed)
    # a query's draws, which its gold tables bound, meet once; gold is taken out inside the row
    lists = drawn.groupBy("query_id").agg(F.collect_list(F.struct("_step", "table_id", "db_id")).alias("_drawn"))
    gold = qrels.groupBy("query_id").agg(F.collect_set("table_id").alias("_gold"))
    free = F.filter(F.sort_array("_drawn"), lambda t: ~F.array_contains("_gold", t["table_id"]))
    rows = lists.join(gold, "query_id").select("query_id", F.posexplode(F.slice(free, 1, n)).alias("_at", "_t"))
    return rows.select("query_id", "_t.db_id", "_t.table_id", (F.col("_at") + 1).cast("bigint").alias("rank"))


def chunk_distractors(
    queries: DataFrame, tables: DataFrame, n: int, seed: int = 42
) -> DataFrame:
    """Two-stage distractors over queries(query_id, db_id, chunk), tables(db_id, table_id): the columns of the queries and ``tables``.

    A chunk draws 2n tables of the whole corpus, each of its queries keeps n tables of
    that pool from other databases, in the query's own seeded order. A pool is one list of
    2n tables, so a query chooses inside its row and no pairs are shuffled.
    """
    whole = tables.withColumn("_all", F.lit(0))
    sizes = group_sizes(whole, ["_all"])
    placed = ring(whole, ["_all"], "table_id", seed)
    wants = queries.select("chunk").distinct().select(
        "chunk", F.lit(0).alias("_all"), F.lit(2 * n).cast("bigint").alias("_want")
    )
    pool = draw_from_ring(wants, placed, ["_all"], sizes, "chunk", seed).drop("_all", "_step")
    pool = pool.join(tables.select("table_id", F.col("db_id").alias("_table_db")), "table_id")
    pools = pool.groupBy("chunk").agg(F.collect_list(F.struct("table_id", "_table_db")).alias("_pool"))
    others = F.filter("_pool", lambda t: t["_table_db"] != F.col("db_id"))
    hashed = F.transform(others, lambda t: F.struct(hash_key("query_id", t["table_id"], seed=seed).alias("_h"), t["table_id"].alias("table_id")))
    kept = F.transform(F.slice(F.sort_array(hashed), 1, n), lambda t: t["table_id"])
    return queries.join(pools, "chunk").withColumn("tables", kept).drop("_pool")


def own_tables(queries: DataFrame, tables: DataFrame, piece: int = LIST) -> DataFrame:
    """The columns of the queries and ``tables``: every table of the query's own database, in lists of about ``piece``.

    A database is cut into its lists once, so a query meets lists and not tables."""
    sizes = group_sizes(tables, ["db_id"]).select("db_id", F.ceil(F.col("_n") / piece).alias("_k"))
    dealt = tables.select("db_id", "table_id").join(sizes, "db_id").withColumn("_piece", F.pmod(F.xxhash64("table_id"), F.col("_k")))
    lists = dealt.groupBy("db_id", "_piece").agg(F.collect_list("table_id").alias("tables")).drop("_piece")
    return queries.join(lists, "db_id")


def candidate_lists(queries: DataFrame, tables: DataFrame, qrels: DataFrame, n: int, seed: int = 42, piece: int = LIST) -> DataFrame:
    """Visible candidates as query_id, db_id, chunk, gold, own and ``tables``: lists of bounded length, some per query.

    ``gold`` has all gold tables of the query, visible or not; it is empty where there are none.
    """
    gold = qrels.groupBy("query_id").agg(F.collect_set("table_id").alias("gold"))
    asked = queries.select("query_id", "db_id", "chunk").join(gold, "query_id", "left")
    asked = asked.withColumn("gold", F.coalesce("gold", F.array().cast("array<string>")))
    own = own_tables(asked, tables, piece).withColumn("own", F.lit(True))
    other = chunk_distractors(asked, tables, n, seed).withColumn("own", F.lit(False))
    return own.unionByName(other)


def candidate_plan(queries: DataFrame, tables: DataFrame, qrels: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Visible candidates per query: own database and distractors, with the positive flag.
    The result is by definition queries x tables of a database; it is expanded from lists."""
    lists = candidate_lists(queries, tables, qrels, n, seed)
    rows = lists.select("query_id", "db_id", "chunk", "own", "gold", F.explode("tables").alias("table_id"))
    return rows.withColumn("positive", F.array_contains("gold", F.col("table_id"))).select(
        "query_id", "table_id", "db_id", "chunk", "own", "positive"
    )


def plan_violations(plan: DataFrame, qrels: DataFrame) -> DataFrame:
    """Per query: gold tables the plan hides, and plans without any positive."""
    met = plan.groupBy("query_id").agg(F.count_if("positive").alias("_met"))
    gold = qrels.groupBy("query_id").agg(F.count("*").alias("_gold"))
    both = met.join(gold, "query_id", "full_outer")
    hidden = F.coalesce("_gold", F.lit(0)) - F.coalesce("_met", F.lit(0))
    reasons = F.array(
        F.struct(F.lit("hidden_gold").alias("why"), hidden.alias("n")),
        F.struct(F.lit("no_positive").alias("why"), (F.col("_met") == 0).cast("bigint").alias("n")),
    )
    return both.select("query_id", F.inline(reasons)).filter("n > 0")
