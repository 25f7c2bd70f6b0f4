"""Profiles and audits over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.operators import profile as P
from tableseek.operators.resolution import classify_questions, named_or_all
from tableseek.plans.lowering import (
    ALL_CELLS_SQL,
    QUESTIONS_SQL,
    catalog,
    order_cells,
    qrels,
    questions,
    whole_tables,
)
from tableseek.plans.registry import load, query
from tableseek.session import scratch_path

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_day", "o_clerk", "o_shippriority"]


def holey_orders(spark, d):
    """Orders with injected NULLs and two columns that never have a value."""
    k = F.col("o_orderkey")
    return load(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 3 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 7 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 5 != 0, F.col("o_orderpriority")).otherwise(F.lit("")).alias("o_orderpriority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_day"),
        F.lit(None).cast("string").alias("o_clerk"),
        F.lit(None).cast("int").alias("o_shippriority"),
    )


HOLEY_SQL = """holey AS (
  SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS o_custkey,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE '' END AS o_orderpriority,
    strftime(o_orderdate, '%Y-%m-%d') AS o_day, CAST(NULL AS VARCHAR) AS o_clerk, CAST(NULL AS INTEGER) AS o_shippriority
  FROM orders)"""
_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS n_nonnull, count(DISTINCT {c}) AS n_distinct FROM holey"
    for c in ORDER_COLUMNS
)


@query("column_profile", f"WITH {HOLEY_SQL} {_PROFILE}")
def column_profile(spark, d):
    return P.column_profile(holey_orders(spark, d), ORDER_COLUMNS)


@query(
    "null_breakdown",
    f"""WITH {HOLEY_SQL}, p AS ({_PROFILE})
SELECT column_name, n_rows, n_nonnull, round(100.0 * (n_rows - n_nonnull) / n_rows, 4) AS null_pct FROM p""",
)
def null_breakdown(spark, d):
    return P.null_breakdown(holey_orders(spark, d), ORDER_COLUMNS)


@query(
    "complete_rows",
    f"""WITH {HOLEY_SQL} SELECT count(*) AS n_rows,
  count(*) FILTER (WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL) AS n_complete,
  round(100.0 * count(*) FILTER (WHERE o_custkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL)
    / count(*), 4) AS complete_pct FROM holey""",
)
def complete_rows(spark, d):
    return P.complete_rows(holey_orders(spark, d), ORDER_COLUMNS[:4])


@query(
    "all_null_columns",
    f"""WITH {HOLEY_SQL}, p AS ({_PROFILE}),
t(column_name, ty) AS (VALUES ('o_clerk', 'STRING'), ('o_shippriority', 'INT'))
SELECT ty AS declared_type, count(*) AS n_columns FROM p JOIN t USING (column_name)
WHERE n_nonnull = 0 AND n_rows > 0 GROUP BY ty""",
)
def all_null_columns(spark, d):
    rows = holey_orders(spark, d)
    declared = spark.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in rows.schema], "column_name string, declared_type string"
    )
    profile = P.null_breakdown(rows, ORDER_COLUMNS)
    return P.fully_null_columns(profile, declared)


@query(
    "imputation_audit",
    f"""WITH {ALL_CELLS_SQL}
SELECT table_id, col_idx, header, count(*) AS n_cells, count(*) FILTER (WHERE trim(cell) = '') AS n_empty,
  round(100.0 * count(*) FILTER (WHERE trim(cell) = '') / count(*), 4) AS empty_pct
FROM order_cells GROUP BY table_id, col_idx, header HAVING count(*) FILTER (WHERE trim(cell) = '') > 0""",
)
def imputation_audit(spark, d):
    return P.empty_cells(order_cells(spark, d, None))


_DIV_COLS = ["o_custkey", "o_orderstatus", "o_orderpriority", "o_day", "o_clerk"]


@query(
    "sample_diversity",
    f"""WITH {HOLEY_SQL},
f AS (SELECT * FROM holey ORDER BY o_orderkey LIMIT 50),
r AS (SELECT * FROM holey ORDER BY md5(concat_ws('|', '42', o_orderkey)), o_orderkey LIMIT 50),
x AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, (SELECT count(*) FROM (SELECT DISTINCT {c} FROM f)) AS distinct_first, (SELECT count(*) FROM (SELECT DISTINCT {c} FROM r)) AS distinct_random" for c in _DIV_COLS)})
SELECT *, distinct_random > 2 * distinct_first AND distinct_random > 3 AS gap FROM x""",
)
def sample_diversity(spark, d):
    return P.sample_diversity(holey_orders(spark, d), _DIV_COLS, "o_orderkey", 50)


@query(
    "random_values",
    f"""WITH {HOLEY_SQL}
SELECT o_orderkey, o_orderpriority AS value, (SELECT round(count(DISTINCT o_orderpriority) / count(*), 6) FROM holey) AS distinct_ratio
FROM holey WHERE trim(o_orderpriority) <> '' ORDER BY md5(concat_ws('|', '42', o_orderkey)), o_orderkey LIMIT 10""",
)
def random_values(spark, d):
    return P.random_values(holey_orders(spark, d), "o_orderpriority", "o_orderkey", 10)


@query(
    "size_distribution",
    f"""WITH {ALL_CELLS_SQL},
s AS (SELECT table_id, count(DISTINCT row_idx) AS n_rows, count(DISTINCT col_idx) AS n_cols FROM order_cells GROUP BY 1)
SELECT count(*) AS n_tables, min(n_rows) AS min_rows, max(n_rows) AS max_rows, round(avg(n_rows), 6) AS mean_rows,
  min(n_cols) AS min_cols, max(n_cols) AS max_cols, round(avg(n_cols), 6) AS mean_cols,
  count(*) FILTER (WHERE n_cols > 5) AS n_wide, count(*) FILTER (WHERE n_rows > 8) AS n_long FROM s""",
)
def size_distribution(spark, d):
    cells = order_cells(spark, d, None)
    shapes = cells.groupBy("table_id").agg((F.max("row_idx") + 1).cast("bigint").alias("n_rows"), (F.max("col_idx") + 1).cast("bigint").alias("n_cols"))
    return P.size_distribution(shapes, wide=5, long=8)


@query(
    "key_share",
    f"""WITH {ALL_CELLS_SQL},
c AS (SELECT table_id, col_idx, header, round(count(DISTINCT cell) / count(*), 6) AS distinct_ratio FROM order_cells GROUP BY ALL)
SELECT header, count(*) AS n_columns, count(*) FILTER (WHERE header IN ('partkey', 'suppkey', 'line_key')) AS n_key_like,
  round(avg(distinct_ratio), 4) AS mean_ratio FROM c GROUP BY header""",
)
def key_share(spark, d):
    tables, cells = whole_tables(spark, d)
    columns = P.key_columns_in_record(tables)
    if cells is not None:
        columns = columns.unionByName(P.key_columns(cells))
    return columns.groupBy("header").agg(
        F.count("*").alias("n_columns"),
        F.count_if("key_like").alias("n_key_like"),
        F.round(F.avg("distinct_ratio"), 4).alias("mean_ratio"),
    )


@query(
    "attractors",
    """WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n_matches, count(DISTINCT l_orderkey) AS n_sources
  FROM lineitem GROUP BY 1, 2)
SELECT *, (SELECT CAST(sum(n_matches) AS BIGINT) FROM c) AS n_total, (SELECT count(*) FROM c) AS n_targets
FROM c ORDER BY n_matches DESC, l_suppkey, l_returnflag LIMIT 20""",
)
def attractors(spark, d):
    """Every line item is a top match of its order's table to a (supplier table, column)."""
    matches = load(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_orderkey")
    return P.attractors(matches, ["l_suppkey", "l_returnflag"], "l_orderkey", 20)


@query(
    "gold_audit",
    """WITH t AS (SELECT l_orderkey, count(*) FILTER (WHERE l_quantity <= 10) AS n_rows FROM lineitem GROUP BY 1),
g AS (SELECT c_mktsegment AS split, o_custkey AS query_id, n_rows FROM orders
      JOIN customer ON c_custkey = o_custkey LEFT JOIN t ON l_orderkey = o_orderkey),
q AS (SELECT split, query_id, bool_and(coalesce(n_rows, 0) = 0) AS ae, bool_or(coalesce(n_rows, 0) = 0) AS se,
      bool_or(n_rows IS NULL) AS mi FROM g GROUP BY 1, 2)
SELECT coalesce(split, 'total') AS split, count(*) AS n_queries, count(*) FILTER (WHERE ae) AS n_all_empty,
  count(*) FILTER (WHERE se) AS n_some_empty, count(*) FILTER (WHERE mi) AS n_missing FROM q GROUP BY ROLLUP (split)""",
)
def gold_audit(spark, d):
    """Customers ask for their orders' tables; only small quantities were materialized."""
    sizes = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count_if(F.col("l_quantity") <= 10).alias("n_rows")
    )
    customers = load(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("split")
    )
    gold = load(spark, d, "orders").select("o_orderkey", "o_custkey").join(sizes, "o_orderkey", "left")
    gold = gold.join(customers, "o_custkey")
    return P.gold_audit(gold.select("split", F.col("o_custkey").alias("query_id"), "n_rows"))


@query(
    "missing_gold",
    f"""WITH {QUESTIONS_SQL},
asked AS (SELECT query_id, db_id, t1 AS t FROM questions UNION SELECT query_id, db_id, t2 FROM questions)
SELECT query_id, db_id || '#sep#' || t AS table_id FROM asked a
WHERE NOT EXISTS (SELECT 1 FROM catalog c WHERE c.db_id = a.db_id AND c.table_name = a.t)""",
)
def missing_gold(spark, d):
    asked = questions(spark, d).select(
        "query_id", "db_id", F.explode(F.array_distinct("required_tables")).alias("name")
    ).select("query_id", T.table_id("db_id", "name").alias("table_id"))
    return asked.join(catalog(spark, d), "table_id", "left_anti")


@query(
    "corpus_totals",
    f"""WITH {QUESTIONS_SQL}
SELECT count(DISTINCT db_id) AS n_databases, count(*) AS n_tables, CAST(sum(n_rows) AS BIGINT) AS n_rows,
  count(*) FILTER (WHERE n_rows = 0) AS n_empty, (SELECT count(*) FROM qrels) AS n_links FROM catalog""",
)
def corpus_totals(spark, d):
    return P.corpus_totals(catalog(spark, d), qrels(spark, d))


@query(
    "timing_profile",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median
FROM events GROUP BY event_type""",
)
def timing_profile(spark, d):
    stats = P.exact_medians(load(spark, d, "events"), ["event_type"], "value")
    return stats.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query(
    "key_bounds",
    """SELECT l_suppkey, min(l_orderkey) AS low, max(l_orderkey) AS high, count(*) AS n_rows FROM lineitem GROUP BY 1""",
)
def key_bounds(spark, d):
    return load(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"), F.count("*").alias("n_rows")
    )


@query(
    "catalog_listing",
    f"""WITH {QUESTIONS_SQL}
SELECT db_id, count(*) AS n_tables, min(table_name) AS first_table, max(table_name) AS last_table,
  (SELECT count(*) FROM catalog) AS n_total FROM catalog GROUP BY db_id""",
)
def catalog_listing(spark, d):
    tables = catalog(spark, d)
    total = tables.agg(F.count("*")).scalar()
    listing = tables.groupBy("db_id").agg(
        F.count("*").alias("n_tables"),
        F.min("table_name").alias("first_table"),
        F.max("table_name").alias("last_table"),
    )
    return listing.withColumn("n_total", total)


@query(
    "named_databases",
    f"""WITH {QUESTIONS_SQL}
SELECT 'listed' AS mode, db_id, count(*) AS n_tables FROM catalog WHERE db_id IN ('db1', 'db4', 'db9') GROUP BY db_id
UNION ALL SELECT 'all', db_id, count(*) FROM catalog GROUP BY db_id""",
)
def named_databases(spark, d):
    def count(mode, names):
        kept = catalog(spark, d).filter(named_or_all("db_id", names))
        return kept.groupBy("db_id").agg(F.count("*").alias("n_tables")).select(F.lit(mode).alias("mode"), "db_id", "n_tables")

    return count("listed", ["db1", "db4", "db9"]).unionByName(count("all", None))


@query(
    "schema_cache",
    f"""WITH {QUESTIONS_SQL} SELECT db_id, count(*) AS n_tables, string_agg(table_name, ',' ORDER BY table_name) AS tables FROM catalog GROUP BY db_id""",
)
def schema_cache(spark, d):
    """The table names of each database, stored as JSON lines and read back."""
    path = scratch_path(spark, "schema-cache")
    listed = catalog(spark, d).groupBy("db_id").agg(F.array_sort(F.collect_list("table_name")).alias("tables"))
    listed.write.json(path)
    cached = spark.read.schema("db_id string, tables array<string>").json(path)
    return cached.select("db_id", F.size("tables").cast("bigint").alias("n_tables"), F.array_join("tables", ",").alias("tables"))


def readings(spark, d):
    """Events as device readings: the user is the host, an error event is a failed poll."""
    return load(spark, d, "events").select(
        F.col("user_id").alias("host"),
        "ts",
        "event_id",
        F.lit(500).alias("memory_total_mb"),
        F.col("value").alias("memory_used_mb"),
        F.get_json_object("props", "$.k").cast("int").alias("utilization_percent"),
        (F.col("event_type") == "error").alias("failed"),
    )


READINGS_SQL = """readings AS (
  SELECT user_id AS host, ts, event_id, value AS used, CAST(json_extract_string(props, '$.k') AS INTEGER) AS util,
         event_type = 'error' AS failed FROM events)"""


@query(
    "device_summary",
    f"""WITH {READINGS_SQL}
SELECT host, count(*) FILTER (WHERE NOT failed AND 500 - used >= 450 AND util <= 30) AS n_free, count(*) AS n_total,
  count(*) FILTER (WHERE failed) AS n_failed FROM readings GROUP BY host""",
)
def device_summary(spark, d):
    return P.device_summary(readings(spark, d), min_free_mb=450, max_util=30)


@query(
    "skip_reasons",
    f"""WITH {QUESTIONS_SQL},
r AS (SELECT q.query_id, CASE WHEN trim(question) = '' THEN 'no_question'
   WHEN style = 'Multi-turn Dialogue' THEN 'excluded_style' WHEN x.n IS NULL THEN 'no_tables' ELSE 'kept' END AS reason
  FROM questions q LEFT JOIN (SELECT query_id, count(*) AS n FROM qrels GROUP BY 1) x ON x.query_id = q.query_id)
SELECT reason, count(*) AS n FROM r GROUP BY reason""",
)
def skip_reasons(spark, d):
    return classify_questions(questions(spark, d), qrels(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))
