"""The given wide tables seen as a corpus of many small tables.

Every order is one table: its line items are the rows, all of them for audits, at most
50 in hash order where a table must fit one record; six attributes are the columns, ten consecutive orders form one
database. Blank cells are injected by key modulo, so that missing-value operators
have work to do. The number of tables grows with the data, their size does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableseek.functions.hashing import hash_key
from tableseek.functions.text import table_id
from tableseek.model import MAX_ROWS_PER_TABLE
from tableseek.operators.ranking import ordinal, row_in_small_group, top_k
from tableseek.plans.registry import load
from tableseek.session import materialize, spread

ROWS_IN_RECORD = 4096  # tables of more rows are worked on as long cells

LINE_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "qty", "ship"]
LINE_ORDER = [*LINE_KEY, "flag"]
LINE_CELLS = ["l_linenumber", "l_partkey", "l_suppkey", "qty", "flag", "ship"]  # as HEADERS
HEADERS = ["line_key", "partkey", "suppkey", "quantity", "return_flag", "ship_date"]
FOREIGN_KEYS = ("partkey", "suppkey")


def _lines(spark: SparkSession, sf_dir: str, max_rows: int | None) -> DataFrame:
    """l_orderkey and LINE_ORDER of the kept line items; where rows are cut, they are dealt by l_orderkey."""
    lines = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag"
    )
    li = spread(lines).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.col("l_shipdate").cast("date").alias("ship"),
        F.when(F.col("l_partkey") % 7 == 0, F.lit(""))
        .when(F.col("l_suppkey") % 11 == 0, F.lit(" "))
        .otherwise(F.col("l_returnflag"))
        .alias("flag"),
    )
    if max_rows is None:
        return li
    # half as long as the digest's text, in the same order
    keyed = li.withColumn("_h", F.unhex(hash_key("l_orderkey", *LINE_KEY)))
    return top_k(keyed, ["l_orderkey"], ["_h", *LINE_ORDER], max_rows, pieces=1).drop("_h", "rank")


def _order_id() -> Column:
    # as SQL's concat, which leaves out a NULL key
    db = F.concat_ws("", F.lit("db"), F.floor(F.col("l_orderkey") / 10).cast("string"))
    return table_id(db, F.concat_ws("", F.lit("order"), F.col("l_orderkey").cast("string"))).alias("table_id")


def order_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_id, l_orderkey and n_rows of every table, all rows counted; reads and moves the line items' keys only."""
    counts = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_rows"))
    return counts.select(_order_id(), "l_orderkey", "n_rows")


def order_rows(spark: SparkSession, sf_dir: str, max_rows: int | None = MAX_ROWS_PER_TABLE) -> DataFrame:
    """One row per kept line item: table_id, row_idx and the six text attributes. None keeps all."""
    kept = _lines(spark, sf_dir, max_rows)
    if max_rows is None:
        # a table of any size: its rows are ranked in runs of line numbers
        kept = ordinal(kept, ["l_orderkey"], LINE_ORDER, F.floor(F.col("l_linenumber") / 64), "row_idx")
    else:
        kept = kept.withColumn("row_idx", row_in_small_group(["l_orderkey"], LINE_ORDER) - 1)
    texts = [F.col(c).cast("string").alias(h) for c, h in zip(LINE_CELLS, HEADERS)]
    return kept.select(_order_id(), "l_orderkey", F.col("row_idx").cast("int").alias("row_idx"), *texts)


ORDER_ROWS_SQL = """
li AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS qty,
         strftime(l_shipdate, '%Y-%m-%d') AS ship,
         CASE WHEN l_partkey % 7 = 0 THEN '' WHEN l_suppkey % 11 = 0 THEN ' ' ELSE l_returnflag END AS flag
  FROM lineitem),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY
    md5(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, ship)),
    l_linenumber, l_partkey, l_suppkey, qty, ship, flag) AS hr FROM li),
order_rows AS (
  SELECT concat('db', l_orderkey // 10, '#sep#order', l_orderkey) AS table_id, l_orderkey,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY
           l_linenumber, l_partkey, l_suppkey, qty, ship, flag) - 1 AS INTEGER) AS row_idx,
         CAST(l_linenumber AS VARCHAR) AS line_key, CAST(l_partkey AS VARCHAR) AS partkey,
         CAST(l_suppkey AS VARCHAR) AS suppkey, CAST(qty AS VARCHAR) AS quantity,
         flag AS return_flag, ship AS ship_date
  FROM kept WHERE hr <= 50)"""


ALL_ROWS_SQL = ORDER_ROWS_SQL.replace(" WHERE hr <= 50", "")


def order_cells(spark: SparkSession, sf_dir: str, max_rows: int | None = MAX_ROWS_PER_TABLE) -> DataFrame:
    """Long form: table_id, col_idx, row_idx, header, cell."""
    rows = order_rows(spark, sf_dir, max_rows)
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("col_idx"), F.lit(h).alias("header"), F.col(h).alias("cell"))
            for i, h in enumerate(HEADERS)
        ]
    )
    return rows.select("table_id", "row_idx", F.inline(cells))


ORDER_CELLS_SQL = (
    ORDER_ROWS_SQL
    + ",\norder_cells AS (\n  "
    + "\n  UNION ALL ".join(
        f"SELECT table_id, row_idx, {i} AS col_idx, '{h}' AS header, {h} AS cell FROM order_rows"
        for i, h in enumerate(HEADERS)
    )
    + ")"
)


ALL_CELLS_SQL = ORDER_CELLS_SQL.replace(" WHERE hr <= 50", "")


def _texts(rows: str, name: str) -> Column:
    return F.transform(rows, lambda r: r[name].cast("string"))


def order_tables(spark: SparkSession, sf_dir: str, max_rows: int | None = MAX_ROWS_PER_TABLE) -> DataFrame:
    """Nested form: table_id, table_name, columns. A table is one record, so its rows must fit one.

    Line items are gathered by their order's number, by which cut ones are dealt already; texts are made in the record."""
    return _nested(_lines(spark, sf_dir, max_rows))


def _nested(lines: DataFrame) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct(*LINE_ORDER))).alias("_rows")
    gathered = lines.groupBy("l_orderkey").agg(rows)
    columns = F.array(
        *[
            F.struct(F.lit(h).alias("header"), _texts("_rows", c).alias("cells"), F.lit(h in FOREIGN_KEYS).alias("is_foreign_key"))
            for c, h in zip(LINE_CELLS, HEADERS)
        ]
    )
    named = gathered.select(_order_id(), columns.alias("columns"))
    return named.select("table_id", F.split("table_id", "#sep#", 2)[1].alias("table_name"), "columns")


def whole_tables(spark: SparkSession, sf_dir: str, longest: int = ROWS_IN_RECORD) -> tuple[DataFrame, DataFrame | None]:
    """All rows of all tables, for work that needs no order of rows: nested as order_tables, and longer tables as long cells.

    Tables of more than ``longest`` rows are found by counting and come as table_id, col_idx, header, cell, is_foreign_key; None
    where there are none."""
    lines = _lines(spark, sf_dir, None)
    counted = order_shapes(spark, sf_dir).filter(F.col("n_rows") > longest)
    long = materialize(counted.select(F.col("l_orderkey").alias("_long")), "long-tables")
    if long.isEmpty():
        return _nested(lines), None
    is_long = F.col("l_orderkey").eqNullSafe(F.col("_long"))
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("col_idx"), F.lit(h).alias("header"), F.col(c).cast("string").alias("cell"), F.lit(h in FOREIGN_KEYS).alias("is_foreign_key"))
            for i, (c, h) in enumerate(zip(LINE_CELLS, HEADERS))
        ]
    )
    return _nested(lines.join(long, is_long, "left_anti")), lines.join(long, is_long, "left_semi").select(_order_id(), F.inline(cells))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per order; the own order and one neighbour of its database are gold."""
    k = F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        k.alias("query_id"),
        F.concat_ws(" ", F.lit("find"), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM")).alias("question"),
        F.concat(F.lit("db"), F.floor(k / 10).cast("string")).alias("db_id"),
        F.array(
            F.concat(F.lit("order"), k.cast("string")),
            F.concat(F.lit("order"), (F.floor(k / 10) * 10 + F.col("o_custkey") % 10).cast("string")),
        ).alias("required_tables"),
        F.when(k % 13 == 0, F.lit("Multi-turn Dialogue")).when(k % 17 == 0, F.lit(None)).otherwise(F.lit("plain")).alias("style"),
    )


QUESTIONS_SQL = """
questions AS (
  SELECT o_orderkey AS query_id, concat_ws(' ', 'find', o_orderpriority, strftime(o_orderdate, '%Y-%m')) AS question,
         'db' || (o_orderkey // 10) AS db_id, 'order' || o_orderkey AS t1,
         'order' || ((o_orderkey // 10) * 10 + o_custkey % 10) AS t2,
         CASE WHEN o_orderkey % 13 = 0 THEN 'Multi-turn Dialogue' WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'plain' END AS style
  FROM orders),
catalog AS (
  SELECT 'db' || (l_orderkey // 10) AS db_id, 'order' || l_orderkey AS table_name,
         'db' || (l_orderkey // 10) || '#sep#order' || l_orderkey AS table_id, count(*) AS n_rows
  FROM lineitem GROUP BY l_orderkey),
qrels AS (
  SELECT DISTINCT q.query_id, q.db_id, c.table_id
  FROM (SELECT query_id, db_id, t1 AS t FROM questions UNION SELECT query_id, db_id, t2 FROM questions) q
  JOIN catalog c ON c.db_id = q.db_id AND c.table_name = q.t)"""


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that exist: db_id, table_name, table_id, n_rows."""
    key = F.col("l_orderkey")
    db = F.concat(F.lit("db"), F.floor(key / 10).cast("string"))
    name = F.concat(F.lit("order"), key.cast("string"))
    counts = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_rows"))
    return counts.select(
        db.alias("db_id"), name.alias("table_name"), table_id(db, name).alias("table_id"), "n_rows"
    )


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, db_id, table_id of the gold tables that exist."""
    asked = questions(spark, sf_dir).select(
        "query_id", "db_id", F.explode(F.array_distinct("required_tables")).alias("table_name")
    )
    return asked.join(catalog(spark, sf_dir), ["db_id", "table_name"]).select("query_id", "db_id", "table_id")


def stored_gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Catalog and qrels written once, for plans that read them several times."""
    tables = materialize(catalog(spark, sf_dir), "catalog")
    asked = questions(spark, sf_dir).select(
        "query_id", "db_id", F.explode(F.array_distinct("required_tables")).alias("table_name")
    )
    found = asked.join(tables, ["db_id", "table_name"]).select("query_id", "db_id", "table_id")
    return tables, materialize(found, "qrels")
