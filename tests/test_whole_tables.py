"""Audits of whole tables: line items are moved once, and tables of any size, keys that are NULL and repeated lines count as in SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tableseek.operators import cells as C
from tableseek.operators import profile as P
from tableseek.operators import structure as S
from tableseek.plans import ORACLES, QUERIES, lowering

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """An order of 700 lines that repeat line numbers and values, an order without a key, NULL cells."""
    folder = tmp_path_factory.mktemp("odd")
    line = "l_quantity, l_extendedprice, l_discount, l_tax"
    duckdb.sql(f"""COPY (
      SELECT * FROM '{SF}/lineitem.parquet' WHERE l_orderkey < 300
      UNION ALL SELECT 700007, l_partkey % 40, l_suppkey, 1, {line}, l_returnflag, l_linestatus, l_shipdate FROM (FROM '{SF}/lineitem.parquet' LIMIT 700)
      UNION ALL SELECT NULL, l_partkey, l_suppkey, l_linenumber, {line}, l_returnflag, l_linestatus, l_shipdate FROM (FROM '{SF}/lineitem.parquet' LIMIT 9)
      UNION ALL SELECT 9001, NULL, NULL, NULL, {line}, NULL, NULL, NULL FROM (FROM '{SF}/lineitem.parquet' LIMIT 3)
    ) TO '{folder}/lineitem.parquet' (FORMAT parquet)""")
    return str(folder)


def in_sql(name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS FROM '{folder}/lineitem.parquet'")
    return con.execute(ORACLES[name]).fetchall()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("longest", [4096, 100, 0])
def test_key_share_of_odd_orders(spark, odd, monkeypatch, longest):
    monkeypatch.setattr(lowering.whole_tables, "__defaults__", (longest,))
    got = {r.header: tuple(r)[1:3] + (round(r.mean_ratio, 4),) for r in QUERIES["key_share"](spark, odd).collect()}
    want = {r[0]: tuple(r[1:3]) + (round(r[3], 4),) for r in in_sql("key_share", odd)}
    assert want and got == want


def test_key_share_moves_line_items_once(spark):
    """One exchange gathers the line items, one adds up the headers."""
    assert plan(QUERIES["key_share"](spark, SF)).count("Exchange hashpartitioning") == 2


def test_key_columns_of_records_equal_those_of_cells(spark, collect_rows):
    column = "array<struct<header:string,cells:array<string>,is_foreign_key:boolean>>"
    tables = [("a", [("user_id", ["1", "1", None], False), ("y", ["b", " ", ""], True), ("z", [None, None, None], False)]), ("b", [("x", [], False)]), ("c", [])]
    nested = spark.createDataFrame(tables, f"table_id string, columns {column}")
    names = ["table_id", "col_idx", "header", "is_fk", "distinct_ratio", "key_like"]
    got = collect_rows(P.key_columns_in_record(nested), *names)
    assert len(got) == 3 and got == collect_rows(P.key_columns(C.explode_tables(nested)), *names)


def test_visible_cells_of_odd_orders(spark, odd, collect_rows):
    got = collect_rows(QUERIES["visible_cells"](spark, odd), "table_id", "row_idx", "col_idx", "n_visible", "position_sum")
    assert got and got == sorted(in_sql("visible_cells", odd))


@pytest.mark.parametrize("piece", [3, 7, 12, 13, 8192])
def test_visible_grid_equals_visible_ranges(spark, collect_rows, piece):
    shapes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 4), ("d", 31)], "table_id string, n_rows int")
    rows = shapes.select("table_id", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row_idx"))
    cells = rows.select("table_id", "row_idx", F.explode(F.array(*map(F.lit, range(3)))).alias("col_idx"))
    caption = shapes.select("table_id", F.lit(-1).alias("row_idx"), F.lit(-1).alias("col_idx"))
    want = S.visible_ranges(cells.unionByName(caption), (F.col("row_idx") * 3 + F.col("col_idx")).cast("bigint"))
    got = S.visible_in_grid(shapes, 3, piece)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert [(c, k) for c, k in got.dtypes if c != "is_global"] == [(c, k) for c, k in want.dtypes if c != "is_global"]
    empty = S.visible_in_grid(spark.createDataFrame([("e", 0)], shapes.schema), 3, piece).collect()
    assert [(r.row_idx, r.col_idx, r.n_visible, r.visible_sum) for r in empty] == [(-1, -1, 1, -4)]


def test_visible_cells_are_not_moved(spark):
    """Line items are counted by key; only starts of long tables' pieces are dealt besides."""
    moved = plan(QUERIES["visible_cells"](spark, SF))
    assert moved.count("Exchange hashpartitioning") <= 3 and "Join" not in moved


def test_long_tables_are_listed_by_several_tasks(spark):
    listed = S.visible_in_grid(spark.createDataFrame([("a", 5000)], "table_id string, n_rows int"), 6, 1000)
    sizes = [r[1] for r in listed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 30001 and max(sizes) < 30001
