"""Work on one capped table stays in its record: same rows as over long cells, and no cell is moved."""

import json

from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.operators import cells as C
from tableseek.operators import ranking
from tableseek.operators import sampling as S
from tableseek.plans import QUERIES
from tableseek.sources import readers

SF = "/root/testdata/sf0.001"


def nested(spark):
    column = "array<struct<header:string,cells:array<string>,is_foreign_key:boolean>>"
    rows = [("d#sep#a", [("x", ["1", " ", None], False), ("y y", ["b", "c  c", "d"], True)]), ("d#sep#b", [("x", [], False)]), ("d#sep#c", [])]
    return spark.createDataFrame(rows, f"table_id string, columns {column}")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_shuffled_records_equal_shuffled_cells(spark, collect_rows):
    long = C.explode_tables(nested(spark)).select("table_id", "col_idx", "row_idx", "header", "cell")
    assert S.shuffle_tables(nested(spark)).collect() and sorted(map(str, S.shuffle_tables(nested(spark)).collect())) == sorted(map(str, S.shuffle_cells(long).collect()))


def test_shuffled_tables_move_line_items_once(spark):
    assert exchanges(QUERIES["shuffled_tables"](spark, SF)) == 1


def test_top_k_of_one_piece(spark, collect_rows):
    df = spark.range(500).withColumn("g", F.col("id") % 3)
    assert collect_rows(ranking.top_k(df, ["g"], ["id"], 4, pieces=1)) == collect_rows(ranking.top_k(df, ["g"], ["id"], 4))


def test_pivot_roundtrip_in_the_record(spark):
    back = nested(spark).select("table_id", C.nested_in_record(C.cells_in_record("columns")).alias("columns"))
    got = {r.table_id: [(c.header, c.cells) for c in r.columns] for r in back.collect()}
    assert got == {"d#sep#a": [("x", ["1", " ", None]), ("y y", ["b", "c  c", "d"])], "d#sep#b": [], "d#sep#c": []}
    assert exchanges(QUERIES["pivot_roundtrip"](spark, SF)) == 1


def test_sequence_views_of_records(spark):
    got = {(r.view, r.idx): r.sequence for r in C.sequence_views(nested(spark).limit(1), " / ").collect()}
    assert got[("column", 0)] == "x real x / x real 1 / x real [EMPTY] / x real [EMPTY]"
    assert got[("row", 1)] == "x real [EMPTY] / y y text c c" and len(got) == 5
    assert exchanges(QUERIES["cell_sequences"](spark, SF)) == 1


def test_float_test_is_one_search(spark):
    values = ["1", "1,000", "1_0", "1__0", "_1", "1_", ".5", "5.", "1e5", "+-1", "iNf", "-Infinity", "NaN", "nano", " 7 ", "", None, "$1", "1d"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(T.parses_as_float("v")).collect()
    assert [v for v, r in zip(values, got) if r[0]] == ["1", "1,000", "1_0", ".5", "5.", "1e5", "iNf", "-Infinity", "NaN", " 7 "]


def test_web_lines_are_numbered_where_they_are(spark, tmp_path):
    import gzip

    for name, n in (("b", 3), ("a", 2), ("c", 4)):
        lines = [x for i in range(n) for x in (json.dumps({"relation": [["h", "v"]], "pageTitle": f"{name}{i}"}), '{"relation": [[')]
        with gzip.open(tmp_path / f"{name}.json.gz", "wt") as f:
            f.write("\n".join(lines))
    good, bad = readers.scan_web_dump(spark, str(tmp_path))
    want = [f"{name}{i}" for name, n in (("a", 2), ("b", 3), ("c", 4)) for i in range(n)]
    docs = readers.web_documents(good)
    assert [r.page_title for r in docs.orderBy(F.col("id").cast("int")).collect()] == want and bad.count() == 9
    assert "Exchange" not in docs._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "").replace("Exchange SinglePartition", "")
    torn = good.withColumn("_at", F.col("_at") * 2)  # as if a file had been written in pieces
    assert [r.page_title for r in readers.web_documents(torn).orderBy(F.col("id").cast("int")).collect()] == want
