import pytest
from hypothesis import HealthCheck, assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.operators import cells as C


def one(spark, expression, **values):
    columns = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*columns).select(expression.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, want",
    [(None, ""), ("  a \t\n b ", "a b"), ("a  b", "a b"), (" x　", "x"), ("plain", "plain")],
)
def test_clean_text(spark, raw, want):
    assert one(spark, T.clean_text("x"), x=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("1,234", 1234.0), ("$ 5.5", 5.5), ("12%", 12.0), ("-", None), (".", None), ("", None), ("1_000", 1000.0),
        ("1__0", None), ("1d", None), ("2f", None), ("1e3", 1000.0), ("+.5", 0.5), ("5.", 5.0), ("0x1", None),
        ("-inf", float("-inf")), ("Infinity", float("inf")), ("abc", None),
    ],
)
def test_numeric_grammar(spark, raw, want):
    assert one(spark, T.parse_numeric("x"), x=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [("1" * 1_000_000, float("inf")), ("1_" * 500_000, None), ("1_" * 500_000 + "1x", None), ("_1", None), ("1_.5", None), ("1._5", None), ("1.5_", None), ("1e5_0", 1e50), ("1e_5", None)],
)
def test_long_and_underscored_numbers(spark, raw, want):
    """No value makes the matcher recurse, however long it is."""
    frame = spark.createDataFrame([(raw,)], "x string")
    assert frame.select(T.parse_numeric("x").alias("r")).first()["r"] == want


def test_nan_parses(spark):
    assert one(spark, F.isnan(T.parse_numeric("x")), x="NaN") is True


CELL = st.text(st.characters(codec="utf-8", exclude_characters="|\n\r", exclude_categories=["Cs"]), max_size=8)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(1, 4).flatmap(lambda n: st.lists(st.lists(CELL, min_size=n, max_size=n), min_size=1, max_size=4)))
def test_document_round_trip(spark, rows):
    assume(rows != [[""]])  # a lone blank cell leaves an empty row block, which reads as no rows
    names = [f"h{i}" for i in range(len(rows[0]))]
    columns = [(n, [row[i] for row in rows], False) for i, n in enumerate(names)]
    df = spark.createDataFrame(
        [("t", columns, names)],
        "title string, columns array<struct<header: string, cells: array<string>, is_foreign_key: boolean>>, column_names array<string>",
    )
    docs = df.select(T.render_document("title", "columns").alias("contents"), "column_names")
    back = C.parse_corpus(docs).first()
    assert [list(c["cells"]) for c in back["columns"]] == [c[1] for c in columns]
    assert back["n_skipped"] == 0


def test_document_edges(spark):
    schema = "title string, columns array<struct<header: string, cells: array<string>, is_foreign_key: boolean>>"
    df = spark.createDataFrame([("none", []), ("zero", [("a", [], False)]), ("ragged", [("a", ["1", "2"], False), ("b", ["x"], False)])], schema)
    got = {r["title"]: r["d"] for r in df.select("title", T.render_document("title", "columns").alias("d")).collect()}
    assert got["none"] == "none"
    assert got["zero"] == "[TABLE]\nzero\n\n[SCHEMA]\na\n\n[ROWS]"
    assert got["ragged"].endswith("[ROWS]\n1 | x")


def test_parse_skips_ragged_rows_and_unmarked_documents(spark):
    docs = spark.createDataFrame(
        [("[TABLE]\nt\n\n[SCHEMA]\na | b\n\n[ROWS]\n1 | 2\nbroken\n3 | 4 | 5", ["a", "b"]), ("no markers", ["a"]), ("[TABLE]\nt\n\n[SCHEMA]\na\n\n[ROWS]", ["a"])],
        "contents string, column_names array<string>",
    )
    got = [(len(r["columns"]), r["n_skipped"], [list(c["cells"]) for c in r["columns"]]) for r in C.parse_corpus(docs).collect()]
    assert got == [(2, 1, [["1", "3"], ["2", "4 | 5"]]), (0, 0, []), (0, 0, [])]


@pytest.mark.parametrize("value, want", [(0, 1), (1, 1), (2, 2), (3, 4), (4, 4), (5, 8), (50, 64)])
def test_power_of_two(spark, value, want):
    assert one(spark, T.power_of_two_ceiling("x"), x=value) == want


def test_table_id_splits_on_the_first_separator(spark):
    assert one(spark, T.db_of("x"), x="db#sep#a#sep#b") == "db"
    assert one(spark, T.table_of("x"), x="db#sep#a#sep#b") == "a#sep#b"


def test_question_key_ignores_table_order(spark):
    a = one(spark, T.question_key("q", "d", F.array(F.lit("x"), F.lit("y"))), q="who", d="db")
    b = one(spark, T.question_key("q", "d", F.array(F.lit("y"), F.lit("x"))), q="who", d="db")
    assert a == b


@pytest.mark.parametrize("raw, want", [('["a", "b"]', ["a", "b"]), ("plain", ["plain"])])
def test_name_lists(spark, raw, want):
    assert one(spark, T.as_name_list("x"), x=raw) == want


@pytest.mark.parametrize(
    "declared, pattern", [("POINT", r"^\d+$"), ("decimal(4,2)", r"^\d+\.\d\d$"), ("datetime", r"^20\d\d-\d\d-\d\d$"), ("text", None), (None, None)]
)
def test_typed_filler(spark, declared, pattern):
    value = one(spark, C.typed_filler(F.col("t"), F.lit(7)), t=declared)
    assert value is None if pattern is None else __import__("re").match(pattern, value)
