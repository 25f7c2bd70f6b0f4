"""Operators on long cells(table_id, col_idx, row_idx, header, cell) and nested tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.functions.hashing import hash_mod
from tableseek.model import EMPTY_CELL, MAX_COLUMNS_PER_TABLE


def explode_tables(tables: DataFrame) -> DataFrame:
    """Nested tables to long cells, ragged tails dropped."""
    by_column = tables.select("table_id", F.posexplode(T.trim_ragged("columns")).alias("col_idx", "_col"))
    return by_column.select(
        "table_id",
        "col_idx",
        F.col("_col.header").alias("header"),
        F.col("_col.is_foreign_key").alias("is_foreign_key"),
        F.posexplode("_col.cells").alias("row_idx", "cell"),
    )


def nest_cells(cells: DataFrame) -> DataFrame:
    """Long cells of capped tables back to one nested row per table."""
    columns = cells.groupBy("table_id", "col_idx", "header").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("row_idx", "cell"))), lambda x: x["cell"]
        ).alias("cells")
    )
    nested = columns.groupBy("table_id").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", "header", "cells"))).alias("_cols")
    )
    shape = F.transform(
        "_cols",
        lambda c: F.struct(
            c["header"].alias("header"), c["cells"].alias("cells"), F.lit(False).alias("is_foreign_key")
        ),
    )
    return nested.select("table_id", shape.alias("columns"))


def cells_in_record(columns: str | Column) -> Column:
    """Long cells (col_idx, row_idx, header, cell) of one table's nested columns, ragged tails dropped, as a list."""
    by_column = F.transform(
        T.trim_ragged(columns),
        lambda c, i: F.transform(c["cells"], lambda v, j: F.struct(i.alias("col_idx"), j.alias("row_idx"), c["header"].alias("header"), v.alias("cell"))),
    )
    return F.flatten(by_column)


def nested_in_record(cells: str | Column) -> Column:
    """As nest_cells, for the long cells of one table in a list."""
    cells = F.col(cells) if isinstance(cells, str) else cells
    named = F.sort_array(F.array_distinct(F.transform(cells, lambda x: F.struct(x["col_idx"].alias("col_idx"), x["header"].alias("header")))))
    own = lambda k: F.filter(cells, lambda x: (x["col_idx"] == k["col_idx"]) & x["header"].eqNullSafe(k["header"]))
    placed = lambda k: F.sort_array(F.transform(own(k), lambda x: F.struct(x["row_idx"].alias("row_idx"), x["cell"].alias("cell"))))
    return F.transform(
        named, lambda k: F.struct(k["header"].alias("header"), F.transform(placed(k), lambda x: x["cell"]).alias("cells"), F.lit(False).alias("is_foreign_key"))
    )


def cap_columns(cells: DataFrame, limit: int = MAX_COLUMNS_PER_TABLE) -> DataFrame:
    return cells.filter(F.col("col_idx") < limit)


def parse_corpus(docs: DataFrame, contents: str = "contents", names: str = "column_names") -> DataFrame:
    """Stored documents to nested tables; unreadable documents get zero columns."""
    parsed = docs.withColumn("_p", T.parse_document(contents, names))
    empty = F.array().cast("array<struct<header: string, cells: array<string>, is_foreign_key: boolean>>")
    columns = F.when(F.col("_p").isNull(), empty).otherwise(T.columns_from_rows(F.col(names), F.col("_p.rows")))
    return parsed.withColumn("columns", columns).withColumn(
        "n_skipped", F.coalesce(F.col("_p.n_skipped"), F.lit(0))
    ).drop("_p")


def drop_empty_tables(tables: DataFrame) -> DataFrame:
    return tables.filter((F.size("columns") > 0) & (T.shortest_column("columns") > 0))


def column_types(cells: DataFrame, threshold: float = 0.8) -> DataFrame:
    """real where at least the threshold share of the non-empty cells parses as a float."""
    filled = F.count_if(~T.is_missing("cell"))
    numeric = F.count_if(~T.is_missing("cell") & T.parses_as_float("cell"))
    real = (filled > 0) & (numeric >= threshold * filled)
    return cells.groupBy("table_id", "col_idx", "header").agg(
        F.when(real, F.lit("real")).otherwise(F.lit("text")).alias("kind")
    )


def sequence_views(tables: DataFrame, separator: str = " [SEP] ", caption: Column | None = None, threshold: float = 0.8) -> DataFrame:
    """Column view (header cell first) and row view of every capped table (table_id, columns) as joined text.

    A table is one record, so its types, texts and views are made inside it; cells are not moved. Columns that are shorter than others
    leave out their cells.
    """
    text = lambda v: F.when(v == "", F.lit(EMPTY_CELL)).otherwise(v)
    measured = F.transform(
        "columns",
        lambda c: F.struct(
            T.clean_cell(c["header"]).alias("header"),
            F.transform(c["cells"], T.clean_text).alias("cells"),
            F.size(F.filter(c["cells"], T.parses_as_float)).alias("numeric"),
        ),
    )
    filled = lambda c: F.size(F.array_remove(c["cells"], ""))
    real = lambda c: (filled(c) > 0) & (c["numeric"] >= threshold * filled(c))
    typed = F.transform(
        measured, lambda c: F.struct(F.concat_ws(" ", c["header"], F.when(real(c), "real").otherwise("text")).alias("prefix"), c["header"].alias("header"), c["cells"].alias("cells"))
    )
    texts = F.transform(
        typed,
        lambda c: F.struct(
            F.concat_ws(" ", c["prefix"], c["header"]).alias("head"),
            F.transform(c["cells"], lambda v: F.concat_ws(" ", c["prefix"], text(v))).alias("cells"),
        ),
    )
    n = F.coalesce(F.array_max(F.transform("_t", lambda c: F.size(c["cells"]))), F.lit(0))
    rows = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    view = lambda kind, idx, parts: F.struct(F.lit(kind).alias("view"), idx.alias("idx"), parts.alias("sequence"))
    by_column = F.transform("_t", lambda c, i: view("column", i, F.concat_ws(separator, c["head"], c["cells"])))
    by_row = F.transform(rows, lambda r: view("row", r, F.concat_ws(separator, F.transform("_t", lambda c: F.get(c["cells"], r)))))
    given = tables.select("table_id", texts.alias("_t"), (F.lit(None).cast("string") if caption is None else caption).alias("_caption"))
    # the outer form with a test: the plain one would have all texts made twice, for a test of the list's size
    views = given.select("table_id", "_caption", F.inline_outer(F.concat(by_column, by_row))).filter("view IS NOT NULL")
    return views.select("table_id", "view", "idx", F.concat_ws(separator, "_caption", "sequence").alias("sequence"))


def with_header_row(cells: DataFrame) -> DataFrame:
    """Headers placed as row 0 above the data rows."""
    headers = cells.select("table_id", "col_idx", "header").distinct()
    top = headers.select("table_id", "col_idx", F.lit(0).alias("row_idx"), "header", F.col("header").alias("cell"))
    below = cells.select("table_id", "col_idx", (F.col("row_idx") + 1).alias("row_idx"), "header", "cell")
    return top.unionByName(below)


def pack_cells(cells: DataFrame, max_tokens: int = 512, cell_tokens: int = 32) -> DataFrame:
    """Token span of every cell that fits the budget; whole cells only, row-major prefix.

    One token is taken by the opening marker and one separator follows every cell.
    The windows run over one capped table each.
    """
    n = F.least(F.size(T.tokens(T.header_cell_text("header", "cell"))), F.lit(cell_tokens))
    order = Window.partitionBy("table_id").orderBy("row_idx", "col_idx")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    used = cells.withColumn("_n", n).withColumn(
        "_used", F.lit(1).cast("bigint") + F.coalesce(F.sum(F.col("_n") + 1).over(before), F.lit(0))
    )
    overflow = (F.col("_used") + F.col("_n") + 1 >= max_tokens).cast("int")
    fits = used.withColumn("_over", F.max(overflow).over(so_far)).filter(F.col("_over") == 0)
    return fits.select(
        "table_id", "row_idx", "col_idx", F.col("_used").alias("span_start"),
        (F.col("_used") + F.col("_n")).alias("span_end"),
    )


def query_texts(tables: DataFrame, max_terms: int = 1000) -> DataFrame:
    """Query text of a seed table: name, headers and all non-empty cells, capped in terms."""
    rows = F.flatten(T.row_major("columns"))
    filled = F.filter(F.transform(rows, T.clean_text), lambda v: v != "")
    headers = F.array_join(F.transform("columns", lambda c: c["header"]), " ")
    text = F.concat_ws(" ", T.clean_text("table_name"), headers, F.array_join(filled, " "))
    return tables.select("table_id", T.capped_terms(text, max_terms).alias("query_text"))


def typed_filler(declared: str | Column, *keys: str | Column, seed: int = 42) -> Column:
    """Seeded placeholder for a column without any real value, by declared type.

    The tests run in this order: INT (so POINT counts as INT), real types, dates;
    text stays NULL.
    """
    declared = F.upper(F.coalesce(F.col(declared) if isinstance(declared, str) else declared, F.lit("")))
    cents = hash_mod(1_000_001, *keys, seed=seed)
    real = F.concat(
        F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
    )
    day = F.date_add(F.lit("2000-01-01").cast("date"), hash_mod(9132, *keys, seed=seed).cast("int"))
    return (
        F.when(declared.contains("INT"), hash_mod(100_001, *keys, seed=seed).cast("string"))
        .when(declared.rlike("REAL|FLOA|DOUB|NUMERIC|DECIMAL"), real)
        .when(declared.rlike("DATE|TIME"), day.cast("string"))
    )
