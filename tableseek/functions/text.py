"""Cell and document text: cleaning, parsing, rendering, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableseek.model import (
    CELL_SEPARATOR,
    EMPTY_CELL,
    ROWS_MARKER,
    SCHEMA_MARKER,
    TABLE_ID_SEPARATOR,
    TABLE_MARKER,
)

# Float grammar of the cell parser: optional sign, digits with single underscores
# between them, optional fraction and exponent, or the inf / nan words. Underscores are
# tested apart, so no group repeats: a repeated group costs the matcher stack per digit.
FLOAT_GRAMMAR = r"^[+-]?(?:[0-9][0-9_]*+(?:\.[0-9_]*+)?|\.[0-9][0-9_]*+)(?:[eE][+-]?[0-9][0-9_]*+)?$"
STRAY_UNDERSCORE = r"_(?![0-9])|(?<![0-9])_"
INF_GRAMMAR = r"^[+-]?(?:inf|infinity)$"
NAN_GRAMMAR = r"^[+-]?nan$"
FLOAT_OR_WORD = f"{FLOAT_GRAMMAR}|^[+-]?(?i:inf|infinity|nan)$"
KEY_HEADER = r"(^|_)(id|uuid|guid|key)($|_)"


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def held(value: Column, use) -> Column:
    """use(value), with the value computed once a record, however often it is named and inside of whatever function."""
    return F.transform(F.array(value), use)[0]


def clean_text(value: str | Column) -> Column:
    text = F.coalesce(_c(value).cast("string"), F.lit(""))
    # Most cells hold no whitespace at all; a search is cheaper than a replacement, and plain ASCII cheaper than Unicode.
    collapsed = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(text.rlike(r"[^!-~]"), collapsed).otherwise(text)


def clean_cell(value: str | Column) -> Column:
    text = clean_text(value)
    return F.when(text == "", F.lit(EMPTY_CELL)).otherwise(text)


def is_missing(value: str | Column) -> Column:
    return ~F.coalesce(_c(value).rlike(r"(?U)\S"), F.lit(False))


def _to_float(text: Column) -> Column:
    lowered = F.lower(text)
    negative = lowered.startswith("-")
    return (
        F.when(
            text.rlike(FLOAT_GRAMMAR) & ~text.rlike(STRAY_UNDERSCORE), F.regexp_replace(text, "_", "").try_cast("double")
        )
        .when(lowered.rlike(NAN_GRAMMAR), F.lit(float("nan")))
        .when(lowered.rlike(INF_GRAMMAR) & negative, F.lit(float("-inf")))
        .when(lowered.rlike(INF_GRAMMAR), F.lit(float("inf")))
    )


def parse_numeric(cell: str | Column) -> Column:
    """Number in a cell after dropping thousands, currency and percent signs, else NULL."""
    return _to_float(F.regexp_replace(_c(cell), r"(?U)[,$%\s]", ""))


def cell_type(cell: str | Column) -> Column:
    return F.when(parse_numeric(cell).isNotNull(), F.lit("numeric")).otherwise(F.lit("text"))


def parses_as_float(cell: str | Column) -> Column:
    """Column-type test: commas dropped, surrounding blanks allowed, nothing else."""
    text = F.trim(F.translate(_c(cell), ",", ""))
    return F.coalesce(text.rlike(FLOAT_OR_WORD) & ~text.rlike(STRAY_UNDERSCORE), F.lit(False))


def is_nonfinite(number: str | Column) -> Column:
    number = _c(number)
    return F.isnan(number) | number.isin(float("inf"), float("-inf"))


def header_cell_text(header: str | Column, cell: str | Column) -> Column:
    return F.concat_ws(" : ", clean_cell(header), clean_cell(cell))


def typed_cell_text(header: str | Column, kind: str | Column, cell: str | Column) -> Column:
    return F.concat_ws(" ", clean_cell(header), _c(kind), clean_cell(cell))


def is_key_header(header: str | Column) -> Column:
    return F.lower(_c(header)).rlike(KEY_HEADER)


def table_id(db_id: str | Column, table_name: str | Column) -> Column:
    return F.concat_ws(TABLE_ID_SEPARATOR, _c(db_id), _c(table_name))


def db_of(identifier: str | Column) -> Column:
    return F.split(_c(identifier), TABLE_ID_SEPARATOR, 2)[0]


def table_of(identifier: str | Column) -> Column:
    return F.get(F.split(_c(identifier), TABLE_ID_SEPARATOR, 2), F.lit(1))


def shape_key(identifier: str | Column, n_cols: str | Column, n_rows: str | Column) -> Column:
    """Cache key that keeps column-capped and full forms of one table apart."""
    return F.concat(_c(identifier), F.lit("#c"), _c(n_cols), F.lit("#r"), _c(n_rows))


def shortest_column(columns: str | Column) -> Column:
    sizes = F.transform(_c(columns), lambda c: F.size(c["cells"]))
    return F.coalesce(F.array_min(sizes), F.lit(0))


def trim_ragged(columns: str | Column) -> Column:
    columns = _c(columns)
    return held(shortest_column(columns), lambda n: F.transform(columns, lambda c: c.withField("cells", F.slice(c["cells"], F.lit(1), n))))


def cap_columns(columns: str | Column, limit: int = 20) -> Column:
    return F.slice(_c(columns), 1, limit)


def row_major(columns: str | Column) -> Column:
    """ARRAY<ARRAY<STRING>> of rows out of ARRAY<STRUCT<header, cells, …>>."""
    columns = _c(columns)
    n = shortest_column(columns)
    rows = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda r: F.transform(columns, lambda c: F.get(c["cells"], r)),
    )
    return F.when(n > 0, rows).otherwise(F.array().cast("array<array<string>>"))


def render_document(title: str | Column, columns: str | Column) -> Column:
    """The row-major text document of a table; a table without columns is just its title."""
    title, columns = _c(title), _c(columns)
    headers = F.array_join(F.transform(columns, lambda c: c["header"]), CELL_SEPARATOR)
    lines = F.transform(row_major(columns), lambda row: F.concat(F.lit("\n"), F.array_join(row, CELL_SEPARATOR)))
    text = F.concat(
        F.lit(TABLE_MARKER), title, F.lit(SCHEMA_MARKER), headers, F.lit(ROWS_MARKER), F.array_join(lines, "")
    )
    return F.when(F.size(columns) > 0, text).otherwise(title)


def parse_document(contents: str | Column, column_names: str | Column) -> Column:
    """Rows of a stored document as STRUCT<rows, n_skipped>; NULL where the markers are absent."""
    contents, names = _c(contents), _c(column_names)
    schema_split = F.split(contents, r"\n\n\[SCHEMA\]\n", 2)
    rows_split = F.split(F.get(schema_split, F.lit(1)), r"\n\n\[ROWS\]\n", 2)
    block = F.get(rows_split, F.lit(1))
    lines = F.when(block == "", F.array().cast("array<string>")).otherwise(F.split(block, "\n"))
    width = F.size(names)
    cells = F.transform(lines, lambda line: F.split(line, r" \| ", width))
    kept = F.filter(cells, lambda row: F.size(row) == width)
    parsed = F.struct(kept.alias("rows"), (F.size(cells) - F.size(kept)).alias("n_skipped"))
    return F.when((width > 0) & block.isNotNull(), parsed)


def columns_from_rows(column_names: str | Column, rows: str | Column) -> Column:
    """Row-major rows back to ARRAY<STRUCT<header, cells, is_foreign_key>>."""
    names, rows = _c(column_names), _c(rows)
    return F.transform(
        names,
        lambda name, i: F.struct(
            name.alias("header"),
            F.transform(rows, lambda row: F.get(row, i)).alias("cells"),
            F.lit(False).alias("is_foreign_key"),
        ),
    )


def is_valid_table(headers: str | Column, rows: str | Column) -> Column:
    """At least one row and column, and every row as wide as the header."""
    headers, rows = _c(headers), _c(rows)
    return (F.size(headers) > 0) & (F.size(rows) > 0) & F.forall(rows, lambda r: F.size(r) == F.size(headers))


def tokens(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), "")


def exploded(df, array: Column, name: str, *keep, position: str | None = None):
    """One row per element of a computed array.

    The outer form with a NULL test stops the optimizer from testing the array's size
    below the explode, which would compute the array a second time.
    """
    if position is None:
        rows = df.select(*keep, F.explode_outer(array).alias(name))
    else:
        rows = df.select(*keep, F.posexplode_outer(array).alias(position, name))
    return rows.filter(F.col(name).isNotNull())


def first_tokens(text: str | Column, limit: int = 32) -> Column:
    return F.slice(tokens(text), 1, limit)


def capped_terms(text: str | Column, limit: int = 1000) -> Column:
    """At most ``limit`` blank-separated terms of a query text."""
    return F.array_join(F.slice(F.split(_c(text), " "), 1, limit), " ")


def as_name_list(value: str | Column) -> Column:
    """A JSON list of names, or one bare name, as ARRAY<STRING>."""
    value = _c(value)
    looks_like_list = F.ltrim(value).startswith("[")
    return F.when(looks_like_list, F.from_json(value, "array<string>")).otherwise(F.array(value))


def fingerprint(value: str | Column) -> Column:
    return F.sha2(_c(value), 256)


def short_fingerprint(value: str | Column) -> Column:
    return F.substring(fingerprint(value), 1, 12)


def question_key(question: str | Column, db_id: str | Column, tables: str | Column) -> Column:
    """Identity of a question: its text, database and the sorted set of gold tables."""
    return fingerprint(
        F.concat_ws("\u0001", _c(question), _c(db_id), F.array_join(F.array_sort(_c(tables)), "\u0002"))
    )


def power_of_two_ceiling(value: str | Column) -> Column:
    value = F.greatest(_c(value).cast("bigint"), F.lit(1).cast("bigint"))
    return F.when(value == 1, F.lit(1).cast("bigint")).otherwise(
        F.pow(F.lit(2.0), F.length(F.bin(value - 1)).cast("double")).cast("bigint")
    )
