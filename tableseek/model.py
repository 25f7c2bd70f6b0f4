"""Schemas of the table model."""

from __future__ import annotations

COLUMN = "STRUCT<header: STRING, cells: ARRAY<STRING>, is_foreign_key: BOOLEAN>"
TABLE = f"table_id STRING, table_name STRING, columns ARRAY<{COLUMN}>"
CORPUS = "id STRING, table_name STRING, column_names ARRAY<STRING>, contents STRING, source STRING"
WEB_LINE = "relation ARRAY<ARRAY<STRING>>, pageTitle STRING"
QUESTION = (
    "question STRING, db_id STRING, required_tables ARRAY<STRING>, "
    "style STRING, source_split STRING, sql STRING"
)
READING = "index INT, name STRING, memory_total_mb INT, memory_used_mb INT, utilization_percent INT"
SCHEMA_RECORD = (
    "db_id STRING, table_names_original ARRAY<STRING>, column_names_original ARRAY<ARRAY<STRING>>, "
    "column_types ARRAY<STRING>, foreign_keys ARRAY<ARRAY<INT>>"
)

# Fixed values that stored corpora depend on.
TABLE_ID_SEPARATOR = "#sep#"
MAX_ROWS_PER_TABLE = 50
MAX_COLUMNS_PER_TABLE = 20
FIRST_DATABASE_TABLE_ID = 90266199
TABLE_MARKER = "[TABLE]\n"
SCHEMA_MARKER = "\n\n[SCHEMA]\n"
ROWS_MARKER = "\n\n[ROWS]"
CELL_SEPARATOR = " | "
EMPTY_CELL = "[EMPTY]"
