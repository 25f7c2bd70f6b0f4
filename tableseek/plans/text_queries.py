"""Cell and document text: cleaning, typing, rendering, parsing, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.operators import cells as C
from tableseek.operators.ranking import global_ids
from tableseek.plans.lowering import ALL_CELLS_SQL, ALL_ROWS_SQL, HEADERS, ORDER_CELLS_SQL, ORDER_ROWS_SQL, order_cells, order_rows, order_tables
from tableseek.plans.registry import load, query

_CLEAN = "trim(regexp_replace(coalesce({0}, ''), '[\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"


def clean_sql(col: str) -> str:
    return _CLEAN.format(col)


@query(
    "clean_text",
    f"""
SELECT page_id, md5({clean_sql('html')}) AS html_md5, CAST(length({clean_sql('html')}) AS INTEGER) AS n_chars,
       CASE WHEN {clean_sql("split_part(html, '<body', 1)")} = '' THEN '[EMPTY]'
            ELSE {clean_sql("split_part(html, '<body', 1)")} END AS head_text,
       {clean_sql("split_part(html, '<p>', 2)")} = '' AS missing_first_paragraph
FROM pages""",
)
def clean_text(spark, d):
    pages = load(spark, d, "pages")
    head = F.split_part("html", F.lit("<body"), F.lit(1))
    first = F.split_part("html", F.lit("<p>"), F.lit(2))
    return pages.select(
        "page_id",
        F.md5(T.clean_text("html")).alias("html_md5"),
        F.length(T.clean_text("html")).alias("n_chars"),
        T.clean_cell(head).alias("head_text"),
        T.is_missing(first).alias("missing_first_paragraph"),
    )


def _amount_cell():
    k = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    whole = F.floor(cents / 100).cast("string")
    return (
        F.when(k % 11 == 0, F.concat(F.lit("$ "), whole))
        .when(k % 11 == 1, F.concat(F.lit("1,"), whole, F.lit(".5")))
        .when(k % 11 == 2, F.concat(whole, F.lit("%")))
        .when(k % 11 == 3, F.concat(F.lit("1_"), whole))
        .when(k % 11 == 4, F.concat(whole, F.lit("d")))
        .when(k % 11 == 5, F.lit("-"))
        .when(k % 11 == 6, F.lit("inf"))
        .when(k % 11 == 7, F.lit("NaN"))
        .when(k % 11 == 8, F.concat(F.lit("-."), whole))
        .when(k % 11 == 9, F.lit(" "))
        .otherwise(F.col("o_orderpriority"))
    )


_DIG = "[0-9](?:_?[0-9])*"
_FLOAT = f"^[+-]?(?:{_DIG}(?:\\.(?:{_DIG})?)?|\\.{_DIG})(?:[eE][+-]?{_DIG})?$"
_AMOUNT_SQL = """
amounts AS (
  SELECT o_orderkey, CASE o_orderkey % 11
    WHEN 0 THEN concat('$ ', w) WHEN 1 THEN concat('1,', w, '.5') WHEN 2 THEN concat(w, '%')
    WHEN 3 THEN concat('1_', w) WHEN 4 THEN concat(w, 'd') WHEN 5 THEN '-' WHEN 6 THEN 'inf'
    WHEN 7 THEN 'NaN' WHEN 8 THEN concat('-.', w) WHEN 9 THEN ' ' ELSE o_orderpriority END AS cell
  FROM (SELECT *, CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS VARCHAR) AS w FROM orders)),
stripped AS (SELECT *, regexp_replace(cell, '[,$%\\s]', '', 'g') AS s FROM amounts),
parsed AS (
  SELECT *, CASE WHEN regexp_matches(s, '@FLOAT') THEN CAST(replace(s, '_', '') AS DOUBLE)
    WHEN lower(s) = 'nan' THEN CAST('nan' AS DOUBLE) WHEN lower(s) = 'inf' THEN CAST('inf' AS DOUBLE) END AS v
  FROM stripped)""".replace("@FLOAT", _FLOAT)


@query(
    "numeric_cells",
    f"""WITH {_AMOUNT_SQL}
SELECT o_orderkey, cell, CASE WHEN isfinite(v) THEN v END AS number,
       CASE WHEN v IS NULL THEN 'text' ELSE 'numeric' END AS cell_type,
       coalesce(NOT isfinite(v), false) AS nonfinite
FROM parsed""",
)
def numeric_cells(spark, d):
    cells = load(spark, d, "orders").select("o_orderkey", _amount_cell().alias("cell"))
    number = T.parse_numeric("cell")
    bad = F.coalesce(T.is_nonfinite(number), F.lit(False))
    return cells.select(
        "o_orderkey",
        "cell",
        F.when(~bad, number).alias("number"),
        T.cell_type("cell").alias("cell_type"),
        bad.alias("nonfinite"),
    )


@query(
    "column_types",
    f"""WITH {ALL_CELLS_SQL}
SELECT table_id, col_idx, header,
  CASE WHEN count(*) FILTER (WHERE trim(cell) <> '') > 0 AND
    count(*) FILTER (WHERE regexp_matches(replace(trim(cell), ',', ''), '{_FLOAT}'))
      >= 0.8 * count(*) FILTER (WHERE trim(cell) <> '') THEN 'real' ELSE 'text' END AS kind
FROM order_cells GROUP BY ALL""",
)
def column_types(spark, d):
    return C.column_types(order_cells(spark, d, None))


_DOC_SQL = (
    ORDER_ROWS_SQL
    + """,
docs AS (
  SELECT table_id, concat('[TABLE]
', split_part(table_id, '#sep#', 2), '

[SCHEMA]
line_key | partkey | suppkey | quantity | return_flag | ship_date

[ROWS]', string_agg(concat('
', concat_ws(' | ', line_key, partkey, suppkey, quantity, return_flag, ship_date)), '' ORDER BY row_idx)) AS contents,
  count(*) AS n_rows
  FROM order_rows GROUP BY table_id)"""
)


@query("doc_contents", f"WITH {_DOC_SQL} SELECT table_id, md5(contents) AS contents_md5, n_rows FROM docs")
def doc_contents(spark, d):
    tables = order_tables(spark, d)
    return tables.select(
        "table_id",
        F.md5(T.render_document("table_name", "columns")).alias("contents_md5"),
        T.shortest_column("columns").cast("bigint").alias("n_rows"),
    )


@query(
    "doc_roundtrip",
    f"""WITH {ORDER_ROWS_SQL},
marked AS (SELECT *, CASE WHEN CAST(suppkey AS BIGINT) % 9 = 0 THEN concat(suppkey, ' | x')
                          WHEN CAST(suppkey AS BIGINT) % 9 = 1 THEN concat(suppkey, chr(10), 'y') ELSE suppkey END AS sk
           FROM order_rows),
lines AS (SELECT table_id, row_idx, unnest(string_split(
            concat_ws(' | ', line_key, partkey, sk, quantity, return_flag, ship_date), chr(10))) AS line FROM marked),
split AS (SELECT *, string_split(line, ' | ') AS p FROM lines)
SELECT table_id, count(*) FILTER (WHERE len(p) >= 6) AS n_rows, count(*) FILTER (WHERE len(p) < 6) AS n_skipped,
       CAST(sum(CASE WHEN len(p) >= 6 THEN length(array_to_string(p[6:], ' | ')) ELSE 0 END) AS BIGINT) AS last_chars
FROM split GROUP BY table_id""",
)
def doc_roundtrip(spark, d):
    """Stray separators and line breaks inside cells; ragged lines are skipped and counted."""
    names = HEADERS
    tables = order_tables(spark, d).select(
        "table_id",
        "table_name",
        F.transform(
            "columns",
            lambda c: F.when(
                c["header"] == "suppkey",
                c.withField(
                    "cells",
                    F.transform(
                        c["cells"],
                        lambda v: F.when(v.cast("bigint") % 9 == 0, F.concat(v, F.lit(" | x")))
                        .when(v.cast("bigint") % 9 == 1, F.concat(v, F.lit("\ny")))
                        .otherwise(v),
                    ),
                ),
            ).otherwise(c),
        ).alias("columns"),
    )
    docs = tables.select(
        "table_id",
        T.render_document("table_name", "columns").alias("contents"),
        F.array(*[F.lit(n) for n in names]).alias("column_names"),
    )
    parsed = C.parse_corpus(docs, "contents", "column_names")
    last = F.transform(F.element_at("columns", -1)["cells"], lambda v: F.length(v))
    return parsed.select(
        "table_id",
        T.shortest_column("columns").cast("bigint").alias("n_rows"),
        F.col("n_skipped").cast("bigint").alias("n_skipped"),
        F.aggregate(last, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("last_chars"),
    )


@query(
    "table_ids",
    """SELECT 'db' || (l_orderkey // 10) || '#sep#order#sep#' || l_orderkey AS table_id,
  'db' || (l_orderkey // 10) AS db_id, 'order#sep#' || l_orderkey AS table_name,
  90266199 + row_number() OVER (ORDER BY l_orderkey) - 1 AS id,
  'db' || (l_orderkey // 10) || '#sep#order#sep#' || l_orderkey || '#c6#r' || n AS shape_key
FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)""",
)
def table_ids(spark, d):
    tables = load(spark, d, "lineitem").groupBy("l_orderkey").count()
    numbered = global_ids(tables, ["l_orderkey"], start=90266199)
    key = F.col("l_orderkey").cast("string")
    db = F.concat(F.lit("db"), F.floor(F.col("l_orderkey") / 10).cast("string"))
    named = numbered.withColumn("table_id", T.table_id(db, F.concat(F.lit("order#sep#"), key)))
    return named.select(
        "table_id",
        T.db_of("table_id").alias("db_id"),
        T.table_of("table_id").alias("table_name"),
        "id",
        T.shape_key("table_id", F.lit("6"), F.col("count").cast("string")).alias("shape_key"),
    )


@query(
    "capped_columns",
    f"""WITH {ORDER_CELLS_SQL}
SELECT table_id, string_agg(header, ',' ORDER BY col_idx) AS headers
FROM (SELECT DISTINCT table_id, col_idx, header FROM order_cells WHERE col_idx < 4) GROUP BY table_id""",
)
def capped_columns(spark, d):
    capped = T.cap_columns("columns", 4)
    return order_tables(spark, d).select(
        "table_id", F.array_join(F.transform(capped, lambda c: c["header"]), ",").alias("headers")
    )


@query(
    "query_text",
    f"""WITH {ORDER_CELLS_SQL},
vals AS (SELECT table_id, string_agg(trim(cell), ' ' ORDER BY row_idx, col_idx) AS v
         FROM order_cells WHERE trim(cell) <> '' GROUP BY table_id)
SELECT table_id, array_to_string(string_split(concat_ws(' ', split_part(table_id, '#sep#', 2),
  'line_key partkey suppkey quantity return_flag ship_date', v), ' ')[1:20], ' ') AS query_text FROM vals""",
)
def query_text(spark, d):
    return C.query_texts(order_tables(spark, d), max_terms=20)


@query(
    "typed_filler",
    """WITH typed AS (
  SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'bigint' WHEN 1 THEN 'POINT' WHEN 2 THEN 'Decimal(9,2)'
    WHEN 3 THEN 'timestamp' ELSE 'varchar' END AS declared FROM orders),
drawn AS (SELECT *, CAST(('0x' || substr(md5(concat_ws('|', '42', o_orderkey)), 1, 15)) AS BIGINT) AS n FROM typed)
SELECT o_orderkey, declared, CASE
  WHEN upper(declared) LIKE '%INT%' THEN CAST(n % 100001 AS VARCHAR)
  WHEN declared LIKE 'Dec%' THEN concat((n % 1000001) // 100, '.', lpad(CAST((n % 1000001) % 100 AS VARCHAR), 2, '0'))
  WHEN declared = 'timestamp' THEN strftime(DATE '2000-01-01' + CAST(n % 9132 AS INTEGER), '%Y-%m-%d') END AS filler
FROM drawn""",
)
def typed_filler(spark, d):
    k = F.col("o_orderkey")
    declared = (
        F.when(k % 5 == 0, "bigint").when(k % 5 == 1, "POINT").when(k % 5 == 2, "Decimal(9,2)")
        .when(k % 5 == 3, "timestamp").otherwise("varchar")
    )
    rows = load(spark, d, "orders").select("o_orderkey", declared.alias("declared"))
    return rows.select("o_orderkey", "declared", C.typed_filler("declared", "o_orderkey").alias("filler"))


@query(
    "gold_name_lists",
    """SELECT conv_id, turn, name FROM (
  SELECT conv_id, turn, unnest(CASE WHEN conv_id % 2 = 0 THEN [role, 'turn' || turn] ELSE [role] END) AS name
  FROM conversations)""",
)
def gold_name_lists(spark, d):
    """Gold tables given either as a JSON list or as one bare name."""
    name = F.concat(F.lit("turn"), F.col("turn").cast("string"))
    raw = F.when(
        F.col("conv_id") % 2 == 0, F.to_json(F.array(F.col("role"), name))
    ).otherwise(F.col("role"))
    rows = load(spark, d, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return rows.select("conv_id", "turn", F.explode(T.as_name_list("raw")).alias("name"))


@query(
    "fingerprints",
    """SELECT doc_id, sha256(text) AS content_sha, substr(sha256(source), 1, 12) AS db_key,
  sha256(concat_ws(chr(1), text, source, concat_ws(chr(2), 'a' || (doc_id % 3), 'b' || (doc_id % 5)))) AS question_key
FROM documents""",
)
def fingerprints(spark, d):
    docs = load(spark, d, "documents")
    gold = F.array(
        F.concat(F.lit("b"), (F.col("doc_id") % 5).cast("string")),
        F.concat(F.lit("a"), (F.col("doc_id") % 3).cast("string")),
    )
    return docs.select(
        "doc_id",
        T.fingerprint("text").alias("content_sha"),
        T.short_fingerprint("source").alias("db_key"),
        T.question_key("text", "source", gold).alias("question_key"),
    )


@query(
    "token_budget",
    f"""WITH {ORDER_CELLS_SQL},
counted AS (SELECT table_id, row_idx, col_idx, least(len(list_filter(regexp_split_to_array(
    lower(concat(header, ' : ', CASE WHEN trim(cell) = '' THEN '[EMPTY]' ELSE trim(cell) END)), '[^\\p{{L}}\\p{{N}}]+'),
    lambda x: x <> '')), 32) AS n FROM order_cells),
running AS (SELECT *, 1 + coalesce(sum(n + 1) OVER (PARTITION BY table_id ORDER BY row_idx, col_idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM counted),
flagged AS (SELECT *, max(CASE WHEN used + n + 1 >= 64 THEN 1 ELSE 0 END) OVER (PARTITION BY table_id
    ORDER BY row_idx, col_idx ROWS UNBOUNDED PRECEDING) AS over FROM running)
SELECT table_id, row_idx, col_idx, CAST(used AS BIGINT) AS span_start, CAST(used + n AS BIGINT) AS span_end
FROM flagged WHERE over = 0""",
)
def token_budget(spark, d):
    return C.pack_cells(order_cells(spark, d), max_tokens=64)


@query(
    "cell_sequences",
    f"""WITH {ORDER_CELLS_SQL},
kinds AS (SELECT table_id, col_idx,
  CASE WHEN count(*) FILTER (WHERE trim(cell) <> '') > 0 AND
    count(*) FILTER (WHERE regexp_matches(replace(trim(cell), ',', ''), '{_FLOAT}'))
      >= 0.8 * count(*) FILTER (WHERE trim(cell) <> '') THEN 'real' ELSE 'text' END AS kind
  FROM order_cells GROUP BY ALL),
parts AS (SELECT c.table_id, c.col_idx, c.row_idx + 1 AS row_idx,
  concat_ws(' ', header, kind, CASE WHEN trim(cell) = '' THEN '[EMPTY]' ELSE trim(cell) END) AS t
  FROM order_cells c JOIN kinds k USING (table_id, col_idx)),
heads AS (SELECT DISTINCT c.table_id, c.col_idx, 0 AS row_idx, concat_ws(' ', header, kind, header) AS t
  FROM order_cells c JOIN kinds k USING (table_id, col_idx))
SELECT table_id, 'column' AS view, col_idx AS idx, md5(string_agg(t, ' [SEP] ' ORDER BY row_idx)) AS seq_md5
FROM (SELECT * FROM parts UNION ALL SELECT * FROM heads) GROUP BY table_id, col_idx
UNION ALL
SELECT table_id, 'row' AS view, row_idx - 1 AS idx, md5(string_agg(t, ' [SEP] ' ORDER BY col_idx)) AS seq_md5
FROM parts GROUP BY table_id, row_idx""",
)
def cell_sequences(spark, d):
    views = C.sequence_views(order_tables(spark, d))
    return views.select("table_id", "view", "idx", F.md5("sequence").alias("seq_md5"))


@query(
    "header_rows",
    f"""WITH {ALL_CELLS_SQL}
SELECT table_id, col_idx, row_idx + 1 AS row_idx, concat(header, ' : ',
  CASE WHEN trim(cell) = '' THEN '[EMPTY]' ELSE trim(cell) END) AS cell_text FROM order_cells
UNION ALL SELECT DISTINCT table_id, col_idx, 0 AS row_idx, header AS cell_text FROM order_cells""",
)
def header_rows(spark, d):
    placed = C.with_header_row(order_cells(spark, d, None))
    text = F.when(F.col("row_idx") == 0, F.col("cell")).otherwise(T.header_cell_text("header", "cell"))
    return placed.select("table_id", "col_idx", "row_idx", text.alias("cell_text"))


@query(
    "table_validation",
    f"""WITH {ALL_ROWS_SQL},
rowsz AS (SELECT table_id, row_idx, CASE WHEN CAST(partkey AS BIGINT) % 50 = 0 THEN 5 ELSE 6 END AS w FROM order_rows)
SELECT table_id, count(*) AS n_rows, bool_and(w = 6) AS valid FROM rowsz GROUP BY table_id""",
)
def table_validation(spark, d):
    """Rows whose part key is a multiple of 50 lose their last cell."""
    rows = order_rows(spark, d, None)
    full = F.array(*HEADERS)
    ragged = F.when(F.col("partkey").cast("bigint") % 50 == 0, F.slice(full, 1, 5)).otherwise(full)
    tables = rows.groupBy("table_id").agg(F.collect_list(ragged).alias("rows"))
    headers = F.array(*[F.lit(h) for h in HEADERS])
    return tables.select(
        "table_id",
        F.size("rows").cast("bigint").alias("n_rows"),
        T.is_valid_table(headers, F.col("rows")).alias("valid"),
    )
