"""Readers for the file formats of the table model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.functions.hashing import hash_key
from tableseek.model import CORPUS, MAX_ROWS_PER_TABLE, QUESTION, READING, WEB_LINE
from tableseek.operators.cells import parse_corpus
from tableseek.operators.ranking import global_ids, small_or_unhinted
from tableseek.session import materialize


def scan_web_dump(spark: SparkSession, folder: str, pattern: str = "*.json.gz") -> tuple[DataFrame, DataFrame]:
    """Good lines and unreadable lines of all gzip JSON files below ``folder``.

    gzip files do not split, so the number of files sets the read parallelism. The good lines are parsed and written once, as they
    are read; ``_at`` is their place in what was written of their file, and ``_part`` names it.
    """
    text = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("ignoreCorruptFiles", True)
        .text(folder)
        .select("value", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = text.filter(F.trim("value") != "").withColumn("_r", F.from_json("value", f"{WEB_LINE}, _bad STRING", options))
    broken = F.col("_r").isNull() | F.col("_r._bad").isNotNull()
    bad = parsed.filter(broken).select("_file", F.col("value").alias("line"))
    good = materialize(parsed.filter(~broken).select("_file", "_line", "_r.relation", "_r.pageTitle"), "web")
    return good.select("*", F.col("_metadata.file_path").alias("_part"), F.col("_metadata.row_index").alias("_at")), bad


def web_columns(relation: str | Column, key: Column, max_rows: int = MAX_ROWS_PER_TABLE, seed: int = 42) -> Column:
    """Cleaned columns of a web table; above max_rows a seeded row sample in original order.

    The rows are chosen once per table by the longest column, so all columns keep the
    same rows. Everything happens inside the row.
    """
    relation = F.col(relation) if isinstance(relation, str) else relation
    place = lambda i: F.struct(hash_key(key, i, seed=seed).alias("h"), i.alias("i"))

    def rows(n: Column) -> Column:
        every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        sampled = F.sort_array(F.transform(F.slice(F.sort_array(F.transform(every, place)), 1, max_rows), lambda x: x["i"]))
        return F.when(n <= max_rows, every).otherwise(sampled)

    def cleaned(real: Column, chosen: Column) -> Column:
        return F.transform(
            real,
            lambda c: F.struct(
                T.clean_text(F.get(c, F.lit(0))).alias("header"),
                F.transform(F.filter(chosen, lambda i: i < F.size(c)), lambda i: T.clean_text(F.get(c, i))).alias("cells"),
                F.lit(False).alias("is_foreign_key"),
            ),
        )

    longest = lambda real: F.coalesce(F.array_max(F.transform(real, lambda c: F.size(c) - 1)), F.lit(0))
    real = F.filter(relation, lambda c: c.isNotNull() & (F.size(c) > 0))
    return T.held(real, lambda real: T.held(T.held(longest(real), rows), lambda chosen: cleaned(real, chosen)))


def _line_ids(good: DataFrame, start: int) -> DataFrame:
    """Dense ids (_id) in file and line order. A file that was written in one piece is numbered by the places of its lines, so
    that no line is moved; with a file in several pieces lines are sorted."""
    if not {"_part", "_at"} <= set(good.columns):
        return global_ids(good, ["_file", "_line"], start, name="_id")
    files = good.groupBy("_file").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.min("_part").alias("_low"), F.max("_part").alias("_high")
    )
    files = materialize(files, "files")
    if files.filter("_low <> _high OR _last - _first + 1 <> _n").limit(1).count():
        return global_ids(good.drop("_part", "_at"), ["_file", "_line"], start, name="_id")
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    starts = files.select("_file", (F.coalesce(before, F.lit(0)) - F.col("_first") + start).alias("_start"))
    placed = good.join(small_or_unhinted(starts), "_file")
    return placed.withColumn("_id", (F.col("_start") + F.col("_at")).cast("bigint")).drop("_part", "_at", "_start")


def web_documents(good: DataFrame, start: int = 0, max_rows: int = MAX_ROWS_PER_TABLE, seed: int = 42) -> DataFrame:
    """Corpus records of web tables with dense ids in file and line order.

    Carries both page_title and table_name: stored corpora use either.
    """
    numbered = _line_ids(good, start)
    shaped = numbered.select(
        F.col("_id").cast("string").alias("id"),
        T.clean_text("pageTitle").alias("page_title"),
        web_columns("relation", F.col("_id"), max_rows, seed).alias("columns"),
    ).withColumn("_even", T.trim_ragged("columns"))  # once a record, and not once a row of it
    return shaped.select(
        "id",
        F.col("id").alias("table_id"),
        "page_title",
        F.col("page_title").alias("table_name"),
        F.transform("columns", lambda c: c["header"]).alias("column_names"),
        F.size("columns").alias("num_columns"),
        T.render_document("page_title", "_even").alias("contents"),
    )


def scan_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus JSONL; page_title stands in for a missing table_name."""
    raw = spark.read.schema(f"{CORPUS}, page_title STRING").json(path)
    return raw.withColumn("table_name", F.coalesce("table_name", "page_title")).drop("page_title")


def corpus_tables(spark: SparkSession, path: str) -> DataFrame:
    """Parsed tables of a corpus file that have at least one column."""
    parsed = parse_corpus(scan_corpus(spark, path))
    return parsed.filter(F.size("columns") > 0).select("id", "table_name", "columns", "n_skipped", "source")


def corpus_texts(spark: SparkSession, path: str) -> DataFrame:
    return scan_corpus(spark, path).select("id", "contents")


def find_databases(spark: SparkSession, root: str) -> DataFrame:
    """db_id and path of every SQLite file below a root; only listings are read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.sqlite")
        .load(root)
        .select("path")
    )
    return files.select(F.regexp_extract("path", r"([^/]+)\.sqlite$", 1).alias("db_id"), "path")


def unresolved_databases(wanted: DataFrame, found: DataFrame) -> DataFrame:
    return wanted.select("db_id").distinct().join(found, "db_id", "left_anti")


def scan_records(spark: SparkSession, paths: list[str], record: str, line_sep: str | None = None) -> DataFrame:
    """Whole JSON files that hold a list of records, or a dict of them; one row per record.

    Rows keep ``file_order``, the position of their file in ``paths``. With ``line_sep``
    every line is such a list or dict of its own.
    """
    frames = None
    for order, path in enumerate(paths):
        text = spark.read.text(path, wholetext=True) if line_sep is None else spark.read.text(path, lineSep=line_sep)
        as_list = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{record}>>"))
        as_dict = F.map_values(F.from_json("value", f"map<string, struct<{record}>>"))
        rows = text.select(F.explode(F.coalesce(as_list, as_dict)).alias("_r")).select("_r.*", F.lit(order).alias("file_order"))
        frames = rows if frames is None else frames.unionByName(rows)
    return frames


def latest_record(records: DataFrame, key: str) -> DataFrame:
    """The record of the last file wins."""
    payload = [c for c in records.columns if c not in (key, "file_order")]
    best = F.max_by(F.struct(*payload), F.col("file_order")).alias("_r")
    return records.groupBy(key).agg(best).select(key, "_r.*")


def scan_questions(spark: SparkSession, splits: dict[str, str], multi_line: bool = True) -> DataFrame:
    """Question files by source split; the SQL text may be under SQL or query."""
    frames = None
    for split, path in splits.items():
        rows = (
            spark.read.schema("question STRING, db_id STRING, SQL STRING, query STRING")
            .option("multiLine", multi_line)
            .option("caseSensitive", True)
            .json(path)
        )
        rows = rows.select("question", "db_id", F.coalesce("SQL", "query").alias("sql"), F.lit(split).alias("source_split"))
        frames = rows if frames is None else frames.unionByName(rows)
    return frames


def scan_normalized_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).json(path)


def scan_readings(spark: SparkSession, path: str) -> DataFrame:
    """Five comma-separated fields per device; a malformed number fails the job."""
    return (
        spark.read.schema(READING)
        .option("mode", "FAILFAST")
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def scan_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Per-model results.json files; the folder is the model name."""
    rows = spark.read.schema("test_map DOUBLE, test_mrr DOUBLE").json(pattern)
    return rows.withColumn("model", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def scan_matches(spark: SparkSession, path: str) -> DataFrame:
    """Top-1 column alignments of ranked match records."""
    schema = (
        "query_table_name STRING, top_matches ARRAY<STRUCT<table_name: STRING, "
        "column_alignment: ARRAY<STRUCT<query_column: STRING, matched_column: STRING>>>>"
    )
    records = spark.read.schema(schema).json(path)
    best = records.select("query_table_name", F.get("top_matches", F.lit(0)).alias("_m"))
    aligned = best.select("query_table_name", F.col("_m.table_name").alias("table_name"), F.explode("_m.column_alignment").alias("_a"))
    return aligned.select("query_table_name", "table_name", "_a.query_column", "_a.matched_column")
