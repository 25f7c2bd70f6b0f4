"""Table lineage of SQL texts.

The names behind FROM and JOIN are found statement by statement in an Arrow-batched
helper (a fold with the same steps as built-in array functions was fifty times slower);
everything else is joins: names resolve against the catalog, so table expressions and
aliases that are not catalog tables drop out.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tableseek.functions.text import exploded, is_missing, question_key
from tableseek.operators.sampling import keep_first
from tableseek.session import materialize

# The token pattern and the clause words that end a source list.
TOKENS = re.compile(
    r"--[^\n]*|/\*.*?\*/|'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|"
    r"`(?:``|[^`])*`|\[[^\]]*\]|[A-Za-z_][A-Za-z0-9_$]*|[(),.;]",
    re.DOTALL,
)
# A doubled quote ends one literal and begins the next, which is the same noise.
NOISE_PATTERN = r"(?s)--[^\n]*|/\*.*?\*/|'[^']*'"
CLAUSE_WORDS = [
    "where", "group", "order", "having", "limit", "union", "intersect",
    "except", "window", "returning", "qualify", "on",
]
SOURCE_MODIFIERS = ["only", "lateral"]
AST_TABLE = r'\["table_unit",\s*(\d+)'


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _identifier(token: str) -> str:
    if token[0] in "\"`":
        return token[1:-1].replace(token[0] * 2, token[0])
    return token[1:-1] if token[0] == "[" else token


def _names_in_source_position(sql: str | None) -> list[str]:
    """Names where a table source is expected, in order; of dotted names the last part.

    One frame per open parenthesis: "none" outside a source list, "next" where a source
    must follow, "list" behind a source. Only the innermost frame decides, so commas of
    nested calls never start a source.
    """
    frames, names = ["none"], []
    after_name = after_dot = False
    for token in TOKENS.findall(sql or ""):
        if token.startswith(("--", "/*", "'")):
            continue
        word = token.lower()
        continued, expected = after_dot and token not in "(),;", frames[-1] == "next"
        after_dot, after_name = token == "." and after_name, False
        if continued:
            names[-1], after_name = _identifier(token), True
        elif token == "(":
            frames[-1] = "list" if expected else frames[-1]
            frames.append("none")
        elif token == ")":
            frames = frames[:-1] or ["none"]
        elif word in ("from", "join") or (token == "," and frames[-1] != "none"):
            frames[-1] = "next"
        elif word in CLAUSE_WORDS:
            frames[-1] = "none"
        elif expected and word not in SOURCE_MODIFIERS and token not in ",;.":
            frames[-1], after_name = "list", True
            names.append(_identifier(token))
    return names


@F.pandas_udf(ArrayType(StringType()))
def _source_names(batch: pd.Series) -> pd.Series:
    return batch.map(_names_in_source_position)


def source_names(sql: str | Column) -> Column:
    return _source_names(_c(sql))


def syntax_tables(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, table_name, pos) of catalog tables in FROM and JOIN positions, first mention."""
    named = exploded(queries, source_names("sql"), "_n", "query_id", "db_id", position="pos")
    low = catalog.select("db_id", "table_name", F.lower("table_name").alias("_low"))
    found = named.withColumn("_low", F.lower("_n")).join(low, ["db_id", "_low"])
    return found.groupBy("query_id", "table_name").agg(F.min("pos").alias("pos"))


def mentioned_tables(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query_id, table_name) of catalog names that occur as a word or quoted outside literals.

    Statements and names meet by an equi-join on (database, word): plain names on the whole
    name, other names on their first word, followed by a test of the full name. A name
    without any word character has no such key and is searched for in its database.
    """
    scrubbed = queries.select("query_id", "db_id", F.lower(F.regexp_replace("sql", NOISE_PATTERN, " ")).alias("_s"))
    words = F.split(F.lower("table_name"), r"[^a-z0-9_]+")
    names = catalog.select(
        "db_id", "table_name", F.lower("table_name").alias("_full"), F.get(F.array_remove(words, ""), F.lit(0)).alias("_low")
    )
    used = exploded(scrubbed, F.array_distinct(F.split("_s", r"[^a-z0-9_]+")), "_low", "query_id", "db_id")
    met = used.join(names, ["db_id", "_low"]).select("query_id", "table_name", "_low", "_full")
    plain = met.filter(F.col("_low") == F.col("_full")).select("query_id", "table_name")
    bare = names.filter(F.col("_low").isNull())
    unkeyed = scrubbed.join(bare, "db_id").select("query_id", "table_name", "_s", "_full")
    keyed = met.filter(F.col("_low") != F.col("_full")).join(scrubbed, "query_id")
    candidates = keyed.select("query_id", "table_name", "_s", "_full").unionByName(unkeyed)
    literal = F.regexp_replace("_full", r"(\W)", r"\\$1")  # a quoted block would end at a name's own \E
    pattern = F.concat(F.lit("(?<![a-z0-9_])"), literal, F.lit("(?![a-z0-9_])"))
    found = candidates.filter(F.regexp_like("_s", pattern)).select("query_id", "table_name")
    return plain.unionByName(found).distinct()


def resolve_lineage(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Tables per statement with the path taken.

    The syntax result holds where it names the same set as the mentions do; otherwise
    the mentions decide. One statement's tables are few, so they meet in one small group.
    """
    syntax = syntax_tables(queries, catalog).select("query_id", "table_name", "pos", F.lit(True).alias("_syn"))
    mention = mentioned_tables(queries, catalog).withColumn("_men", F.lit(True))
    both = syntax.join(mention, ["query_id", "table_name"], "full_outer")
    per_query = both.groupBy("query_id").agg(
        F.every(F.col("_syn").isNotNull() & F.col("_men").isNotNull()).alias("_same"),
        F.array_sort(
            F.collect_list(F.struct(F.coalesce("pos", F.lit(1_000_000)).alias("pos"), "table_name", "_men"))
        ).alias("_all"),
    )
    ordered = F.transform("_all", lambda x: x["table_name"])
    mentioned = F.array_sort(F.transform(F.filter("_all", lambda x: x["_men"]), lambda x: x["table_name"]))
    return per_query.select(
        "query_id",
        F.when(F.col("_same"), "syntax").otherwise("mentions").alias("path"),
        F.when(F.col("_same"), ordered).otherwise(mentioned).alias("tables"),
    )


def ast_tables(queries: DataFrame, schemas: DataFrame) -> DataFrame:
    """Tables of a nested query tree kept as JSON text, sorted by table index.

    Input queries(query_id, db_id, ast), schemas(db_id, table_names ARRAY<STRING>).
    """
    indices = F.array_distinct(F.transform(F.regexp_extract_all("ast", F.lit(AST_TABLE), F.lit(1)), lambda i: i.cast("int")))
    found = queries.select("query_id", "db_id", F.array_sort(indices).alias("_i")).join(schemas, "db_id")
    known = F.filter("_i", lambda i: i < F.size("table_names"))
    return found.select("query_id", F.transform(known, lambda i: F.get("table_names", i)).alias("tables"))


def normalize_questions(
    questions: DataFrame, catalog: DataFrame, order: str = "query_id", schemas: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Kept questions with their tables, and the skip reasons.

    Input questions(query_id, question, db_id, sql) and, with schemas(db_id, table_names), ast: a query tree as JSON. A
    question needs a known database, text, SQL and at least one resolvable table; these are the reasons, in this order. Tables
    come from the tree where it names some that the catalog has, else from the SQL. Of equal (question, database,
    tables) the first stays.
    """
    resolved = resolve_lineage(questions, catalog).withColumnRenamed("tables", "required_tables")
    if schemas is not None:
        low = catalog.select("db_id", "table_name", F.lower("table_name").alias("_low"))
        named = ast_tables(questions.filter("ast IS NOT NULL"), schemas)
        placed = named.select("query_id", F.posexplode("tables").alias("_pos", "_n")).withColumn("_low", F.lower("_n"))
        met = placed.join(questions.select("query_id", "db_id"), "query_id").join(low, ["db_id", "_low"])
        listed = met.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "table_name"))).alias("_t"))
        trees = listed.select("query_id", F.transform("_t", lambda x: x["table_name"]).alias("_tree"))
        both = resolved.join(trees, "query_id", "full_outer")
        resolved = both.select(
            "query_id", F.when(F.col("_tree").isNotNull(), "tree").otherwise(F.col("path")).alias("path"), F.coalesce("_tree", "required_tables").alias("required_tables")
        )
    known = catalog.select("db_id").distinct().withColumn("_known", F.lit(True))
    joined = questions.join(resolved, "query_id", "left").join(known, "db_id", "left")
    reason = (
        F.when(F.col("_known").isNull(), "missing_database")
        .when(is_missing("question"), "missing_question")
        .when(is_missing("sql"), "missing_sql")
        .when(F.coalesce(F.size("required_tables"), F.lit(0)) <= 0, "no_tables")
    )
    # Three results read the resolved questions, so they are written once.
    classified = materialize(joined.withColumn("reason", reason).drop("_known"), "questions")
    complete = classified.filter(F.col("reason").isNull()).drop("reason")
    keyed = complete.withColumn("query_key", question_key(F.trim("question"), "db_id", "required_tables"))
    kept = keep_first(keyed, ["query_key"], order)
    duplicates = complete.agg(F.count("*").alias("_n")).select(
        F.lit("duplicate").alias("reason"), (F.col("_n") - kept.agg(F.count("*")).scalar()).alias("n")
    )
    skipped = classified.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))
    return kept, skipped.unionByName(duplicates).filter("n > 0")
