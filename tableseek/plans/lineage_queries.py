"""Lineage of SQL texts that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableseek.operators import lineage as L
from tableseek.plans.registry import load, query
from tableseek.session import materialize, scratch_path, spread
from tableseek.sources import writers as W

# Six statement shapes; {a}, {b}, {c} are the order-dependent table names.
SHAPES = [
    "SELECT p.v + q.v FROM {b} p CROSS JOIN {a} q LEFT OUTER JOIN \"big {c}\" USING (k) WHERE q.note <> 'see JOIN {c}'",
    "SELECT count(*) AS n FROM [{b}] AS p INNER JOIN main.{a} AS q ON p.k = q.k -- later FROM {c}",
    "SELECT max(s.v, 1), (SELECT count(*) FROM {b}) FROM (SELECT * FROM {a}) s -- JOIN {c}",
    "SELECT id FROM `{b}` WHERE id IN (SELECT id FROM {c}) UNION SELECT id FROM {a}",
    "SELECT {a}.v FROM {b}, lateral {c} ORDER BY {a}.v, {b}.v",
    "SELECT 1",
]
EXPECTED = [
    ("syntax", ["b", "a", "big c"]),
    ("syntax", ["b", "a"]),
    ("syntax", ["b", "a"]),
    ("syntax", ["b", "c", "a"]),
    ("mentions", ["a", "b", "c"]),
]


def sql_log(spark, d):
    """One statement per order over a per-database catalog of six tables."""
    k = F.col("o_orderkey")
    names = {
        "{a}": F.concat(F.lit("T"), (k % 3).cast("string")),
        "{b}": F.concat(F.lit("t"), (k % 3 + 3).cast("string")),
        "{c}": F.concat(F.lit("t"), (k % 3 + 6).cast("string")),
    }
    shape = F.element_at(F.array(*[F.lit(s) for s in SHAPES]), (k % 6 + 1).cast("int"))
    for mark, name in names.items():
        shape = F.replace(shape, F.lit(mark), name)
    return spread(load(spark, d, "orders").select("o_orderkey", "o_orderpriority")).select(
        k.alias("query_id"), F.concat(F.lit("db"), F.floor(k / 10).cast("string")).alias("db_id"),
        shape.alias("sql"), F.concat_ws(" ", "o_orderpriority", F.floor(k / 40).cast("string")).alias("question"),
    )


def sql_catalog(spark, d):
    names = [f"t{i}" for i in range(9)] + [f"big t{i}" for i in range(6, 9)]
    dbs = load(spark, d, "orders").select(
        F.concat(F.lit("db"), F.floor(F.col("o_orderkey") / 10).cast("string")).alias("db_id")
    ).distinct()
    return dbs.withColumn("table_name", F.explode(F.array(*[F.lit(n) for n in names])))


_N = {"a": "'t' || (o_orderkey % 3)", "b": "'t' || (o_orderkey % 3 + 3)", "c": "'t' || (o_orderkey % 3 + 6)",
      "big c": "'big t' || (o_orderkey % 3 + 6)"}


def _case(item):
    return "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN {item(i)}" for i in range(5)) + " END"


# In shape 0 the quoted "big tN" also counts as a mention of the plain table tN, so the
# mention set differs from the syntax set and decides, in name order.
_PATH = _case(lambda i: "'mentions'" if i == 0 else f"'{EXPECTED[i][0]}'")
_TABLES = _case(
    lambda i: "concat_ws(',', 'big t' || (o_orderkey % 3 + 6), " + ", ".join(_N[x] for x in "abc") + ")"
    if i == 0
    else "concat_ws(',', " + ", ".join(_N[x] for x in EXPECTED[i][1]) + ")"
)
_RESOLVED = f"res AS (SELECT o_orderkey AS query_id, {_PATH} AS path, {_TABLES} AS tables FROM orders WHERE o_orderkey % 6 <> 5)"


@query("sql_lineage", f"WITH {_RESOLVED} SELECT query_id, path, tables FROM res")
def sql_lineage(spark, d):
    found = L.resolve_lineage(sql_log(spark, d), sql_catalog(spark, d))
    return found.select("query_id", "path", F.array_join("tables", ",").alias("tables"))


_SYN = [["b", "a", "big c"], ["b", "a"], ["b", "a"], ["b", "c", "a"], ["b", "c"]]


@query(
    "syntax_lineage",
    f"SELECT o_orderkey AS query_id, {_case(lambda i: 'concat_ws(chr(44), ' + ', '.join(_N[x] for x in _SYN[i]) + ')')} AS tables FROM orders WHERE o_orderkey % 6 <> 5",
)
def syntax_lineage(spark, d):
    found = L.syntax_tables(sql_log(spark, d), sql_catalog(spark, d))
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "table_name"))).alias("_t"))
    return listed.select("query_id", F.array_join(F.transform("_t", lambda x: x["table_name"]), ",").alias("tables"))


@query("lineage_paths", f"WITH {_RESOLVED} SELECT path, count(*) AS n FROM res GROUP BY path")
def lineage_paths(spark, d):
    return L.resolve_lineage(sql_log(spark, d), sql_catalog(spark, d)).groupBy("path").agg(F.count("*").alias("n"))


@query(
    "ast_lineage",
    """SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 4 = o_orderkey % 3 THEN 'n' || (o_orderkey % 4) WHEN o_orderkey % 4 = 3 THEN 'n' || (o_orderkey % 3)
  ELSE 'n' || least(o_orderkey % 4, o_orderkey % 3) || ',n' || greatest(o_orderkey % 4, o_orderkey % 3) END AS tables FROM orders""",
)
def ast_lineage(spark, d):
    """Query trees as JSON text; index 3 has no table."""
    k = F.col("o_orderkey")
    tree = F.concat(
        F.lit('{"from": {"table_units": [["table_unit", '), (k % 4).cast("string"),
        F.lit(']]}, "union": {"from": {"table_units": [["table_unit",'), (k % 3).cast("string"), F.lit("]]}}}"),
    )
    db = F.concat(F.lit("db"), F.floor(k / 10).cast("string")).alias("db_id")
    trees = load(spark, d, "orders").select(k.alias("query_id"), db, tree.alias("ast"))
    names = F.array(*[F.lit(n) for n in ("n0", "n1", "n2")]).alias("table_names")
    schemas = trees.select("db_id").distinct().select("db_id", names)
    return L.ast_tables(trees, schemas).select("query_id", F.array_join("tables", ",").alias("tables"))


@query(
    "question_normalisation",
    f"""WITH {_RESOLVED}, q AS (SELECT o_orderkey AS query_id, 'db' || (o_orderkey // 10) AS db_id, concat_ws(' ', o_orderpriority, o_orderkey // 40) AS question,
  list_sort(string_split(tables, ',')) AS s FROM orders LEFT JOIN res ON query_id = o_orderkey),
k AS (SELECT min(query_id) AS query_id FROM q WHERE s IS NOT NULL GROUP BY question, db_id, s)
SELECT reason, n FROM (SELECT 'no_tables' AS reason, count(*) AS n FROM q WHERE s IS NULL
  UNION ALL SELECT 'duplicate', (SELECT count(*) FROM q WHERE s IS NOT NULL) - (SELECT count(*) FROM k)
  UNION ALL SELECT 'kept', (SELECT count(*) FROM k)) WHERE n > 0""",
)
def question_normalisation(spark, d):
    kept, skipped = L.normalize_questions(sql_log(spark, d), sql_catalog(spark, d))
    total = kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("reason"), "n")
    return skipped.unionByName(total)


@query(
    "normalised_artefacts",
    f"""WITH {_RESOLVED}, q AS (SELECT o_orderkey AS query_id, 'db' || (o_orderkey // 10) AS db_id, concat_ws(' ', o_orderpriority, o_orderkey // 40) AS question,
  list_sort(string_split(tables, ',')) AS s FROM orders LEFT JOIN res ON query_id = o_orderkey),
k AS (SELECT min(query_id) AS query_id, db_id, any_value(array_to_string(s, ',')) AS tables FROM q WHERE s IS NOT NULL GROUP BY question, db_id, s)
SELECT 'question' AS artefact, db_id, query_id, tables, 0::BIGINT AS n FROM k
UNION ALL SELECT 'manifest', reason, -1, '', n FROM (SELECT 'kept' AS reason, count(*) AS n FROM k
  UNION ALL SELECT 'no_tables', count(*) FROM q WHERE s IS NULL UNION ALL SELECT 'duplicate', (SELECT count(*) FROM q WHERE s IS NOT NULL) - (SELECT count(*) FROM k)) WHERE n > 0""",
)
def normalised_artefacts(spark, d):
    """Split, catalog and manifest off one normalisation, published as one version and read back."""
    path, parameters = scratch_path(spark, "normalised"), {"seed": "42"}
    kept, skipped = L.normalize_questions(sql_log(spark, d), sql_catalog(spark, d))
    kept = materialize(kept, "kept")
    manifest = skipped.unionByName(kept.agg(F.count("*").alias("n")).select(F.lit("kept").alias("reason"), "n"))
    writer = W.StagedWriter(spark, path, parameters)
    writer.write("all", {"questions": kept, "catalog": sql_catalog(spark, d), "manifest": manifest})
    writer.finish(["all"])
    questions, told = (W.read_staged(spark, path, parameters, t) for t in ("questions", "manifest"))
    catalog = W.read_staged(spark, path, parameters, "catalog")
    known = questions.join(catalog.select("db_id").distinct(), "db_id", "left_semi")
    tables = F.array_join(F.array_sort("required_tables"), ",")
    return known.select(F.lit("question").alias("artefact"), "db_id", "query_id", tables.alias("tables"), F.lit(0).cast("bigint").alias("n")).unionByName(
        told.filter("n > 0").select(F.lit("manifest").alias("artefact"), F.col("reason").alias("db_id"), F.lit(-1).cast("bigint").alias("query_id"), F.lit("").alias("tables"), "n")
    )
