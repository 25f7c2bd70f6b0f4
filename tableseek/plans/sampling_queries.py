"""Seeded sampling, splits, fixed corpora and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.operators import sampling as S
from tableseek.operators.resolution import keep_style
from tableseek.plans.lowering import ORDER_CELLS_SQL, QUESTIONS_SQL, catalog, order_tables, qrels, questions
from tableseek.plans.registry import load, query
from tableseek.session import materialize

H = "md5(concat_ws('|', '42', {0}))"


def line_rows(spark, d):
    return load(spark, d, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("qty"), "l_returnflag"
    )


_LINE_KEY = ["l_orderkey", "l_partkey", "l_linenumber", "qty", "l_returnflag"]
_LINES = "SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, CAST(l_quantity AS BIGINT) AS qty, l_returnflag FROM lineitem"
_LINE_H = H.format("l_suppkey, l_orderkey, l_partkey, l_linenumber, qty, l_returnflag")


@query(
    "capped_rows",
    f"""SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, qty, l_returnflag FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE_H}, l_orderkey, l_partkey, l_linenumber, qty, l_returnflag) AS r
  FROM ({_LINES})) WHERE r <= 50""",
)
def capped_rows(spark, d):
    return S.row_sample(line_rows(spark, d), ["l_suppkey"], _LINE_KEY, 50)


@query(
    "capped_rows_large",
    f"""SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, qty, l_returnflag FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE_H}, l_orderkey, l_partkey, l_linenumber, qty, l_returnflag) AS r
  FROM ({_LINES})) WHERE r <= 2000""",
)
def capped_rows_large(spark, d):
    """A cap above the group-limit threshold: cut in hashed pieces first."""
    return S.row_sample(line_rows(spark, d), ["l_suppkey"], _LINE_KEY, 2000)


@query(
    "eligible_rows",
    f"""SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, qty, l_returnflag FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE_H}, l_orderkey, l_partkey, l_linenumber, qty, l_returnflag) AS r
  FROM ({_LINES}) WHERE l_returnflag <> 'N' AND qty > 25) WHERE r <= 7""",
)
def eligible_rows(spark, d):
    eligible = (F.col("l_returnflag") != "N") & (F.col("qty") > 25)
    return S.row_sample(line_rows(spark, d), ["l_suppkey"], _LINE_KEY, 7, eligible=eligible)


_POS = "row_number() OVER (ORDER BY {h}, {k}) - 1"


def _cuts(n, train, val):
    return f"CASE WHEN p < round_even({n} * {train}, 0) THEN 'train' WHEN p < round_even({n} * {train}, 0) + round_even({n} * {val}, 0) THEN 'val' ELSE 'test' END"


@query(
    "split_queries",
    f"""WITH p AS (SELECT o_orderkey, {_POS.format(h=H.format('o_orderkey'), k='o_orderkey')} AS p FROM orders)
SELECT o_orderkey, {_cuts('(SELECT count(*) FROM orders)', 0.85, 0.05)} AS split FROM p""",
)
def split_queries(spark, d):
    asked = load(spark, d, "orders").select("o_orderkey")
    return S.split_queries(asked, "o_orderkey", {"train": 0.85, "val": 0.05, "test": 0.10})


@query(
    "split_queries_capped",
    f"""WITH p AS (SELECT o_orderkey, {_POS.format(h=H.format('o_orderkey'), k='o_orderkey')} AS p FROM orders)
SELECT o_orderkey, {_cuts('least(1001, (SELECT count(*) FROM orders))', 0.5, 0.25)} AS split FROM p WHERE p < 1001""",
)
def split_queries_capped(spark, d):
    asked = load(spark, d, "orders").select("o_orderkey")
    return S.split_queries(asked, "o_orderkey", {"train": 0.5, "val": 0.25, "test": 0.25}, cap=1001)


@query(
    "fixed_corpus",
    f"""WITH {QUESTIONS_SQL},
need AS (SELECT DISTINCT table_id FROM qrels),
rest AS (SELECT table_id, row_number() OVER (ORDER BY {H.format('table_id')}, table_id) AS r FROM catalog
         WHERE table_id NOT IN (SELECT table_id FROM need))
SELECT table_id, 'required' AS origin FROM need
UNION ALL SELECT table_id, 'fill' FROM rest WHERE r <= 200""",
)
def fixed_corpus(spark, d):
    """All gold tables and 200 others."""
    required = materialize(qrels(spark, d).select("table_id").distinct(), "required")
    return S.fixed_corpus(required, catalog(spark, d), "table_id", required.count() + 200)


@query(
    "validation_corpus",
    f"""WITH {QUESTIONS_SQL},
p AS (SELECT o_orderkey, {_POS.format(h=H.format('o_orderkey'), k='o_orderkey')} AS p FROM orders),
val AS (SELECT o_orderkey AS query_id FROM (SELECT o_orderkey, {_cuts('(SELECT count(*) FROM orders)', 0.85, 0.05)} AS split FROM p) WHERE split = 'val'),
pos AS (SELECT DISTINCT table_id, db_id FROM qrels WHERE query_id IN (SELECT query_id FROM val)),
hard AS (SELECT table_id FROM (
  SELECT c.table_id, row_number() OVER (PARTITION BY c.db_id ORDER BY md5(concat_ws('|', '42h', c.table_id)), c.table_id) AS r
  FROM catalog c WHERE c.db_id IN (SELECT db_id FROM pos) AND c.table_id NOT IN (SELECT table_id FROM pos)) WHERE r <= 3),
forced AS (SELECT table_id, 'positive' AS origin FROM pos UNION ALL SELECT table_id, 'hard_negative' FROM hard),
rest AS (SELECT table_id, row_number() OVER (ORDER BY {H.format('table_id')}, table_id) AS r FROM catalog
         WHERE table_id NOT IN (SELECT table_id FROM forced))
SELECT table_id, origin FROM forced
UNION ALL SELECT table_id, 'fill' FROM rest WHERE r <= 3000 - (SELECT count(*) FROM forced)""",
)
def validation_corpus(spark, d):
    """Positives of the whole validation split, 3 hard negatives per database, fill to 3000."""
    split = S.split_queries(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", {"train": 0.85, "val": 0.05, "test": 0.10})
    asked = split.filter(F.col("split") == "val").select(F.col("o_orderkey").alias("query_id"))
    positives = materialize(qrels(spark, d).join(asked, "query_id", "left_semi"), "positives")
    return S.validation_corpus(positives, catalog(spark, d), "table_id", "db_id", per_db=3, size=3000)


@query(
    "query_subsample",
    f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {H.format('o_orderkey')}, o_orderkey LIMIT 200",
)
def query_subsample(spark, d):
    return S.random_rows(load(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 200)


@query(
    "one_positive",
    f"""WITH {QUESTIONS_SQL}
SELECT query_id, table_id FROM (SELECT query_id, table_id, row_number() OVER (PARTITION BY query_id
  ORDER BY md5(concat_ws('|', '42', query_id, table_id)), table_id) AS r FROM qrels) WHERE r = 1""",
)
def one_positive(spark, d):
    return S.one_per_group(qrels(spark, d), ["query_id"], "table_id")


@query(
    "pilot_tables",
    f"""WITH {QUESTIONS_SQL},
dbs AS (SELECT db_id FROM (SELECT DISTINCT db_id FROM catalog) ORDER BY {H.format('db_id')}, db_id LIMIT 20)
SELECT db_id, table_id FROM catalog WHERE db_id IN (SELECT db_id FROM dbs) ORDER BY {H.format('table_id')}, table_id LIMIT 50""",
)
def pilot_tables(spark, d):
    return S.pilot(catalog(spark, d).select("db_id", "table_id"), "db_id", "table_id", 20, 50)


@query(
    "holdout_tables",
    f"""WITH {QUESTIONS_SQL}
SELECT table_id, row_number() OVER (ORDER BY {H.format('table_id')}, table_id) <=
  greatest(1, floor((SELECT count(*) FROM catalog) * 0.1)) AS held_out FROM catalog""",
)
def holdout_tables(spark, d):
    return S.holdout(catalog(spark, d).select("table_id"), "table_id")


@query(
    "shuffled_tables",
    f"""WITH {ORDER_CELLS_SQL},
r AS (SELECT table_id, row_idx, row_number() OVER (PARTITION BY table_id ORDER BY md5(concat_ws('|', '42', table_id, 'r', row_idx)), row_idx) - 1 AS nr
      FROM (SELECT DISTINCT table_id, row_idx FROM order_cells)),
c AS (SELECT table_id, col_idx, row_number() OVER (PARTITION BY table_id ORDER BY md5(concat_ws('|', '42', table_id, 'c', col_idx)), col_idx) - 1 AS nc
      FROM (SELECT DISTINCT table_id, col_idx FROM order_cells))
SELECT table_id, CAST(nc AS INTEGER) AS col_idx, CAST(nr AS INTEGER) AS row_idx, header, cell
FROM order_cells JOIN r USING (table_id, row_idx) JOIN c USING (table_id, col_idx)""",
)
def shuffled_tables(spark, d):
    return S.shuffle_tables(order_tables(spark, d))


@query(
    "epoch_chunks",
    f"""SELECT o_orderkey, (row_number() OVER (ORDER BY {H.format('o_orderkey')}, o_orderkey) - 1) // 256 AS chunk FROM orders""",
)
def epoch_chunks(spark, d):
    return S.disjoint_chunks(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 256)


@query(
    "epoch_reshuffles",
    """SELECT o_orderkey, epoch, pos FROM (SELECT o_orderkey, e AS epoch,
  row_number() OVER (PARTITION BY e ORDER BY md5(concat_ws('|', '42', e, o_orderkey)), o_orderkey) - 1 AS pos
  FROM orders, (VALUES (0), (1), (2)) AS t(e)) WHERE pos < 2000""",
)
def epoch_reshuffles(spark, d):
    return S.reshuffled_epochs(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", 2000, 3)


@query(
    "dedupe_questions",
    """SELECT sha256(text) AS text_key, lang, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY sha256(text), lang""",
)
def dedupe_questions(spark, d):
    docs = load(spark, d, "documents").select(T.fingerprint("text").alias("text_key"), "lang", "doc_id", "source")
    return S.keep_first(docs, ["text_key", "lang"], "doc_id")


@query(
    "corpus_append",
    """SELECT source, count(*) AS n, count(page_title) AS n_titles FROM (
  SELECT CAST(doc_id AS VARCHAR) AS id, 'bird' AS source, NULL AS page_title FROM documents
  UNION ALL SELECT CAST(page_id AS VARCHAR), 'webtable', url FROM pages) GROUP BY source""",
)
def corpus_append(spark, d):
    docs = load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("bird").alias("source"))
    web = load(spark, d, "pages").select(
        F.col("page_id").cast("string").alias("id"), F.lit("webtable").alias("source"), F.col("url").alias("page_title")
    )
    both = docs.unionByName(web, allowMissingColumns=True)
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("page_title").alias("n_titles"))


@query(
    "hits_union",
    """WITH hits AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 45
  UNION SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount = 0.05)
SELECT p_partkey AS id, p_partkey IN (SELECT id FROM hits) AS selected FROM part""",
)
def hits_union(spark, d):
    """Distinct union of two hit lists, and the parts in neither."""
    lines = load(spark, d, "lineitem")
    hits = (
        lines.filter("l_quantity > 45").select(F.col("l_partkey").alias("id"))
        .union(lines.filter("l_discount = 0.05").select("l_partkey")).distinct()
    )
    ids = load(spark, d, "part").select(F.col("p_partkey").alias("id"))
    selected = ids.join(hits, "id", "left_semi").withColumn("selected", F.lit(True))
    rest = ids.join(hits, "id", "left_anti").withColumn("selected", F.lit(False))
    return selected.unionByName(rest)


@query(
    "table_set_equality",
    f"""WITH {QUESTIONS_SQL}
SELECT query_id, t1 = t2 AS same_set FROM questions""",
)
def table_set_equality(spark, d):
    first = F.array(F.element_at("required_tables", 1), F.element_at("required_tables", 1))
    return questions(spark, d).select("query_id", S.set_equal(F.col("required_tables"), first).alias("same_set"))


@query(
    "root_conflicts",
    """SELECT 'supp' || l_suppkey AS db_id, count(DISTINCT l_returnflag || l_linestatus) AS n_paths
FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag || l_linestatus) > 1""",
)
def root_conflicts(spark, d):
    files = load(spark, d, "lineitem").select(
        F.concat(F.lit("supp"), F.col("l_suppkey").cast("string")).alias("db_id"),
        F.concat("l_returnflag", "l_linestatus").alias("path"),
    )
    return S.conflicting_roots(files)


@query(
    "style_filter",
    f"WITH {QUESTIONS_SQL} SELECT query_id, style FROM questions WHERE coalesce(style, '') <> 'Multi-turn Dialogue'",
)
def style_filter(spark, d):
    return questions(spark, d).filter(keep_style()).select("query_id", "style")
