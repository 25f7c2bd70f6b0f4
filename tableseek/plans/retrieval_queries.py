"""Lexical and vector retrieval with their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.functions import vectors as V
from tableseek.functions.hashing import hash_key
from tableseek.operators import batches as B
from tableseek.operators import candidates as K
from tableseek.operators import dense_index as D
from tableseek.operators import lexical_index as I
from tableseek.operators import metrics as M
from tableseek.operators import retrieval as X
from tableseek.operators import scoring as S
from tableseek.operators.ranking import top_k
from tableseek.operators.vectorise import hashed_token_vectors
from tableseek.plans.registry import load, query
from tableseek.session import materialize, scratch_path, shared_dir, spread

TOK = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def tok_sql(col):
    return TOK.format(col)


def docs(spark, d):
    return spread(load(spark, d, "documents").select("doc_id", "text", "source", "lang"))


def passages(spark, d):
    """Every benchmark passage as query text."""
    return load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BM25_SQL = f"""
dt AS (SELECT doc_id, {tok_sql('text')} AS t FROM documents),
tf AS (SELECT doc_id, len_, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len_, unnest(t) AS term FROM dt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM dt),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tok_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * len_ / a))), 6) AS score
       FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm
         QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 100),
rel AS (SELECT item_id AS query_id, doc_id FROM (SELECT item_id, concat(' ', array_to_string({tok_sql('text')}, ' '), ' ') AS p FROM benchmark) b
  JOIN (SELECT doc_id, concat(' ', array_to_string(t, ' '), ' ') AS x FROM dt) d ON contains(x, p))"""
METRIC_SQL = """
judged AS (SELECT h.query_id, h.doc_id, h.rank, r.doc_id IS NOT NULL AS positive FROM hits h
           LEFT JOIN rel r ON r.query_id = h.query_id AND r.doc_id = h.doc_id),
cum AS (SELECT *, sum(positive::INT) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) / rank AS prec FROM judged),
pq AS (SELECT query_id, avg(prec) AS ap, 1.0 / min(rank) AS rr, count(*) AS n_positive FROM cum WHERE positive GROUP BY query_id)"""


def stored_index(spark, d):
    """The index over the documents of ``d`` in the shared folder, built where it is absent.

    Its name follows from the files' paths, sizes and times, so changed tables get an index of their own.
    """
    file = F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    files = load(spark, d, "documents").select(file.alias("h")).distinct().agg(F.hex(F.bit_xor("h"))).first()[0]
    return I.open_or_build(docs(spark, d), f"{shared_dir(spark)}/lexical-{files}", "doc_id", "text")


def _hits(spark, d, k=100):
    return stored_index(spark, d).search(passages(spark, d), k, "doc_id")


def judged_hits(spark, d, k=100):
    index = stored_index(spark, d)
    truth = I.passages_by_index(index, docs(spark, d), passages(spark, d), "doc_id", "text")
    hits = index.search(passages(spark, d), k, "doc_id")
    marked = hits.join(truth.withColumn("_p", F.lit(True)), ["query_id", "doc_id"], "left")
    return marked.select("query_id", "doc_id", "score", "rank", F.coalesce("_p", F.lit(False)).alias("positive"))


@query(
    "lexical_index",
    f"""WITH tk AS (SELECT doc_id, unnest({tok_sql('text')}) AS term FROM documents),
p AS (SELECT term, doc_id, count(*) AS tf FROM tk GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(tf) AS INT) AS max_tf FROM p GROUP BY term""",
)
def lexical_index(spark, d):
    """Term dictionary of the stored index; built by the first query that needs it."""
    return stored_index(spark, d).terms().drop("bucket")


@query("lexical_index_append", f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM hits WHERE rank <= 20")
def lexical_index_append(spark, d):
    """Search over an index whose second half was appended, the two segments then merged."""
    whole = docs(spark, d)
    half = F.col("doc_id") % 2 == 0
    index = I.build_index(whole.where(half), scratch_path(spark, "lexical"), "doc_id", "text")
    return index.append(whole.where(~half), "doc_id", "text").merge().search(passages(spark, d), 20, "doc_id")


@query("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, doc_id, score, rank FROM hits")
def bm25_topk(spark, d):
    return _hits(spark, d)


@query("bm25_map", f"WITH {BM25_SQL}, {METRIC_SQL} SELECT round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, count(*) AS n_queries FROM pq")
def bm25_map(spark, d):
    return M.map_mrr(M.per_query_metrics(judged_hits(spark, d), "doc_id"))


@query(
    "bm25_per_query",
    f"WITH {BM25_SQL}, {METRIC_SQL} SELECT query_id, round(ap, 6) AS ap, round(rr, 6) AS rr, n_positive FROM pq",
)
def bm25_per_query(spark, d):
    found = M.per_query_metrics(judged_hits(spark, d), "doc_id")
    return found.select("query_id", F.round("ap", 6).alias("ap"), F.round("rr", 6).alias("rr"), "n_positive")


@query(
    "strict_metrics",
    f"""WITH {BM25_SQL}, {METRIC_SQL}
SELECT CASE WHEN ap IS NULL THEN 'no_positive' ELSE 'scored' END AS outcome, round(coalesce(avg(ap), 0), 6) AS map, round(coalesce(avg(rr), 0), 6) AS mrr, count(*) AS n_queries
FROM (SELECT DISTINCT item_id AS query_id FROM benchmark) LEFT JOIN pq USING (query_id) GROUP BY 1""",
)
def strict_metrics(spark, d):
    """Every query counts: scored, or without a relevant hit, where the strict evaluation fails."""
    return M.outcomes(passages(spark, d), M.per_query_metrics(judged_hits(spark, d), "doc_id"))


@query(
    "chunk_metrics",
    f"""WITH {BM25_SQL}, {METRIC_SQL} SELECT round(sum(ap) / count(*), 6) AS map, round(sum(rr) / count(*), 6) AS mrr, count(*) AS n_queries FROM pq""",
)
def chunk_metrics(spark, d):
    found = M.per_query_metrics(judged_hits(spark, d), "doc_id").withColumn("chunk", F.floor(F.col("query_id") / 8))
    return M.merge_chunks(M.chunk_state(found, "chunk"))


@query(
    "passage_qrels",
    f"WITH {BM25_SQL} SELECT query_id, doc_id FROM rel",
)
def passage_qrels(spark, d):
    return I.passages_by_index(stored_index(spark, d), docs(spark, d), passages(spark, d), "doc_id", "text")


@query(
    "retrieved_docs",
    f"WITH {BM25_SQL} SELECT query_id, doc_id, rank, source, md5(text) AS text_md5 FROM hits JOIN documents USING (doc_id) WHERE rank <= 10",
)
def retrieved_docs(spark, d):
    found = X.fetch(_hits(spark, d, 10).drop("score"), docs(spark, d), "doc_id")
    return found.select("query_id", "doc_id", "rank", "source", F.md5("text").alias("text_md5"))


@query(
    "postings_stats",
    f"""WITH dt AS (SELECT doc_id, {tok_sql('text')} AS t FROM documents),
tk AS (SELECT doc_id, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM dt),
p AS (SELECT term, doc_id, count(*) AS tf, sum(pos) AS ps FROM tk GROUP BY ALL)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf, CAST(sum(ps) AS BIGINT) AS position_sum FROM p GROUP BY term""",
)
def postings_stats(spark, d):
    index = X.postings(docs(spark, d), "doc_id", "text")
    positions = F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return index.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.sum(positions).alias("position_sum")
    )


@query(
    "document_stats",
    f"SELECT count(*) AS n_docs, CAST(sum(len({tok_sql('text')})) AS BIGINT) AS n_tokens, round(avg(len({tok_sql('text')})), 6) AS avg_len FROM documents",
)
def document_stats(spark, d):
    return X.document_stats(docs(spark, d), "text").withColumn("avg_len", F.round("avg_len", 6))


@query(
    "augmented_corpus",
    f"""WITH {BM25_SQL},
sel AS (SELECT DISTINCT doc_id FROM hits WHERE rank <= 5),
rest AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id) AS r FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sel)),
c AS (SELECT doc_id, 'required' AS origin FROM sel UNION ALL SELECT doc_id, 'fill' FROM rest WHERE r <= 300 - (SELECT count(*) FROM sel))
SELECT CAST(doc_id AS VARCHAR) AS id, source || '-' || lang AS table_name, length(text) AS n_chars, origin, 'webtable' AS source FROM c JOIN documents USING (doc_id)""",
)
def augmented_corpus(spark, d):
    """Top 5 documents of every seed text, filled to 300."""
    corpus = X.augment_corpus(docs(spark, d), passages(spark, d), 5, 300, "doc_id", "text", hits=_hits(spark, d, 5))
    return corpus.select(
        F.col("doc_id").cast("string").alias("id"), F.concat_ws("-", "source", "lang").alias("table_name"),
        F.length("text").cast("bigint").alias("n_chars"), "origin", F.lit("webtable").alias("source"),
    )


def cell_vecs(spark, d):
    """Sixteen consecutive vectors are one 4 x 4 table, eight tables one database."""
    i = F.col("vec_id")
    table = F.floor(i / 16)
    db = F.concat(F.lit("db"), F.floor(i / 128).cast("string"))
    return spread(load(spark, d, "embeddings")).select(
        "vec_id", "label", db.alias("db_id"),
        T.table_id(db, F.concat(F.lit("t"), table.cast("string"))).alias("table_id"),
        (i % 4).cast("int").alias("col_idx"), F.floor(i % 16 / 4).cast("int").alias("row_idx"), F.col("embedding").alias("vec"),
    )


def query_vecs(spark, d):
    """Eight consecutive vectors, read backwards, are the tokens of one query."""
    i = F.col("vec_id")
    return spread(load(spark, d, "embeddings")).select(
        F.floor(i / 8).alias("query_id"), (i % 8).cast("int").alias("tok_idx"), "label",
        F.concat(F.lit("db"), F.floor(i / 128).cast("string")).alias("db_id"), F.reverse("embedding").alias("vec"),
    )


def vector_tables(spark, d):
    return cell_vecs(spark, d).groupBy("db_id", "table_id").agg(F.count("*").alias("n_rows"), F.min_by("label", "vec_id").alias("label"))


def vector_queries(spark, d):
    asked = query_vecs(spark, d).groupBy("query_id", "db_id").agg(F.min_by("label", "tok_idx").alias("label"))
    return B.fixed_chunks(asked, ["db_id", "query_id"], 50, "chunk")


def vector_scores(spark, d):
    """Scores of the candidate plan (own database, five distractors), materialized once."""
    asked, tables = vector_queries(spark, d), vector_tables(spark, d)
    none = asked.select("query_id", "db_id").limit(0).withColumn("table_id", F.lit(""))
    plan = K.candidate_plan(asked, tables, none, 5).select("query_id", "table_id")
    scored = S.score_candidates(plan, query_vecs(spark, d), cell_vecs(spark, d))
    gold = asked.select("query_id", F.col("label").alias("_ql"))
    with_labels = scored.join(gold, "query_id").join(tables.select("table_id", "label"), "table_id")
    return materialize(
        with_labels.withColumn("positive", F.col("label") == F.col("_ql")).drop("_ql", "label"), "scores"
    )


N60 = "CAST(('0x' || substr(md5(concat_ws('|', {0})), 1, 15)) AS BIGINT)"
VEC_SQL = f"""
cv AS (SELECT vec_id, label, 'db' || (vec_id // 128) AS db_id, 'db' || (vec_id // 128) || '#sep#t' || (vec_id // 16) AS table_id,
       vec_id % 4 AS c, vec_id % 16 // 4 AS r, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
qv AS (SELECT vec_id // 8 AS query_id, vec_id % 8 AS tok, label, 'db' || (vec_id // 128) AS db_id, list_reverse(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
tb AS (SELECT db_id, table_id, arg_min(label, vec_id) AS label FROM cv GROUP BY 1, 2),
qs AS (SELECT query_id, db_id, label, (row_number() OVER (ORDER BY db_id, query_id) - 1) // 50 AS chunk
       FROM (SELECT query_id, db_id, arg_min(label, tok) AS label FROM qv GROUP BY 1, 2)),
rg AS (SELECT db_id, table_id, row_number() OVER (ORDER BY md5(concat_ws('|', '42', table_id)), table_id) - 1 AS pos, count(*) OVER () AS n FROM tb),
pool AS (SELECT c.chunk, g.table_id, g.db_id FROM (SELECT DISTINCT chunk FROM qs) c JOIN rg g ON (g.pos - {N60.format("'42s', c.chunk")} % g.n + g.n) % g.n < 10),
cand AS (SELECT q.query_id, t.table_id FROM qs q JOIN tb t USING (db_id)
  UNION ALL SELECT query_id, table_id FROM (SELECT q.query_id, p.table_id, row_number() OVER (PARTITION BY q.query_id
    ORDER BY md5(concat_ws('|', '42', q.query_id, p.table_id)), p.table_id) AS k FROM qs q JOIN pool p ON p.chunk = q.chunk AND p.db_id <> q.db_id) WHERE k <= 5),
sim AS (SELECT cand.query_id, qv.tok, cand.table_id, cv.c, cv.r,
  list_dot_product(qv.v, cv.v) / (sqrt(list_dot_product(qv.v, qv.v)) * sqrt(list_dot_product(cv.v, cv.v))) AS s
  FROM cand JOIN qv USING (query_id) JOIN cv USING (table_id)),
dims AS (SELECT table_id, r, i, avg(v[i]) AS m FROM cv, range(1, 65) AS g(i) GROUP BY 1, 2, 3),
rv AS (SELECT table_id, r, list(m ORDER BY i) AS v FROM dims GROUP BY 1, 2),
g AS (SELECT query_id, table_id, sum(m) AS x FROM (SELECT query_id, tok, table_id, max(s) AS m FROM sim GROUP BY ALL) GROUP BY 1, 2),
rm AS (SELECT query_id, table_id, sum(a) AS x FROM (SELECT query_id, tok, table_id, avg(m) AS a FROM
  (SELECT query_id, tok, table_id, c, max(s) AS m FROM sim GROUP BY ALL) GROUP BY ALL) GROUP BY 1, 2),
cm AS (SELECT query_id, table_id, sum(a) AS x FROM (SELECT query_id, tok, table_id, avg(m) AS a FROM
  (SELECT query_id, tok, table_id, r, max(s) AS m FROM sim GROUP BY ALL) GROUP BY ALL) GROUP BY 1, 2),
rr AS (SELECT query_id, table_id, sum(a) AS x FROM (SELECT cand.query_id, qv.tok, cand.table_id,
  avg(list_dot_product(qv.v, rv.v) / (sqrt(list_dot_product(qv.v, qv.v)) * sqrt(list_dot_product(rv.v, rv.v)))) AS a
  FROM cand JOIN qv USING (query_id) JOIN rv USING (table_id) GROUP BY 1, 2, 3) GROUP BY 1, 2),
scores AS (SELECT g.query_id, g.table_id, g.x AS global, rm.x AS row_match, cm.x AS column_match, 0.5 * rm.x + 0.5 * rr.x AS mixture, qs.label = tb.label AS positive
  FROM g JOIN rm USING (query_id, table_id) JOIN cm USING (query_id, table_id) JOIN rr USING (query_id, table_id) JOIN qs USING (query_id) JOIN tb USING (table_id)),
models AS (SELECT 'global' AS model, query_id, table_id, round(global, 6) AS score, positive FROM scores
  UNION ALL SELECT 'row_match', query_id, table_id, round(row_match, 6), positive FROM scores
  UNION ALL SELECT 'column_match', query_id, table_id, round(column_match, 6), positive FROM scores
  UNION ALL SELECT 'mixture', query_id, table_id, round(mixture, 6), positive FROM scores)"""
MODES = ["global", "row_match", "column_match", "mixture"]


def _mode(mode):
    def run(spark, d):
        return vector_scores(spark, d).select("query_id", "table_id", F.round(mode, 6).alias("score"), "positive")

    return run


for _m in MODES:
    query(f"score_{_m}", f"WITH {VEC_SQL} SELECT query_id, table_id, score, positive FROM models WHERE model = '{_m}'")(_mode(_m))


def model_scores(spark, d):
    """Four scoring modes as four models over the identical candidate set."""
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.round(m, 6).alias("score")) for m in MODES])
    return vector_scores(spark, d).select("query_id", "table_id", "positive", F.inline(pairs))


@query(
    "map_mrr_multi_model",
    f"""WITH {VEC_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, query_id ORDER BY score DESC, table_id) AS k FROM models),
cum AS (SELECT *, sum(positive::INT) OVER (PARTITION BY model, query_id ORDER BY k ROWS UNBOUNDED PRECEDING) / k AS prec FROM ranked),
pq AS (SELECT model, query_id, avg(prec) AS ap, 1.0 / min(k) AS rr FROM cum WHERE positive GROUP BY 1, 2)
SELECT model, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, count(*) AS n_queries FROM pq GROUP BY model""",
)
def map_mrr_multi_model(spark, d):
    found = M.per_query_metrics(model_scores(spark, d), "table_id", by=["model", "query_id"])
    return M.map_mrr(found, ["model"])


@query(
    "info_nce",
    f"""WITH {VEC_SQL},
q AS (SELECT model, query_id, max(score / 0.07) AS m FROM models GROUP BY 1, 2)
SELECT model, round(avg(l), 6) AS loss, count(l) AS n_queries, count(*) - count(l) AS n_failed FROM (SELECT model, query_id, ln(sum(exp(score / 0.07 - m))) - ln(sum(CASE WHEN positive THEN exp(score / 0.07 - m) END)) AS l
  FROM models JOIN q USING (model, query_id) GROUP BY 1, 2) GROUP BY model""",
)
def info_nce(spark, d):
    """Loss of the queries with a positive, and the number of those without, which a strict run fails on."""
    losses = M.info_nce(model_scores(spark, d), by=["model", "query_id"], strict=False)
    return losses.groupBy("model").agg(
        F.round(F.avg("loss"), 6).alias("loss"), F.count("loss").alias("n_queries"), F.count_if(F.col("loss").isNull()).alias("n_failed")
    )


@query(
    "paired_scores",
    f"""WITH {VEC_SQL.replace("cand AS (SELECT", "cand AS (SELECT query_id, 'db' || (query_id // 16) || '#sep#t' || (query_id // 2) AS table_id FROM qs), unused AS (SELECT", 1)}
SELECT query_id, table_id, round(global, 6) AS global, round(row_match, 6) AS row_match, round(column_match, 6) AS column_match, round(mixture, 6) AS mixture FROM scores""",
)
def paired_scores(spark, d):
    """Each query against the one table it is paired with."""
    q = F.col("query_id")
    table = T.table_id(
        F.concat(F.lit("db"), F.floor(q / 16).cast("string")), F.concat(F.lit("t"), F.floor(q / 2).cast("string"))
    )
    pairs = query_vecs(spark, d).select("query_id").distinct().withColumn("table_id", table)
    scored = S.score_candidates(pairs, query_vecs(spark, d), cell_vecs(spark, d))
    return scored.select("query_id", "table_id", *[F.round(m, 6).alias(m) for m in MODES])


def noisy_queries(spark, d):
    """Eight consecutive vectors with noise are the tokens of one query: each plus a quarter of itself read backwards."""
    i = F.col("vec_id")
    noisy = F.zip_with("embedding", F.reverse("embedding"), lambda x, y: x.cast("double") + y.cast("double") * 0.25)
    return spread(load(spark, d, "embeddings")).select(F.floor(i / 8).alias("query_id"), (i % 8).cast("int").alias("tok_idx"), noisy.alias("vec"))


PROBES, CUT = 4, 6
DENSE_SQL = f"""
e AS (SELECT vec_id, 'db' || (vec_id // 128) || '#sep#t' || (vec_id // 16) AS table_id, vec_id // 8 AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT query_id, vec_id % 8 AS tok, list_transform(list_zip(v, list_reverse(v)), lambda x: x[1] + x[2] * 0.25) AS v FROM e),
ct AS (SELECT vec_id AS k, v FROM e ORDER BY md5(concat_ws('|', '42', vec_id)), vec_id LIMIT (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) FROM embeddings)),
near AS (SELECT DISTINCT table_id, k FROM (SELECT e.table_id, ct.k, row_number() OVER (PARTITION BY e.vec_id ORDER BY
  round(list_dot_product(e.v, ct.v) / sqrt(list_dot_product(e.v, e.v) * list_dot_product(ct.v, ct.v)), 9) DESC, ct.k) AS n FROM e, ct) WHERE n = 1),
probe AS (SELECT query_id, tok, k, s FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tok ORDER BY s DESC, k) AS n FROM (
  SELECT q.query_id, q.tok, ct.k, round(list_dot_product(q.v, ct.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(ct.v, ct.v)), 9) AS s FROM q, ct)) WHERE n <= {PROBES}),
sums AS (SELECT query_id, table_id, round(sum(s), 6) AS score FROM (SELECT query_id, table_id, tok, max(s) AS s FROM probe JOIN near USING (k) GROUP BY ALL) GROUP BY ALL),
chosen AS (SELECT query_id, table_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id) AS rank FROM sums
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id) <= {CUT}),
exact AS (SELECT query_id, table_id, round(sum(m), 6) AS score FROM (SELECT c.query_id, c.table_id, q.tok,
  max(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v)))) AS m
  FROM chosen c JOIN q USING (query_id) JOIN e USING (table_id) GROUP BY ALL) GROUP BY ALL),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id) AS rank FROM exact
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id) <= 3)"""


def dense_index(spark, d):
    cells = cell_vecs(spark, d).select("vec_id", "table_id", "row_idx", "col_idx", "vec")
    return D.DenseIndex(spark, scratch_path(spark, "dense")).build(cells, "vec_id")


@query("dense_candidates", f"WITH {DENSE_SQL} SELECT query_id, table_id, score, rank FROM chosen")
def dense_candidates(spark, d):
    """Tables by summed centroid scores, cut to six a query."""
    return dense_index(spark, d).candidates(noisy_queries(spark, d), PROBES, CUT)


@query("dense_search", f"WITH {DENSE_SQL} SELECT query_id, table_id, score, rank FROM dense")
def dense_search(spark, d):
    """The three best of the candidates by exact late interaction."""
    cells = cell_vecs(spark, d).select("table_id", "row_idx", "col_idx", "vec")
    return dense_index(spark, d).search(noisy_queries(spark, d), 3, PROBES, CUT, cells)


@query("dense_search_kmeans")
def dense_search_kmeans(spark, d):
    """k-means lists, exact late-interaction re-scoring, top 10 tables per query."""
    cells, asked = cell_vecs(spark, d), query_vecs(spark, d)
    centroids = S.kmeans_centroids(cells.select("vec"), 16)
    return S.best_of_lists(asked, cells, centroids, 1, 10)


@query(
    "hybrid_ranks",
    f"""WITH {BM25_SQL},
srt AS (SELECT query_id, doc_id, rank AS r2 FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY md5(concat_ws('|', '42', query_id, doc_id)), doc_id) AS rank FROM bm) WHERE rank <= 100),
f AS (SELECT query_id, doc_id, round(coalesce(1.0 / (60 + rank), 0) + coalesce(1.0 / (60 + r2), 0), 6) AS score FROM hits FULL JOIN srt USING (query_id, doc_id))
SELECT query_id, doc_id, score FROM f""",
)
def hybrid_ranks(spark, d):
    """The lexical list fused with a second list (seeded order of the matches)."""
    scores = stored_index(spark, d).scores(passages(spark, d), "doc_id")
    first = top_k(scores, ["query_id"], [F.desc("score"), "doc_id"], 100)
    # the score decides nothing here, a document stands once a query; it keeps both lists on one shuffle of the postings
    second = top_k(scores.withColumn("_h", hash_key("query_id", "doc_id")), ["query_id"], ["_h", "doc_id", "score"], 100)
    return M.fuse_ranks([first, second], "doc_id").withColumn("score", F.round("score", 6))


@query(
    "masked_bce",
    """WITH c AS (SELECT l_orderkey // 100 AS batch, (l_partkey % 200 - 100) / 25.0 AS logit, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  l_suppkey % 11 = 0 AS is_null, l_linenumber = 1 AS is_fk FROM lineitem),
b AS (SELECT batch, avg(greatest(logit, 0) - logit * label + ln(1 + exp(-abs(logit)))) AS loss, count(*) FILTER (WHERE (logit > 0)::INT = label) AS ok, count(*) AS n
  FROM c WHERE NOT is_null AND NOT is_fk GROUP BY batch)
SELECT round(avg(loss), 6) AS loss, round(sum(ok) / sum(n), 6) AS accuracy, CAST(sum(n) AS BIGINT) AS n_cells FROM b""",
)
def masked_bce(spark, d):
    cells = load(spark, d, "lineitem").select(
        F.floor(F.col("l_orderkey") / 100).alias("batch"), ((F.col("l_partkey") % 200 - 100) / 25.0).alias("logit"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_suppkey") % 11 == 0).alias("is_null"), (F.col("l_linenumber") == 1).alias("is_foreign_key"),
    )
    return M.summarize_bce(M.masked_bce(cells))


@query(
    "best_validation",
    """WITH h AS (SELECT l_suppkey AS model, year(l_shipdate) AS epoch, round(avg(l_discount), 6) AS map FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, row_number() OVER w AS n, map > coalesce(max(map) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS better
  FROM h WINDOW w AS (PARTITION BY model ORDER BY epoch)),
s AS (SELECT *, n - max(CASE WHEN better THEN n END) OVER (PARTITION BY model ORDER BY epoch ROWS UNBOUNDED PRECEDING) >= 2 AS stop FROM m),
a AS (SELECT *, coalesce(bool_or(stop) OVER (PARTITION BY model ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM s)
SELECT model, max(map) AS best, max(CASE WHEN better THEN epoch END) AS best_epoch, count(*) AS epochs_run FROM a WHERE NOT done GROUP BY model""",
)
def best_validation(spark, d):
    """Suppliers as models, ship years as epochs, mean discount as the tracked metric."""
    history = load(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("model"), F.year("l_shipdate").cast("bigint").alias("epoch")
    ).agg(F.round(F.avg("l_discount"), 6).alias("map"))
    return M.best_epochs(history, patience=2)


@query(
    "pooled_vectors",
    f"""WITH {VEC_SQL},
x AS (SELECT table_id, c, r, i, v[i] AS y FROM cv, range(1, 65) AS g(i)),
m AS (SELECT table_id, 'row' AS grain, r AS idx, i, avg(y) AS y FROM x GROUP BY ALL UNION ALL SELECT table_id, 'column', c, i, avg(y) FROM x GROUP BY ALL
  UNION ALL SELECT table_id, 'table', 0, i, avg(y) FROM x GROUP BY ALL)
SELECT table_id, grain, idx, i AS dim, round(y, 6) AS value FROM m""",
)
def pooled_vectors(spark, d):
    pooled = S.pooled_vectors(cell_vecs(spark, d))
    return pooled.select("table_id", "grain", "idx", F.posexplode("vec").alias("dim", "value")).select(
        "table_id", "grain", F.col("idx").cast("bigint").alias("idx"), (F.col("dim") + 1).cast("bigint").alias("dim"), F.round("value", 6).alias("value")
    )


@query(
    "normalized_vectors",
    """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, i AS dim, round(v[i] / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS value FROM e, range(1, 65) AS g(i)""",
)
def normalized_vectors(spark, d):
    unit = load(spark, d, "embeddings").select("vec_id", F.posexplode(V.l2_normalize("embedding")).alias("dim", "value"))
    return unit.select("vec_id", (F.col("dim") + 1).cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@query(
    "random_projection",
    """WITH s AS (SELECT i, j, CASE WHEN CAST(('0x' || substr(md5(concat_ws('|', '42', i - 1, j)), 1, 1)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS w
  FROM range(1, 65) AS a(i), range(0, 16) AS b(j)),
x AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS y FROM embeddings, range(1, 65) AS g(i))
SELECT vec_id, j AS dim, round(sum(y * w) / 4.0, 6) AS value FROM x JOIN s USING (i) GROUP BY 1, 2""",
)
def random_projection(spark, d):
    projected = load(spark, d, "embeddings").select("vec_id", V.random_projection("embedding", 64, 16).alias("v"))
    long = projected.select("vec_id", F.posexplode("v").alias("dim", "value"))
    return long.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@query(
    "numeric_features",
    """WITH c AS (SELECT c_custkey, sign(c_acctbal) * ln(1 + abs(c_acctbal)) AS x FROM customer)
SELECT c_custkey, round(x, 6) AS signed_log, round(sin(x * exp(-ln(10000.0) * 0 / 2)), 6) AS s0, round(sin(x * exp(-ln(10000.0) * 1 / 2)), 6) AS s1,
  round(sin(x * exp(-ln(10000.0) * 2 / 2)), 6) AS s2, round(cos(x * exp(-ln(10000.0) * 0 / 2)), 6) AS c0,
  round(cos(x * exp(-ln(10000.0) * 1 / 2)), 6) AS c1, round(cos(x * exp(-ln(10000.0) * 2 / 2)), 6) AS c2, 0.0::DOUBLE AS pad FROM c""",
)
def numeric_features(spark, d):
    x = load(spark, d, "customer").select("c_custkey", V.signed_log("c_acctbal").alias("x"))
    wide = x.select("c_custkey", "x", V.sinusoid("x", 7).alias("f"))
    names = ["s0", "s1", "s2", "c0", "c1", "c2", "pad"]
    return wide.select(
        "c_custkey", F.round("x", 6).alias("signed_log"), *[F.round(F.col("f")[i], 6).alias(n) for i, n in enumerate(names)]
    )


@query(
    "fused_vectors",
    f"""WITH {VEC_SQL},
h AS (SELECT table_id, c, v AS hv FROM cv WHERE r = 0)
SELECT cv.vec_id, len(list_concat(cv.v, h.hv)) AS dims, round(list_sum(cv.v) + list_sum(h.hv), 6) AS total FROM cv JOIN h USING (table_id, c)""",
)
def fused_vectors(spark, d):
    """Cell vectors beside their column's header vector (its first cell stands in)."""
    cells = cell_vecs(spark, d)
    headers = cells.filter("row_idx = 0").select("table_id", "col_idx", F.col("vec").alias("header_vec"))
    fused = cells.join(headers, ["table_id", "col_idx"]).select("vec_id", V.fuse("vec", "header_vec").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return fused.select("vec_id", F.size("v").cast("bigint").alias("dims"), F.round(total, 6).alias("total"))


@query("half_precision", "SELECT vec_id, 128 AS n_bytes, true AS close FROM embeddings")
def half_precision(spark, d):
    packed = load(spark, d, "embeddings").select("vec_id", "embedding", V.to_half("embedding").alias("h"))
    back = packed.select("vec_id", "embedding", F.length("h").alias("n_bytes"), V.from_half("h").alias("b"))
    close = F.forall(F.zip_with("embedding", "b", lambda x, y: F.abs(x - y) <= 0.001), lambda ok: ok)
    return back.select("vec_id", "n_bytes", close.alias("close"))


@query(
    "query_tokens",
    f"""SELECT conv_id, turn, len(list_filter(({tok_sql('text')})[1:32], lambda x: x NOT IN ('cls', 'sep'))) AS n_tokens FROM conversations""",
)
def query_tokens(spark, d):
    """Token truncation, then special tokens dropped."""
    tokens = T.first_tokens("text", 32)
    kept = F.filter(tokens, lambda t: ~t.isin("cls", "sep"))
    return load(spark, d, "conversations").select("conv_id", "turn", F.size(kept).cast("bigint").alias("n_tokens"))


@query(
    "hashed_vectors",
    f"""WITH s AS (SELECT DISTINCT text FROM conversations),
t AS (SELECT text, unnest({tok_sql('text')}) AS tok FROM s),
h AS (SELECT text, {N60.format("'42', tok")} AS n FROM t)
SELECT sha256(text) AS text_key, (n // 2) % 64 AS dim, CAST(sum(CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS value
FROM h GROUP BY 1, 2""",
)
def hashed_vectors(spark, d):
    return hashed_token_vectors(load(spark, d, "conversations"), "text", 64)
