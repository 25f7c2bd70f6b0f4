"""Lexical index and search: postings, BM25, passage qrels, corpus augmentation."""

from __future__ import annotations

from pyspark.ml.feature import NGram
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.operators.ranking import small_or_unhinted, top_k
from tableseek.operators.sampling import fill_to_size
from tableseek.session import materialize


def postings(docs: DataFrame, key: str = "id", text: str = "contents") -> DataFrame:
    """term, id, tf and token positions. A posting is bounded by its document."""
    placed = T.exploded(docs, T.tokens(text), "term", key, position="pos")
    return placed.groupBy("term", key).agg(
        F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions")
    )


def document_stats(docs: DataFrame, text: str = "contents") -> DataFrame:
    """One row: number of documents, tokens, average length."""
    return docs.agg(
        F.count("*").alias("n_docs"),
        F.sum(F.size(T.tokens(text))).alias("n_tokens"),
        F.avg(F.size(T.tokens(text))).alias("avg_len"),
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf over queries(query_id, text)."""
    terms = T.exploded(queries, T.tokens("text"), "term", "query_id")
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(
    docs: DataFrame, queries: DataFrame, key: str = "id", text: str = "contents", k1: float = 0.9, b: float = 0.4
) -> DataFrame:
    """query_id, document, BM25 score for every document that shares a term with the query.

    Tokens are cut to the query vocabulary before anything is shuffled and counted per
    document map-side; the length travels with the token, so no join brings it back. The
    term join is a broadcast only when the query terms were counted small, otherwise a
    shuffle join whose frequent terms AQE splits.
    """
    asked = query_terms(queries)
    vocabulary = small_or_unhinted(asked.select("term").distinct())
    lengths = docs.select(key, T.tokens(text).alias("_t"))
    tokens = T.exploded(lengths, F.col("_t"), "term", key, F.size("_t").alias("_len"))
    tf = tokens.join(vocabulary, "term", "left_semi").groupBy(key, "_len", "term").agg(F.count("*").alias("tf"))

    stats = docs.agg(F.struct(F.count("*").alias("n"), F.avg(F.size(T.tokens(text))).alias("len")).alias("s")).scalar()
    n_docs, avg_len = stats["n"], stats["len"]
    # Reading tf here keeps both uses of the counts on one shuffle.
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("_df"))
    idf = F.log(1 + (n_docs - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weights = asked.join(df, "term").select("query_id", "term", (idf * F.col("qtf")).alias("_w"))
    saturation = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("_len") / avg_len))
    matched = tf.join(weights, "term")
    return matched.groupBy("query_id", key).agg(F.sum(F.col("_w") * saturation).alias("score"))


def bm25_search(docs: DataFrame, queries: DataFrame, k: int, key: str = "id", text: str = "contents") -> DataFrame:
    scores = bm25_scores(docs, queries, key, text).withColumn("score", F.round("score", 6))
    return top_k(scores, ["query_id"], [F.desc("score"), key], k)


def fetch(hits: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """Stored documents of the hits."""
    return materialize(hits, "hits").join(docs, key)


def passage_qrels(docs: DataFrame, passages: DataFrame, key: str = "id", text: str = "contents", gram: int = 8) -> DataFrame:
    """(query_id, document) where the passage's whole token sequence occurs in the document.

    Candidates share the passage's opening gram (shorter passages use their
    whole length); a final check compares the full sequences.
    """
    toks = passages.select("query_id", T.tokens("text").alias("_p")).filter(F.size("_p") > 0)
    opened = toks.select(
        "query_id", F.least(F.size("_p"), F.lit(gram)).alias("_m"), F.array_join(F.slice("_p", 1, gram), " ").alias("_g")
    )
    sizes = [r[0] for r in opened.select("_m").distinct().collect()]  # at most ``gram`` values
    if not sizes:
        return docs.select(F.lit(None).cast("bigint").alias("query_id"), key).limit(0)
    doc_tokens = docs.select(key, T.tokens(text).alias("_t"))
    listed = None
    for m in sizes:
        grams = NGram(n=m, inputCol="_t", outputCol="_n").transform(doc_tokens)
        part = T.exploded(grams, F.col("_n"), "_g", key, F.lit(m).alias("_m"))
        listed = part if listed is None else listed.unionByName(part)
    pairs = listed.join(small_or_unhinted(opened), ["_m", "_g"]).select("query_id", key).distinct()
    passage_text = toks.select("query_id", F.concat(F.lit(" "), F.array_join("_p", " "), F.lit(" ")).alias("_ps"))
    doc_text = doc_tokens.select(key, F.concat(F.lit(" "), F.array_join("_t", " "), F.lit(" ")).alias("_ds"))
    checked = pairs.join(passage_text, "query_id").join(doc_text, key)
    return checked.filter(F.contains("_ds", "_ps")).select("query_id", key)


def augment_corpus(
    docs: DataFrame, seeds: DataFrame, k: int, size: int, key: str = "id", text: str = "contents", hits: DataFrame | None = None
) -> DataFrame:
    """Distinct top-k hits of all seed texts, filled at random to ``size``; origin marks which.

    ``hits`` are the seeds' hits where an index has them already. The choice is stored, so that texts need not be moved to meet it."""
    found = bm25_search(docs, seeds, k, key, text) if hits is None else hits
    chosen = fill_to_size(materialize(found.select(key).distinct(), "required"), docs.select(key), key, size)
    return docs.join(materialize(chosen, "chosen"), key)
