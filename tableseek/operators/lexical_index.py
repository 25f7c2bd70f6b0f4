"""A stored inverted index: segments of postings in blocks, and search that reads only what can matter.

A segment holds the postings of some documents. Documents are dealt by hash into ranges of about RANGE documents, and a
block is the list of (document, tf, length) of one term in one range, with the largest tf and the smallest length in it.
Blocks and the term dictionary (df, cf) are partitioned by term hash, so a search opens only the buckets of its terms.

Building deals the texts by range once; counts and blocks are made where a range's texts are. Search reads the blocks of
the queries' terms, deals them by range once, and scores range by range; a task passes on its k best of every query.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tableseek.functions import text as T
from tableseek.operators.ranking import top_k
from tableseek.session import materialize
from tableseek.sources.commit_log import CommitLog

RANGE = 256
BUCKETS = 32
SEGMENTS = 8  # an index of more segments is merged into one
TASK_DOCS = 4096  # documents whose postings or scores meet in one task, about
LEADING = 4  # of the former search in two phases; not read any more
K1, B = 0.9, 0.4


class LexicalIndex:
    """An index in a folder; every change is one commit."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)
        self.entry: dict[str, Any] = self.log.latest() or {"version": 0, "segments": [], "buckets": BUCKETS}

    @property
    def segments(self) -> list[dict[str, Any]]:
        return self.entry["segments"]

    @property
    def n_docs(self) -> int:
        return sum(s["docs"] for s in self.segments)

    @property
    def avg_len(self) -> float:
        return sum(s["tokens"] for s in self.segments) / max(self.n_docs, 1)

    def bucket(self, term: str | Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.entry["buckets"])).cast("int")

    def append(self, docs: DataFrame, key: str = "id", text: str = "contents") -> LexicalIndex:
        """Adds documents as a segment of their own; the other segments are not touched. Keys must be new."""
        n = docs.count()
        ranges = max(1, -(-n // RANGE))
        dealt = docs.select(F.col(key).alias("key"), F.col(text).alias("_x"), _range_of("key", ranges)).repartition(self._tasks(n), "range")
        lengths = dealt.select("range", "key", T.tokens("_x").alias("_t"))
        tokens = T.exploded(lengths, F.col("_t"), "term", "range", "key", F.size("_t").alias("len"))
        tf = tokens.groupBy("range", "term", "key", "len").agg(F.count("*").cast("int").alias("tf"))
        return self._write(self._blocks_of(tf), n, ranges, self.segments)

    def merge(self) -> LexicalIndex:
        """One segment instead of all; no text is read. Ranges are kept and numbered on, or dealt anew where most are far from full."""
        n, kept = self.n_docs, sum(s["ranges"] for s in self.segments)
        ranges = max(1, -(-n // RANGE))
        if kept <= 2 * ranges + 1:
            starts, start = F.lit(0), 0
            for number, segment in enumerate(self.segments):
                starts, start = F.when(F.col("segment") == number, F.lit(start)).otherwise(starts), start + segment["ranges"]
            moved = self.blocks().withColumn("range", (F.col("range") + starts).cast("int")).drop("segment")
            return self._write(moved, n, kept, [], self.terms())
        postings = self.blocks().select("term", F.inline("list")).select(_range_of("key", ranges), "term", "key", "len", "tf")
        return self._write(self._blocks_of(postings.repartition(self._tasks(n), "range")), n, ranges, [], self.terms())

    def _tasks(self, docs: int) -> int:
        """Tasks for so many documents: few documents are still dealt over the cores."""
        return max(-(-docs // TASK_DOCS), min(self.spark.sparkContext.defaultParallelism, -(-docs // RANGE)), 1)

    def _blocks_of(self, tf: DataFrame) -> DataFrame:
        """Blocks of tf(range, term, key, len, tf); rows that are dealt by range are not moved again."""
        return tf.groupBy("range", "term").agg(
            F.count("*").alias("n"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"),
            F.collect_list(F.struct("key", "len", "tf")).alias("list"),  # a range bounds it
        ).withColumn("bucket", self.bucket("term"))

    def _write(self, blocks: DataFrame, docs: int, ranges: int, others: list[dict[str, Any]], terms: DataFrame | None = None) -> LexicalIndex:
        """Commits a segment of these blocks; its term dictionary is ``terms`` where it is known, or counted from the blocks."""
        folder = self.log.stage("segment")
        blocks.sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(self.log.full(f"{folder}/blocks"))
        fields = [f for f in blocks.schema if f.name != "bucket"] + [blocks.schema["bucket"]]
        stored = self.spark.read.schema(StructType(fields)).parquet(self.log.full(f"{folder}/blocks"))
        if terms is None:
            terms = stored.groupBy("bucket", "term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").alias("max_tf"))
        # written where they are counted; a bucket's terms are not gathered by a shuffle of their own
        terms.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(self.log.full(f"{folder}/terms"))
        tokens = stored.agg(F.coalesce(F.sum("cf"), F.lit(0))).first()[0]
        made = {"folder": folder, "docs": docs, "tokens": tokens, "ranges": ranges}
        self.log.commit({"segments": [*others, made], "buckets": self.entry["buckets"]}, self.entry["version"])
        self.entry = self.log.latest()
        return self if len(self.segments) <= SEGMENTS else self.merge()

    def _read(self, part: str) -> DataFrame:
        found = None
        for number, segment in enumerate(self.segments):
            rows = self.spark.read.parquet(self.log.full(f"{segment['folder']}/{part}")).withColumn("segment", F.lit(number))
            found = rows if found is None else found.unionByName(rows)
        if found is None:
            raise ValueError(f"no index in {self.log.path}")
        return found

    def blocks(self) -> DataFrame:
        """segment, bucket, term, range, n, cf, max_tf, min_len and list(key, len, tf)."""
        return self._read("blocks")

    def terms(self) -> DataFrame:
        """Term dictionary: term, df, cf, max_tf over all segments."""
        return self._read("terms").groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").alias("max_tf"))

    def weights(self, queries: DataFrame) -> DataFrame:
        """query_id, bucket, term, df and weight of the terms of queries(query_id, text) that the index holds."""
        asked = T.exploded(queries, T.tokens("text"), "term", "query_id").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        asked = materialize(asked.withColumn("bucket", self.bucket("term")), "asked")
        stored = self._read("terms").where(F.col("bucket").isin(_buckets(asked)))
        held = stored.join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (self.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return materialize(asked.join(held, ["bucket", "term"]).select("query_id", "bucket", "term", "df", (idf * F.col("qtf")).alias("weight")), "weights")

    def saturation(self, tf: str, length: str, k1: float = K1, b: float = B) -> Column:
        return F.col(tf) / (F.col(tf) + k1 * (1 - b + b * F.col(length) / self.avg_len))

    def scores(self, queries: DataFrame, key: str = "id", k1: float = K1, b: float = B) -> DataFrame:
        """query_id, document and score (six places) of every document that shares a term with the query.

        Only blocks of the queries' terms are moved, once; a document's scores add up where its range is."""
        weights = self.weights(queries)
        blocks = self.blocks().where(F.col("bucket").isin(_buckets(weights)))
        touched = blocks.join(weights.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
        # arrays of plain numbers travel in less than half the bytes of an array of structs
        # one column for both: the number of a single segment is a constant, which a partitioning by two columns does not survive
        place = F.xxhash64("segment", "range").alias("place")
        flat = touched.select(place, "term", *[F.col(f"list.{c}").alias(c) for c in ("key", "len", "tf")])
        dealt = flat.repartition(self._tasks(self.n_docs), "place")
        postings = dealt.select("place", "term", F.inline(F.arrays_zip("key", "len", "tf")))
        found = postings.join(weights.select("query_id", "term", "weight"), "term")
        score = F.sum(F.col("weight") * self.saturation("tf", "len", k1, b))
        summed = found.groupBy("place", "query_id", "key").agg(F.round(score, 6).alias("score"))
        return summed.select("query_id", F.col("key").alias(key), "score")

    def search(self, queries: DataFrame, k: int, key: str = "id", k1: float = K1, b: float = B) -> DataFrame:
        """query_id, document, score (six places) and rank: the k best documents that share a term with the query."""
        return top_k(self.scores(queries, key, k1, b), ["query_id"], [F.desc("score"), key], k)


def _range_of(key: str, ranges: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(ranges)).cast("int").alias("range")


def _buckets(terms: DataFrame) -> list[int]:
    """Numbers of the buckets that hold these terms: as many as the index has at most."""
    return [r[0] for r in terms.select("bucket").distinct().collect()]


def build_index(docs: DataFrame, path: str, key: str = "id", text: str = "contents") -> LexicalIndex:
    """A new index over docs; an existing one is not overwritten."""
    index = LexicalIndex(docs.sparkSession, path)
    if index.segments:
        raise ValueError(f"{path} holds an index already")
    return index.append(docs, key, text)


def open_or_build(docs: DataFrame, path: str, key: str = "id", text: str = "contents") -> LexicalIndex:
    index = LexicalIndex(docs.sparkSession, path)
    return index if index.segments else index.append(docs, key, text)


def passages_by_index(index: LexicalIndex, docs: DataFrame, passages: DataFrame, key: str = "id", text: str = "contents", rare: int = 3) -> DataFrame:
    """(query_id, document) where the passage's whole token sequence occurs in the document.

    Candidates hold all of the passage's ``rare`` rarest terms; only their texts are read and compared.
    """
    toks = passages.select("query_id", T.tokens("text").alias("_p")).where(F.size("_p") > 0)
    weights = index.weights(passages)
    # a passage with a term that no document holds has none; its other terms decide nothing
    full = toks.select("query_id", F.size(F.array_distinct("_p")).alias("_n"))
    known = weights.groupBy("query_id").agg(F.count("*").alias("_held")).join(full, "query_id").where("_held = _n").select("query_id")
    rarest = top_k(weights.join(known, "query_id", "left_semi"), ["query_id"], ["df", "term"], rare)
    blocks = index.blocks().where(F.col("bucket").isin(_buckets(weights)))
    met = rarest.select("query_id", "bucket", "term").join(blocks.select("bucket", "term", "list"), ["bucket", "term"])
    met = met.select("query_id", F.inline("list")).groupBy("query_id", "key").agg(F.count("*").alias("_met"))
    wanted = rarest.groupBy("query_id").agg(F.count("*").alias("_want"))
    # stored, so that its size is known and texts are not moved to meet few pairs
    pairs = materialize(met.join(wanted, "query_id").where("_met = _want").select("query_id", F.col("key").alias(key)), "pairs")
    spaced = lambda tokens: F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    candidates = docs.join(pairs.select(key).distinct(), key, "left_semi").select(key, spaced(T.tokens(text)).alias("_ds"))
    checked = pairs.join(toks.select("query_id", spaced("_p").alias("_ps")), "query_id").join(candidates, key)
    return checked.where(F.contains("_ds", "_ps")).select("query_id", key)
