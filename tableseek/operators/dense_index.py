"""A stored two-stage index over multi-vector tables.

The number of lists grows with the square root of the vectors, so a probe meets about that many of them. Centroids are
seeded vectors of the collection. A list holds its vectors as one byte per dimension of the residual to the centroid,
and is partitioned by centroid, so a search opens only the lists that its tokens probe.

Search first adds up, per table, the best probed centroid of each token, and keeps ``cut`` tables a query; only these are
scored in full, from the given vectors or from the stored codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableseek.operators.ranking import top_k
from tableseek.operators.scoring import _rounded, nearest_centroids, score_candidates, seeded_centroids
from tableseek.session import materialize
from tableseek.sources.commit_log import CommitLog

MAX_LISTS = 65_536  # bounds the codebook that tasks hold
BUCKETS = 32
# Vectors whose lists, and probes, meet in one task
VECTORS_PER_BLOCK, PROBES_PER_BLOCK = 500_000, 500_000


def list_count(n_vectors: int) -> int:
    return min(MAX_LISTS, math.isqrt(max(n_vectors - 1, 0)) + 1)


def _with_book(centroids: DataFrame):
    """Broadcast of {centroid: unit vector}; MAX_LISTS bounds it."""
    book = {}
    for row in centroids.collect():
        vec = np.asarray(row["vec"], np.float64)
        book[row["centroid"]] = vec / max(np.linalg.norm(vec), 1e-12)
    return centroids.sparkSession.sparkContext.broadcast(book)


def encode_residuals(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """vec of (…, vec, centroid) as ``code`` (signed bytes) times ``scale``: the unit vector less its centroid."""
    book = _with_book(centroids)
    kept = [f for f in assigned.schema if f.name != "vec"]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", code binary, scale float"

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = np.stack(batch["vec"].to_numpy()).astype(np.float64)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            rest = x - np.stack([book.value[c] for c in batch["centroid"]])
            scale = (np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127).astype(np.float32)
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            out = batch[names].copy()
            out["code"], out["scale"] = [c.tobytes() for c in codes], scale
            yield out

    return assigned.mapInPandas(code, schema)


def decode_residuals(coded: DataFrame, centroids: DataFrame) -> DataFrame:
    """The vectors back, of length one but for rounding."""
    book = _with_book(centroids)
    kept = [f for f in coded.schema if f.name not in ("code", "scale", "centroid")]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", vec array<double>"

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[names].copy()
            out["vec"] = [
                book.value[c] + np.frombuffer(code, np.int8) * float(scale)
                for c, code, scale in zip(batch["centroid"], batch["code"], batch["scale"])
            ]
            yield out

    return coded.mapInPandas(back, schema)


def _best_sums(cut: int):
    """Of probes and lists of one block, the cut best tables of each query by the sum over its tokens of the best probed
    centroid, of six places; equal ones by table."""
    names = ["query_id", "table_id", "score"]

    def best(probes: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        if probes.empty or lists.empty:
            return pd.DataFrame(columns=names)
        tables, at = np.unique(lists["table_id"].to_numpy(str), return_inverse=True)
        order = np.argsort(lists["centroid"].to_numpy(), kind="stable")
        at, kinds = at[order], lists["centroid"].to_numpy()[order]
        probes = probes.sort_values(["query_id", "tok_idx", "_s"], ascending=[True, True, False], kind="stable")
        low = np.searchsorted(kinds, probes["centroid"], "left").tolist()
        high = np.searchsorted(kinds, probes["centroid"], "right").tolist()
        query, token, s = (probes[c].to_numpy() for c in ("query_id", "tok_idx", "_s"))
        fresh = np.append(True, (query[1:] != query[:-1]) | (token[1:] != token[:-1]))
        starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        total, met = np.zeros(len(tables)), np.full(len(tables), -1)
        turn, out = 0, []
        for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(query)]):
            begun = turn = turn + 1
            for i in range(start, end):
                turn += int(fresh[i])
                here = at[low[i] : high[i]]
                here = here[met[here] != turn]  # a token's better probes have counted already
                total[here[met[here] < begun]] = 0
                total[here] += s[i]
                met[here] = turn
            hit = np.flatnonzero(met >= begun)
            score = _rounded(total[hit])
            if len(hit) > cut:
                least = np.partition(score, -cut)[-cut]
                above = np.flatnonzero(score > least)
                kept = np.concatenate([above, np.flatnonzero(score == least)[: cut - len(above)]])
                hit, score = hit[kept], score[kept]
            out.append((np.full(len(hit), query[start]), hit, score))
        ids, hits, scores = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"query_id": ids, "table_id": tables[hits], "score": scores})

    return best


class DenseIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)
        self.entry = self.log.latest()

    def build(self, cells: DataFrame, key: str, seed: int = 42) -> DenseIndex:
        """Replaces the index by one over cells(table_id, row_idx, col_idx, vec, key); readers see the old one until then."""
        folder, n = self.log.stage("lists"), cells.count()
        seeded_centroids(cells, key, list_count(n), seed).write.parquet(self.log.full(f"{folder}/centroids"))
        centroids = self.spark.read.parquet(self.log.full(f"{folder}/centroids"))
        placed = nearest_centroids(cells.select("table_id", "row_idx", "col_idx", "vec"), centroids, 1)
        coded = encode_residuals(placed, centroids).withColumn("bucket", F.pmod(F.xxhash64("centroid"), F.lit(BUCKETS)).cast("int"))
        spread = coded.repartition("bucket", F.pmod(F.xxhash64("table_id"), F.lit(4)))
        spread.sortWithinPartitions("bucket", "centroid").write.partitionBy("bucket").parquet(self.log.full(f"{folder}/vectors"))
        self.log.commit({"folder": folder, "vectors": n, "lists": list_count(n)}, self.entry["version"] if self.entry else 0)
        self.entry = self.log.latest()
        return self

    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(self.log.full(f"{self.entry['folder']}/centroids"))

    def lists(self) -> DataFrame:
        """bucket, centroid, table_id, row_idx, col_idx, code, scale."""
        return self.spark.read.parquet(self.log.full(f"{self.entry['folder']}/vectors"))

    def decoded(self) -> DataFrame:
        """table_id, row_idx, col_idx, vec as the codes have them."""
        return decode_residuals(self.lists().drop("bucket"), self.centroids())

    def candidates(self, query_vecs: DataFrame, n_probe: int, cut: int) -> DataFrame:
        """query_id, table_id, score and rank of the ``cut`` tables with the best sums of probed centroids."""
        asked = query_vecs.select("query_id", "tok_idx", "vec")
        probes = nearest_centroids(asked, self.centroids(), n_probe, similarity="_s").select("query_id", "tok_idx", "centroid", "_s")
        probes = materialize(probes.withColumn("bucket", F.pmod(F.xxhash64("centroid"), F.lit(BUCKETS)).cast("int")), "probes")
        opened = [r[0] for r in probes.select("bucket").distinct().collect()]
        lists = self.lists().filter(F.col("bucket").isin(opened)).select("centroid", "table_id").distinct()
        # blocks of queries meet blocks of tables: a probe meets a list inside a task, and cut tables a query leave it
        n, cores = probes.count(), self.spark.sparkContext.defaultParallelism
        table_blocks = max(1, -(-self.entry["vectors"] // VECTORS_PER_BLOCK))
        query_blocks = max(1, -(-n // PROBES_PER_BLOCK), min(-(-2 * cores // table_blocks), -(-n // 8192)))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        keys = ["_qb", "_tb"]
        asked = probes.select("query_id", "tok_idx", "centroid", "_s", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("_qb"), every(table_blocks).alias("_tb"))
        lists = lists.select("centroid", "table_id", F.pmod(F.xxhash64("table_id"), F.lit(table_blocks)).cast("int").alias("_tb"), every(query_blocks).alias("_qb"))
        summed = asked.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInPandas(_best_sums(cut), "query_id bigint, table_id string, score double")
        return top_k(summed, ["query_id"], [F.desc("score"), "table_id"], cut)

    def search(self, query_vecs: DataFrame, k: int, n_probe: int = 4, cut: int = 256, cells: DataFrame | None = None, mode: str = "global") -> DataFrame:
        """query_id, table_id, score and rank of the k best candidates, scored on ``cells`` or else on the stored codes."""
        chosen = materialize(self.candidates(query_vecs, n_probe, cut).select("query_id", "table_id"), "chosen")
        scored = score_candidates(chosen, query_vecs, self.decoded() if cells is None else cells)
        return top_k(scored.select("query_id", "table_id", F.round(mode, 6).alias("score")), ["query_id"], [F.desc("score"), "table_id"], k)
