"""Ranked lexical search: exact inner products over sparse ball trees.

1. Items are searched in blocks of about BLOCK_TERMS terms; the driver holds one block at a time, and its terms are the
   dimensions. Each document becomes a sparse vector of occurrences of these terms, kept in the shared folder.
2. Document counts and lengths are summed over the vectors; a document's coordinate is weight times saturated frequency,
   an item is the vector of ones at its terms, and a score is their inner product, in 64-bit integers.
3. A task gathers its vectors into trees of at most TREE documents, or CELLS coordinates. A node keeps centroid and
   radius; centroid times item plus radius times the item's length, rounded up, bounds the scores below it. Each item
   goes down best-first and leaves a tree when no bound reaches its k-th score so far; leaves are scored exactly.
4. A task returns k documents an item at most; these are ranked, first in pieces.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableseek.llm.arrays import LOWER, dictionary_of, one_of, slices_by_bytes, text_views, words_of
from tableseek.llm.scratch import stored
from tableseek.operators.ranking import global_ids, prefix_sum

BLOCK_TERMS = 100_000
TREE = 1024
LEAF = 32
UNEVEN = 16  # the smaller child has at least about this share of a node
CELLS = 2_000_000
SLICE_BYTES = 4_000_000
PIECES = 16
SLACK = 1e-9  # relative; far above what rounding in doubles can add up to
LAST = np.iinfo(np.int64).max  # stands for a missing id, which comes last among equal scores

_APART = one_of(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def terms_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each term among the distinct ones, these, and the first term of each row (one entry more than rows)."""
    raw = LOWER[raw]
    starts, ends, first = words_of(raw, offsets, _APART)
    return *dictionary_of(raw[~_APART[raw]], ends - starts), first


class Tree:
    """A ball tree over some documents; x holds their coordinates (documents by dimensions, 64-bit integers)."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        points = x.astype(float)
        squares = np.einsum("ij,ij->i", points, points)
        self.children: list[tuple[int, int] | None] = [None]
        self.spans = [(0, len(x))]
        centres, radii, order, node = [], [], np.arange(len(x)), 0
        while node < len(self.spans):
            low, high = self.spans[node]
            rows = order[low:high]
            held = points[rows]
            centre = held.mean(0)
            square = float(centre @ centre)
            far = squares[rows] + square - 2 * (held @ centre)
            centres.append(centre)
            radii.append(math.sqrt(max(far.max(), 0) + SLACK * (squares[rows].max() + square)))
            if high - low > LEAF:
                a = rows[far.argmax()]
                to_a = squares[rows] + squares[a] - 2 * (held @ points[a])
                b = rows[to_a.argmax()]
                nearer = to_a - (squares[rows] + squares[b] - 2 * (held @ points[b]))
                order[low:high] = rows[np.argsort(nearer, kind="stable")]
                least = (high - low) // UNEVEN + 1
                middle = low + min(max(int((nearer < 0).sum()), least), high - low - least)
                self.children[node] = len(self.spans), len(self.spans) + 1
                self.spans += [(low, middle), (middle, high)]
                self.children += [None, None]
            node += 1
        self.centres, self.radii = np.array(centres), np.array(radii)
        del points, held
        self.x, self.ids = x[order], ids[order]

    def bounds(self, dims: np.ndarray) -> np.ndarray:
        """At least the score of any document below each node."""
        return (self.centres[:, dims].sum(1) + math.sqrt(len(dims)) * self.radii) * (1 + SLACK) + 1

    def search(self, dims: np.ndarray, best: Best) -> int:
        """Puts the documents that belong there into best; returns the number of leaves scored."""
        bounds, scored = self.bounds(dims).tolist(), 0
        queue = [(-bounds[0], 0)]
        while queue and -queue[0][0] >= best.least:
            node = heapq.heappop(queue)[1]
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= best.least:
                        heapq.heappush(queue, (-bounds[child], child))
            else:
                low, high = self.spans[node]
                best.offer(self.x[low:high, dims].sum(1), self.ids[low:high])
                scored += 1
        return scored


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
            keep = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[keep], ids[keep]
            if len(keep) == self.k:
                self.least = int(self.scores[-1])


class Block:
    """Terms of a block of items: distinct terms, and the dimensions of each item."""

    def __init__(self, numbers: list[int], terms: list[list[str]]):
        self.numbers = numbers
        self.terms = pa.array(sorted({t for ts in terms for t in ts}, key=str.encode), pa.large_string()).cast(pa.large_binary())
        place = {t: i for i, t in enumerate(self.terms.to_pylist())}
        self.dims = [np.array(sorted(place[t.encode()] for t in ts), np.int64) for ts in terms]


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item, item_id and terms of each row of items that has terms, and the block it is searched in."""

    def split(batches):
        for batch in batches:
            raw, offsets = text_views(batch.column(1))
            code, words, first = terms_of(raw, offsets)
            words = words.cast(pa.string())
            found = [words.take(pa.array(np.unique(code[a:b]))).to_pylist() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["item_id", "terms"])

    split_items = items.select(F.col(item_id).cast("long"), F.col(text)).mapInArrow(split, "item_id long, terms array<string>").where(F.size("terms") > 0)
    numbered = global_ids(split_items, ["item_id", "terms"], name="item").select("item", "item_id", "terms", F.size("terms").cast("long").alias("size"), F.lit(0).alias("all"))
    placed = prefix_sum(numbered, ["all"], ["item"], "size", F.floor(F.col("item") / 4096))
    return stored(placed.select("item", "item_id", "terms", F.floor(F.col("before") / BLOCK_TERMS).cast("long").alias("block")), "items")


def _vectors(texts: DataFrame, block) -> DataFrame:
    """doc_id, n (terms with repeats), terms and their occurrences of each document that has terms."""

    def count(batches):
        vocabulary = block.value.terms
        for batch in batches:
            raw, offsets = text_views(batch.column(1))
            for a, b in slices_by_bytes(offsets, SLICE_BYTES):
                code, words, first = terms_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n = np.diff(first)
                known = pc.index_in(words, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = known[code] if len(code) else code
                here = term >= 0
                pairs, times = np.unique(np.repeat(np.arange(b - a), n)[here] * len(vocabulary) + term[here], return_counts=True)
                row, term = np.divmod(pairs, len(vocabulary))
                cuts = (np.searchsorted(row, np.arange(b - a + 1)) * 4).tolist()
                held = np.flatnonzero(n)
                packed = [x.astype("<i4").tobytes() for x in (term, times)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(held)), pa.array(n[held].astype(np.int64)),
                        *(pa.array([data[cuts[i] : cuts[i + 1]] for i in held], pa.binary()) for data in packed),
                    ],
                    names=["doc_id", "n", "terms", "times"],
                )

    return stored(texts.mapInArrow(count, "doc_id long, n long, terms binary, times binary"), "vectors")


def _holders(vectors: DataFrame) -> DataFrame:
    """Number of documents that hold each term."""

    def count(batches):
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4")
            term, df = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int64)), pa.array(df.astype(np.int64))], names=["term", "df"])

    return vectors.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def trees(batches, weights: np.ndarray, documents: int, length: int):
    """Trees over (doc_id, n, terms, times) rows, each with its dimensions; all rows but those without a term."""
    held, cells = [], 0
    for batch in batches:
        ids = batch.column(0).fill_null(LAST).to_pylist()
        for doc_id, n, terms, times in zip(ids, *(batch.column(i).to_pylist() for i in (1, 2, 3))):
            if terms:
                size = len(terms) // 4
                if held and (len(held) >= TREE or (len(held) + 1) * min(len(weights), cells + size) > CELLS):
                    yield _tree(held, weights, documents, length)
                    held, cells = [], 0
                held.append((doc_id, n, terms, times))
                cells += size
    if held:
        yield _tree(held, weights, documents, length)


def _tree(held: list, weights: np.ndarray, documents: int, length: int) -> tuple[Tree, np.ndarray]:
    terms, times = (np.frombuffer(b"".join(h[i] for h in held), "<i4").astype(np.int64) for i in (2, 3))
    row = np.repeat(np.arange(len(held)), [len(h[2]) // 4 for h in held])
    m = np.array([100 - 50 + 50 * h[1] * documents // length for h in held], np.int64)
    active, place = np.unique(terms, return_inverse=True)
    x = np.zeros((len(held), len(active)), np.int64)
    x[row, place] = weights[terms] * (1_000_000_000 * times // (1000 * times + 20 * m[row]))
    return Tree(x, np.array([h[0] for h in held], np.int64)), active


def _search(vectors: DataFrame, block, weights, documents: int, length: int, k: int) -> DataFrame:
    """item, doc_id and score: each task's best."""

    def search(batches):
        items = block.value
        best = [Best(k) for _ in items.dims]
        place = np.full(len(weights.value), -1, np.int64)
        for tree, active in trees(batches, weights.value, documents, length):
            place[active] = np.arange(len(active))
            for dims, found in zip(items.dims, best):
                own = place[dims]
                own = own[own >= 0]
                if len(own):
                    tree.search(own, found)
            place[active] = -1
            del tree  # before the next one is built
        for number, found in zip(items.numbers, best):
            if len(found.ids):
                n = len(found.ids)
                ids = pa.array(found.ids, mask=found.ids == LAST)
                yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), ids, pa.array(found.scores)], names=["item", "doc_id", "score"])

    return vectors.select("doc_id", "n", "terms", "times").mapInArrow(search, "item long, doc_id long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of each item, those with score 0 left out.

    Equal scores go by ascending doc_id, documents without id last. Null and empty texts have no terms: as documents they
    do not count, as items they find nothing. Repeated rows of docs are documents of their own, and so are those of items,
    each with its own ranks. Items without id are searched too. Empty tables give an empty result. Texts count whole,
    however long; other columns are ignored, whatever their names.
    """
    context = docs.sparkSession.sparkContext
    placed = _item_terms(items, item_id, item_text)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for number in range((placed.agg(F.max("block")).first()[0] or 0) + 1):
        rows = placed.where(F.col("block") == number).select("item", "terms").orderBy("item").collect()  # BLOCK_TERMS terms
        if not rows:
            continue
        block = context.broadcast(Block([r.item for r in rows], [r.terms for r in rows]))
        vectors = _vectors(texts, block)
        size = vectors.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length")).first()
        held = np.zeros(len(block.value.terms), np.int64)
        for r in _holders(vectors).collect():
            held[r.term] = r.df
        weights = np.array([math.floor(1000 * math.log((2 * size.documents + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)
        weights = context.broadcast(weights)
        part = stored(_search(vectors, block, weights, size.documents, size.length or 1, k), "best")
        block.destroy()
        weights.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    piece = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PIECES))
    some = found.withColumn("piece", piece).withColumn("rank", F.row_number().over(Window.partitionBy("item", "piece").orderBy(*order)))
    some = some.where(F.col("rank") <= k).drop("rank").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
    return some.where(F.col("rank") <= k).join(placed.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
