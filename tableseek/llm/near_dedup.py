"""MinHash near-dedup by a chosen-path set similarity join.

1. Each text becomes a set of word shingles and a sketch of DRAWS minwise values. Equal sets are one class.
2. In each of TREES independent trees a class walks down chosen paths: a node picks, by its own hash, one of the
   sketch's positions, or two with chance 1 / similarity - 1, and the class moves on to the child named by its value
   there. Classes at the threshold so keep one common node a level on average, unlike ones soon part. Nodes of DEPTH
   levels with at most SMALL classes are compared exhaustively by sketch, which leaves a spanning forest of likely
   links. In larger nodes every class is compared with the first one, and unless all agree with it they branch on for
   DEEPER levels. Links are contracted in slices; what stayed large is compared exhaustively unless it is one cluster.
3. Likely links join classes to clusters, somewhat too large. Each cluster's texts are brought together once and links
   are confirmed on the full sets, in blocks of about BLOCK classes or BLOCK_SHINGLES and between all pairs of blocks.
4. Confirmed links give the components.

No pairs of a group are listed: nodes and blocks return spanning forests. Trees miss a link at the threshold with a
chance of about 1e-4, closer ones far less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableseek.llm.arrays import mix, slices_by_bytes, text_views, word_hashes, words_of
from tableseek.llm.scratch import stored

DRAWS = 64
TREES = 14
DEPTH = 4
DEEPER = 2
SMALL = 256
PARTS = 32  # in which the members of a large node meet its first one
SLICE_LINKS = 500_000
BLOCK = 3000
BLOCK_SHINGLES = 2_000_000
LIKELY = 37 / 64  # share of equal sketch values from which a link is worth a check
SLICE_BYTES = 1_000_000

_FACTORS = np.random.default_rng(5).integers(0, 2**63, DRAWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending in each row, and the bounds of the rows.

    A shingle is `size` consecutive words, A-Z in lower case; a text with fewer words has one shingle, all of them.
    """
    n = len(offsets) - 1
    raw = _LOWER[raw]
    starts, ends, first = words_of(raw, offsets)
    words = word_hashes(raw, starts, ends)
    counts = np.diff(first)
    rows = np.repeat(np.arange(n), counts)
    hashes = words.copy()
    at = np.arange(len(words))
    left = np.repeat(first[1:], counts) - at  # words from here to the end
    short = np.repeat(counts, counts)
    for step in range(1, size):
        more = (left > step) & ((short >= size) | (at == np.repeat(first[:-1], counts)))
        hashes[more] = mix(hashes[more] * np.uint64(3) + words[at[more] + step])
    begins = np.where(short >= size, left >= size, at == np.repeat(first[:-1], counts))
    rows, hashes = rows[begins], hashes[begins]
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    rows, hashes = rows[fresh], hashes[fresh]
    return hashes, np.searchsorted(rows, np.arange(n + 1))


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """DRAWS minwise values of each set, cut to a byte; rows of empty sets are zero."""
    out = np.zeros((len(bounds) - 1, DRAWS), np.uint8)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for i, factor in enumerate(_FACTORS):
            least = np.minimum.reduceat(((hashes * factor) ^ factor) >> np.uint64(16), bounds[full])
            out[full, i] = (mix(least) & np.uint64(255)).astype(np.uint8)
    return out


def similar(a: int | np.ndarray, b: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


class Forest:
    """Union by smallest number."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def likely_forest(sketch: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the likely links of a small node."""
    forest, out = Forest(len(sketch)), []
    for i in range(len(sketch) - 1):
        for j in (i + 1 + np.flatnonzero((sketch[i + 1 :] == sketch[i]).mean(1) >= LIKELY)).tolist():
            if forest.join(i, j):
                out.append((i, j))
    return out


def contracted(links: DataFrame) -> DataFrame:
    """Links (a, b) that join the same: each task replaces about SLICE_LINKS of them by stars, one link for each class."""

    def contract(batches):
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        a, b = (np.asarray(table.column(i)) for i in (0, 1))
        keys, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(keys))
        for i, j in zip(place[: len(a)].tolist(), place[len(a) :].tolist()):
            forest.join(i, j)
        roots = forest.roots()
        member = np.flatnonzero(roots != np.arange(len(keys)))
        yield pa.RecordBatch.from_arrays([pa.array(keys[roots[member]]), pa.array(keys[member])], names=["a", "b"])

    tasks = 1 + links.count() // SLICE_LINKS
    return links.select("a", "b").repartition(tasks).mapInArrow(contract, "a long, b long")


def confirmed_forest(hashes: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """Smallest member of the component of each set; links are confirmed on the full sets."""
    sketch, sizes = sketches(hashes, bounds), np.diff(bounds)
    forest = Forest(len(sizes))
    for i in range(len(sizes) - 1):
        roots = forest.roots()
        near = np.flatnonzero(roots[i + 1 :] != roots[i]) + i + 1
        if not len(near):
            if (roots == roots[0]).all():
                break
            continue
        near = near[(100 * np.minimum(sizes[near], sizes[i]) >= percent * np.maximum(sizes[near], sizes[i]))]
        near = near[(sketch[near] == sketch[i]).mean(1) >= LIKELY]
        if not len(near):
            continue
        mine = hashes[bounds[i] : bounds[i + 1]]
        other = np.concatenate([hashes[bounds[j] : bounds[j + 1]] for j in near])
        hit = mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other
        common = np.add.reduceat(hit, np.cumsum(sizes[near]) - sizes[near])
        for j in near[similar(sizes[i], sizes[near], common, percent)].tolist():
            forest.join(i, j)
    return forest.roots()


def _sets(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """row (doc_id), digest of the text, n_shingles, key (a 64-bit name of the set, null for an empty one) and sketch of each text."""

    def measure(batches):
        for batch in batches:
            raw, offsets = text_views(batch.column(1))
            parts: list[list] = [[], [], []]
            for a, b in slices_by_bytes(offsets, SLICE_BYTES):
                hashes, bounds = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                sums = np.zeros(len(hashes) + 1, np.uint64)
                np.cumsum(mix(hashes), out=sums[1:])
                counts = np.diff(bounds)
                parts[0].append(counts)
                parts[1].append(mix((sums[bounds[1:]] - sums[bounds[:-1]]) * np.uint64(5) + counts.astype(np.uint64)).astype(np.int64))
                parts[2].append(sketches(hashes, bounds))
            counts, keys, sketch = (np.concatenate(p) if p else np.zeros((0, DRAWS) if i == 2 else 0, np.int64) for i, p in enumerate(parts))
            data = sketch.astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(keys, pa.int64(), mask=counts == 0),
                    pa.array([data[i : i + DRAWS] for i in range(0, len(data), DRAWS)], pa.binary()),
                ],
                names=["row", "digest", "n_shingles", "key", "sketch"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("row"), F.col(text), F.xxhash64(text).alias("digest")).mapInArrow(
        measure, "row long, digest long, n_shingles long, key long, sketch binary"
    )


def _walk(node: np.ndarray, member: np.ndarray, sketch: np.ndarray, similarity: float, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Moves members down the chosen paths of their nodes."""
    for _ in range(levels):
        draw = mix(node + np.uint64(0x1234567))
        twice = (draw >> np.uint64(40)).astype(float) / 2**24 < 1 / similarity - 1
        picks = draw % np.uint64(DRAWS)
        second = (picks + np.uint64(1) + (draw >> np.uint64(8)) % np.uint64(DRAWS - 1)) % np.uint64(DRAWS)
        node = np.concatenate([node, node[twice]])
        member = np.concatenate([member, member[twice]])
        pick = np.concatenate([picks, second[twice]]).astype(np.int64)
        node = mix(node * np.uint64(7) + np.uint64(256) * (pick.astype(np.uint64) + np.uint64(1)) + sketch[member, pick].astype(np.uint64))
    return node, member


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, DRAWS)


def _descend(members: DataFrame, similarity: float, levels: int) -> DataFrame:
    """(node, key) after so many more levels, from (node, key, sketch); a null node stands for the roots of all trees."""

    def walk(batches):
        for batch in batches:
            n = batch.num_rows
            sketch = _matrix(batch.column(2))
            if batch.column(0).null_count:
                member = np.tile(np.arange(n), TREES)
                node = mix(np.repeat(np.arange(TREES), n).astype(np.uint64))
            else:
                node, member = np.asarray(batch.column(0)).astype(np.uint64), np.arange(n)
            node, member = _walk(node, member, sketch, similarity, levels)
            for at in range(0, len(node), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[at : at + 100_000].astype(np.int64)), batch.column(1).take(pa.array(member[at : at + 100_000]))], names=["node", "key"])

    return members.select("node", "key", "sketch").mapInArrow(walk, "node long, key long")


def _with_sketch(rows: DataFrame, sketched: DataFrame, *more: str) -> DataFrame:
    """node, key, sketch and ``more`` of rows (node, key, ...). A class stands in some dozens of nodes, which the trees bound;
    they are listed first, so it meets its sketch once and not once a node."""
    at = F.struct("node", *more)
    return rows.groupBy("key").agg(F.collect_list(at).alias("at")).join(sketched, "key").select("key", "sketch", F.inline("at"))


def _likely_in_small(members: DataFrame) -> DataFrame:
    """Spanning forests (a, b) of nodes, from (node, key, sketch). Nodes hold SMALL rows at most."""

    def compare(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            node = np.asarray(table.column(0))
            cuts = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
            whole = int(cuts[-1]) if len(cuts) else 0  # the last node may go on in the next batch
            rest = table.slice(whole)
            yield from forests(table.slice(0, whole), cuts)
        if rest is not None and rest.num_rows:
            yield from forests(rest, np.zeros(1, np.int64))

    def forests(table, cuts):
        n = table.num_rows
        if not n:
            return
        keys, sketch = np.asarray(table.column(1)), _matrix(table.column(2))
        edges = [*[c for c in cuts.tolist() if c < n], n]
        a, b = [], []
        for low, high in zip(edges, edges[1:]):
            if high - low == 2:
                if (sketch[low] == sketch[low + 1]).mean() >= LIKELY:
                    a.append(low)
                    b.append(low + 1)
            elif high - low > 2:
                for i, j in likely_forest(sketch[low:high]):
                    a.append(low + i)
                    b.append(low + j)
        yield pa.RecordBatch.from_arrays([pa.array(keys[a]), pa.array(keys[b])], names=["a", "b"])

    dealt = members.select("node", "key", "sketch").repartition("node").sortWithinPartitions("node", "key")
    return dealt.mapInArrow(compare, "a long, b long")


def likely_links(classes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """Likely links (a, b) between classes (key, sketch), and the members (node, key) of nodes that stayed large.

    Large nodes branch on until they are small or all their members agree with the first one, for DEEPER levels.
    """
    links, at = [], classes.select(F.lit(None).cast("long").alias("node"), "key", "sketch")
    sketched = classes.select("key", "sketch")
    for step in range(1 + DEEPER):
        paths = stored(_descend(at, similarity, 1 if step else DEPTH), "paths")
        sizes = stored(paths.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).where("n > 1"), "sizes")
        many = sizes.where(F.col("n") > SMALL)
        few = paths.join(many.select("node"), "node", "left_anti").join(sizes.where(F.col("n") <= SMALL).select("node"), "node")
        links.append(stored(contracted(stored(_likely_in_small(_with_sketch(few, sketched)), "forests")), "links"))
        if many.isEmpty():
            return _all(links), None
        # a large node's first member meets the others, which are dealt out by a part of their key
        parts = many.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        star = paths.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")).join(parts, ["node", "part"]).where("key != least")
        star = _with_sketch(star, sketched, "least").join(sketched.select(F.col("key").alias("least"), F.col("sketch").alias("other")), "least")
        star = stored(star.select("node", "key", "least", _agree("sketch", "other").alias("near")), "stars")
        links.append(stored(contracted(star.where("near").select(F.col("least").alias("a"), F.col("key").alias("b"))), "links"))
        apart = star.where("NOT near").select("node").distinct()
        left = star.join(apart, "node", "left_semi")
        left = left.select("node", "key").unionByName(left.select("node", F.col("least").alias("key")).distinct())
        at = stored(_with_sketch(left, sketched).select("node", "key", "sketch"), "members")
        if at.isEmpty():
            return _all(links), None
    return _all(links), at.select("node", "key")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _block_tasks(members: DataFrame) -> DataFrame:
    """(node, key), in which node names a task; any two members of a node (node, key, root) with different roots meet in one.

    Members of a node's largest cluster are linked with each other by now, so they meet the others only. Both are cut into
    blocks of about SMALL / 2, so rows grow with the members outside the largest cluster and not with the square of the node.
    """
    clusters = members.groupBy("node", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = clusters.groupBy("node").agg(F.max(F.struct("n", "root")).alias("major"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / (SMALL // 2)).cast("int")
    cut = largest.select("node", F.col("major.root").alias("major"), blocks(F.col("major.n")).alias("inside"), blocks(F.col("n") - F.col("major.n")).alias("outside"))
    of = lambda n: F.pmod(F.xxhash64("key"), F.greatest(F.col(n), F.lit(1))).cast("int")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    met = F.transform(upto("outside"), lambda i: at("inside", i, of("inside")))
    among = F.transform(upto("outside"), lambda j: at("outside", F.least(of("outside"), j), F.greatest(of("outside"), j)))
    across = F.transform(upto("inside"), lambda j: at("inside", of("outside"), j))
    tasks = F.when(F.col("root") == F.col("major"), met).otherwise(F.concat(among, across))
    placed = members.join(cut, "node").select("node", "key", F.explode(tasks).alias("at"))
    return placed.select(F.xxhash64("node", "at").alias("node"), "key")


def _likely_in_blocks(members: DataFrame, sketched: DataFrame) -> DataFrame:
    """As _likely_in_small, for nodes (node, key, root) of any size: between blocks, but not inside of known clusters."""
    return _likely_in_small(_with_sketch(_block_tasks(members), sketched))


def likely_clusters(classes: DataFrame, similarity: float) -> DataFrame:
    """(key, root) of the classes (key, sketch) that have likely links.

    Forests of the trees are contracted where they stand before they are joined, so a class has a few links, however many
    copies its group and however many trees there are. Nodes that stayed large and whose members are not in one cluster
    by then are compared exhaustively, in blocks, but for the pairs inside their largest cluster.
    """
    links, rest = likely_links(classes, similarity)
    links = stored(contracted(links), "links")
    clusters = components(links)
    if rest is None:
        return clusters
    named = rest.join(clusters, "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = named.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("node")
    found = stored(_likely_in_blocks(stored(named.join(mixed, "node").select("node", "key", "root"), "rest"), classes.select("key", "sketch")), "links")
    return clusters if found.isEmpty() else components(stored(contracted(links.unionByName(found)), "links"))


def _agree(a: str, b: str):
    """At least LIKELY of the bytes of two sketches are equal."""
    left, right = F.hex(a), F.hex(b)
    same = F.aggregate(F.sequence(F.lit(0), F.lit(DRAWS - 1)), F.lit(0), lambda n, i: n + (F.substr(left, 2 * i + 1, F.lit(2)) == F.substr(right, 2 * i + 1, F.lit(2))).cast("int"))
    return same >= int(np.ceil(LIKELY * DRAWS))


def components(links: DataFrame) -> DataFrame:
    """(key, root): the smallest key of the component of each linked key. links: (a, b)."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stored(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("key").alias("b"), "root"), "b").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("seen"))
        nearer = labels.join(seen, "key").select("key", "root", F.least("root", "seen").alias("next"))
        jump = labels.select(F.col("key").alias("next"), F.col("root").alias("beyond"))
        moved = stored(nearer.join(jump, "next", "left").select("key", F.col("root").alias("old"), F.least("next", F.coalesce("beyond", "next")).alias("root")), "labels")
        labels = moved.select("key", "root")
        if moved.where("old != root").isEmpty():
            return labels


def _confirm(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) from (task, key, text): a star for each component of a task."""

    def check(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys = np.asarray(table.column("key"))
        raw, offsets = text_views(table.column("text"))
        hashes, bounds, base = [], [np.zeros(1, np.int64)], 0
        for a, b in slices_by_bytes(offsets, SLICE_BYTES):
            found, cuts = shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
            hashes.append(found)
            bounds.append(cuts[1:] + base)
            base += len(found)
        root = confirmed_forest(np.concatenate(hashes), np.concatenate(bounds), percent)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(keys[root[linked]]), "b": pa.array(keys[linked])})

    return texts.groupBy("task").applyInArrow(check, "a long, b long")


def _linked(docs: DataFrame, doc_id: str, text: str, size: int, percent: int) -> DataFrame:
    """row, digest, n_shingles, key, least (smallest id of the class), root (null for a class without links) and
    component (smallest id of the root's classes) of every row."""
    rows = stored(_sets(docs, doc_id, text, size), "sets")
    place = F.struct(F.col("row").isNull().alias("none"), F.coalesce("row", F.lit(0)).alias("row"), "digest")
    found = rows.where("key is not null").groupBy("key")
    found = found.agg(F.min("row").alias("least"), F.max(F.struct("n_shingles", "sketch")).alias("set"), F.min(place).alias("place"))
    classes = stored(found.select("key", "least", "set.*", "place"), "classes")
    clusters = likely_clusters(classes, percent / 100)
    sized = clusters.join(classes.select("key", "n_shingles"), "key")
    sizes = sized.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    clusters = stored(clusters.join(sizes, "root"), "clusters")
    own = F.pmod(F.xxhash64("key"), "blocks").cast("int")
    pair = lambda other: F.struct(F.least(own, other).alias("i"), F.greatest(own, other).alias("j"))
    tasks = clusters.select("root", "key", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("at"))
    tasks = tasks.select("key", F.struct("root", "at").alias("task"))
    # one text stands for each class
    chosen = classes.join(clusters.select("key"), "key").select("key", "place.*")
    texts = docs.select(*_identity(docs, doc_id, text), F.col(text).alias("text"))
    held = texts.join(chosen, ["none", "row", "digest"]).select("key", "text").dropDuplicates(["key"])
    links = stored(_confirm(held.join(tasks, "key").select("task", "key", "text"), size, percent), "links")
    joined = components(links)
    least = classes.join(joined, "key").groupBy("root").agg(F.min("least").alias("component"))
    of_class = classes.select("key", "least").join(joined.join(least, "root").select("key", "root", "component"), "key", "left")
    return rows.drop("sketch").join(of_class, "key", "left")


def _identity(docs: DataFrame, doc_id: str, text: str) -> list:
    """Columns that name a row: whether it has no id, the id or 0, and a digest of the text."""
    number = F.col(doc_id).cast("long")
    return [number.isNull().alias("none"), F.coalesce(number, F.lit(0)).alias("row"), F.xxhash64(text).alias("digest")]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs; texts are linked from a Jaccard similarity of
    `percent` on their sets of `size`-word shingles.

    component_id is the smallest doc_id reachable over links, kept says that it is the row's own. Texts without words,
    null ones too, are linked with nothing. Rows without doc_id take part in links but name no component: their
    component_id is null if no member has an id, and they are kept only then. Repeated rows are copies.
    """
    named = _linked(docs, doc_id, text, size, percent)
    component = F.coalesce("component", "least", "row")
    return named.select(F.col("row").alias(doc_id), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("row"), component.isNull()).alias("kept"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without near-duplicates: one document of each component stays, with all its columns.

    It is the one with the smallest id, rows without id coming last; of several texts with this id the one with the
    smallest digest. Texts without words are linked with nothing and stay. Rows that repeat both id and text (or have
    the same text and no id) are one document, of which one row stays.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    doc_id, text = f"c{columns.index(doc_id)}", f"c{columns.index(text)}"
    named = _linked(plain, doc_id, text, size, percent).withColumn("group", F.coalesce("root", "key"))
    place = F.struct(F.col("row").isNull().alias("none"), F.coalesce("row", F.lit(0)).alias("row"), "digest")
    named = stored(named.select("group", place.alias("place")), "linked")
    best = named.where("group is not null").groupBy("group").agg(F.min("place").alias("place")).select("place")
    alone = named.where("group is null").select("place")
    chosen = best.unionByName(alone).distinct().select("place.*")
    marked = plain.select("*", *_identity(plain, doc_id, text)).join(chosen, ["none", "row", "digest"], "left_semi")
    return marked.dropDuplicates(["none", "row", "digest"]).select(*plain.columns).toDF(*columns)
