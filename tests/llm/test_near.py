"""Near-duplicates against brute force."""

import random

import brute
import numpy as np
import pytest

from tableseek.llm import near_dedup


def corpus(seed=2):
    draw = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(300)]
    rows = []
    for family in range(12):
        base = draw.choices(vocabulary, k=draw.randint(20, 120))
        for copy in range(draw.choice([1, 2, 3, 25])):
            words = list(base)
            for _ in range(draw.randint(0, 1 + len(words) // 14)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            text = " ".join(words)
            rows.append((len(rows) * 7 % 1009, text.upper() if copy % 5 == 1 else text))
    rows += [(2000 + i, t) for i, t in enumerate([None, "", " \n", "one", "ONE", "two words", "two  Words", rows[0][1], rows[3][1]])]
    return rows


def run(spark, rows, size):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string").repartition(4)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, size=size).collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_components(spark, size):
    rows = corpus()
    want = {d: (*x, x[1] == d) for (d, _), x in zip(rows, brute.near(rows, size))}
    assert run(spark, rows, size) == want


def test_small_blocks_and_nodes_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    rows = corpus()
    assert run(spark, rows, 2) == {d: (*x, x[1] == d) for (d, _), x in zip(rows, brute.near(rows, 2))}


def test_large_nodes_end_in_exact_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "DEEPER", 0)
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    rows = corpus(5)
    assert run(spark, rows, 2) == {d: (*x, x[1] == d) for (d, _), x in zip(rows, brute.near(rows, 2))}


def test_links_stay_few_in_a_large_group(spark):
    """A group of many near copies gives a few links for each class, whatever the number of trees."""
    draw = random.Random(3)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(500):
        words = list(base)
        for _ in range(8):
            words[draw.randrange(400)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = near_dedup._sets(docs, "doc_id", "text", 2).select("key", "sketch")
    links, _ = near_dedup.likely_links(near_dedup.stored(sets, "classes"), 0.8)
    assert near_dedup.contracted(links).count() < 500
    found = near_dedup.near_duplicates(docs, size=2).select("component_id").distinct().count()
    assert found == len({c for _, c in brute.near(rows, 2)})


def test_a_class_meets_its_sketch_once(spark):
    """However many nodes a class stands in, the join with the sketches makes one row for it."""
    rows = spark.range(40).selectExpr("id div 4 as key", "id as node", "id % 3 as least")
    sketched = spark.range(10).selectExpr("id as key", "encode(string(id), 'utf-8') as sketch")
    found = near_dedup._with_sketch(rows, sketched, "least")
    want = rows.join(sketched, "key").select("key", "sketch", "node", "least")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    node = found._jdf.queryExecution().optimizedPlan()
    while "Join" not in node.nodeName():
        node = node.children().apply(0)
    assert "collect_list" in node.children().apply(0).toString()


@pytest.mark.parametrize("size", [2, 5])
def test_given_table(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, size=size).collect()}
    assert got == {d: x for (d, _), x in zip(rows, brute.near(rows, size))}


def test_one_of_each_stays(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text), (2, text), (2, text), (2, text + " w30"), (None, text), (None, "other words than these six"), (None, "other words than these six"), (7, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, `row` int")
    kept = [tuple(r)[:2] for r in near_dedup.keep_one_of_each(docs).collect()]
    assert len([k for k in kept if k[0] == 2]) == 1 and (4, text) not in kept and (None, text) not in kept
    assert sorted(map(str, (k for k in kept if k[0] != 2))) == sorted(map(str, [(None, "other words than these six"), (7, None), (8, "")]))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep_one_of_each(empty).count() == 0


def test_links_at_the_threshold_meet_in_a_tree():
    """Sketches that agree in 80 of 100 places share a node of DEPTH levels in some tree nearly always."""
    draw = np.random.default_rng(0)
    pairs = 2000
    sketch = draw.integers(0, 256, (2 * pairs, near_dedup.DRAWS)).astype(np.uint8)
    differ = draw.random((pairs, near_dedup.DRAWS)) < 0.2
    sketch[1::2] = np.where(differ, sketch[1::2], sketch[::2])
    node = near_dedup.mix(np.repeat(np.arange(near_dedup.TREES), 2 * pairs).astype(np.uint64))
    node, member = near_dedup._walk(node, np.tile(np.arange(2 * pairs), near_dedup.TREES), sketch, 0.8, near_dedup.DEPTH)
    met = set()
    order = np.lexsort((member, node))
    for a, b in zip(order, order[1:]):
        if node[a] == node[b] and member[a] // 2 == member[b] // 2 and member[a] != member[b]:
            met.add(int(member[a]) // 2)
    assert len(met) >= 0.998 * pairs


def test_a_large_cluster_meets_the_others_only(spark):
    """Blocks hold every pair of different clusters; a node's largest cluster costs a row a member, not a row a block."""
    size = 6 * near_dedup.SMALL
    rows = [(1, k, 0) for k in range(size)] + [(1, size + k, size + k // 2) for k in range(20)] + [(2, k, k // 3) for k in range(300)]
    tasks = near_dedup._block_tasks(spark.createDataFrame(rows, "node long, key long, root long").repartition(4)).toPandas()
    held = tasks.groupby("node")["key"].agg(list)
    assert held.map(len).max() < 2 * near_dedup.SMALL
    met = {(min(a, b), max(a, b)) for keys in held if len(keys) for a in keys for b in keys}
    others = range(size, size + 20)
    assert all((k, o) in met for k in range(size) for o in others)
    assert all((a, b) in met for a in others for b in others if a < b)
    assert all((a, b) in met for a in range(300) for b in range(a, 300) if a // 3 != b // 3)
    assert len(tasks) < size + 20 * (1 + 6 * 2) + 300 * 4 + 100
