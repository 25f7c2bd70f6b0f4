"""Ranked lexical search against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tableseek.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, items, k):
    counts = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    length, df = sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        weight = {t: math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df[t] + 1))) for t in terms}
        found = []
        for d, c in counts:
            m = 100 - 50 + 50 * c.total() * len(counts) // length
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        found.sort()
        out += [(item, rank, d, -score) for rank, (score, _, _, d) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n=300):
    draw = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(80)] + ["ÄB", "naïve", "x_y", "1,000", "ŒUVRE"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i * 7 % 1013, " ".join(draw.choices(vocabulary, weights, k=draw.randint(1, 60)))) for i in range(n)]
    docs += [(5000 + i, docs[3][1]) for i in range(30)] + [(None, docs[3][1]), (None, docs[4][1]), (9000, docs[3][1]), (9000, docs[3][1])]
    docs += [(9100, None), (9101, ""), (9102, " .,-"), (9103, "T1 t1 T1"), (9104, "t2\x00t3")]
    items = [(i, draw.choice(docs[:n])[1]) for i in range(12)] + [(50, "t0"), (51, None), (52, ""), (53, "none of these"), (None, "T3 t4"), (54, "Äb äb")]
    return docs, items


def run(spark, docs, items, k):
    left = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, item_id int, terms string").repartition(3)
    right = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, block int").repartition(2)
    return sorted(map(tuple, lexical.ranked_search(left, right, k).collect()), key=str)


@pytest.mark.parametrize("seed, k, tree, leaf, block", [(1, 5, 1024, 32, 100_000), (2, 40, 37, 4, 30), (3, 1, 8, 1, 100_000)])
def test_equals_brute_force(spark, monkeypatch, seed, k, tree, leaf, block):
    for name, value in (("TREE", tree), ("LEAF", leaf), ("BLOCK_TERMS", block)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus(seed)
    assert run(spark, docs, items, k) == brute(docs, items, k)


def test_bounds_hold_and_prune():
    draw = np.random.default_rng(1)
    groups = draw.integers(0, 20, 800)
    x = np.where(draw.random((800, 200)) < 0.05, draw.integers(0, 10**8, (800, 200)), 0)
    for g in range(20):
        x[groups == g, 10 * g : 10 * g + 10] += draw.integers(10**10, 2 * 10**10, 10)
    tree, scored = lexical.Tree(x, np.arange(800)), 0
    for g in range(20):
        dims = np.arange(10 * g, 10 * g + 10)
        bounds = tree.bounds(dims)
        for (low, high), bound in zip(tree.spans, bounds):
            assert bound >= tree.x[low:high, dims].sum(1).max()
        best = lexical.Best(5)
        scored += tree.search(dims, best)
        want = np.lexsort((np.arange(800), -x[:, dims].sum(1)))[:5]
        assert best.ids.tolist() == want.tolist()
    assert scored < 0.4 * 20 * tree.children.count(None)


def test_given_table(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 50)
    assert sorted(map(tuple, lexical.ranked_search(docs, items).collect()), key=str) == want


def test_long_texts_and_empty_tables(spark):
    docs = [(1, "a " * 500_000), (2, "b" * 1_000_000), (3, "a b " + " ".join(f"z{i}" for i in range(100_000)))]
    items = [(1, "a b"), (2, " ".join(f"Z{i}" for i in range(100_000)))]
    assert run(spark, docs, items, 3) == brute(docs, items, 3)
    assert run(spark, [], items[:1], 3) == [] and run(spark, docs[:1], [], 3) == []
