"""Mixing to target weights: targets, sums and choices against plain Python."""

import itertools
import random
import re

import pytest

from tableseek.llm import mixing


def targets(sizes, weights=(1, 2, 3), most=3):
    """Target of each source by sharing and resharing in turn; sizes: {name or None: size}."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, excess, held = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set()
    while excess > 1e-9:
        able = [s for s in order if s not in held]
        share = sum(weight[s] for s in able)
        for s in able:
            got[s] += excess * weight[s] / share
        above = [s for s in able if got[s] > most * sizes[s]]
        excess = sum(got[s] - most * sizes[s] for s in above)
        for s in above:
            got[s] = most * float(sizes[s])
        held.update(above)
    return got


def check(rows, found):
    """rows: (doc_id, text, source); found: the plan's rows. Ids do not repeat."""
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in rows}
    held = {}
    for d, _, s in rows:
        held[s] = held.get(s, 0) + size[d]
    want, source = targets(held), {d: s for d, _, s in rows}
    assert sorted(r.doc_id for r in found) == sorted(size)
    taken = dict.fromkeys(held, 0)
    for r in found:
        assert r["size"] == size[r.doc_id] and r.source_size == held[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
        taken[source[r.doc_id]] += r.taken
    return taken, want


@pytest.mark.parametrize("seed", range(30))
def test_fill_is_the_best_subset(seed):
    draw = random.Random(seed)
    sizes = draw.sample(range(1, 30), 5)
    counts = [draw.randint(0, 3) for _ in sizes]
    budget = draw.randint(0, sum(s * n for s, n in zip(sizes, counts)) + 3)
    sums = [sum(s * k for s, k in zip(sizes, ks)) for ks in itertools.product(*(range(n + 1) for n in counts))]
    got = mixing.fill(budget, sizes, counts)
    assert all(0 <= k <= n for k, n in zip(got, counts))
    assert sum(s * k for s, k in zip(sizes, got)) == max(x for x in sums if x <= budget)


def test_wide_gaps_are_narrowed_first(monkeypatch):
    monkeypatch.setattr(mixing, "CAPACITY", 50)
    got = mixing.fill(10_000, [700, 30, 7, 1], [9, 400, 9, 20])
    assert sum(s * k for s, k in zip([700, 30, 7, 1], got)) == 10_000


@pytest.mark.parametrize("seed", range(20))
def test_shares_meet_the_budget(seed):
    draw = random.Random(seed)
    sizes = sorted(draw.sample(range(0, 400), 40))
    counts = [draw.choice([1, 2, 50, 3000]) for _ in sizes]
    total = sum(s * n for s, n in zip(sizes, counts))
    target = draw.uniform(0, 3) * total
    full, more = mixing.shares(sizes, counts, target)
    assert all(0 <= m <= n for m, n in zip(more, counts))
    assert abs(full * total + sum(s * m for s, m in zip(sizes, more)) - target) <= max(1, min(s for s in sizes if s))


def test_hot_source_with_small_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT", 4)
    draw = random.Random(4)
    rows = [(i, " ".join(["w"] * draw.choice([0, 3, 3, 3, 17, draw.randint(1, 60)])), draw.choice(["b", "b", "b", "a", "ä", "Z", None, "c"])) for i in range(900)]
    rows += [(1000, None, "a"), (1001, "", None), (1002, "x", "tiny"), (1003, None, "empty"), (1004, "y " * 40_000, "long")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, number int").repartition(5)
    first = mixing.plan_mixture(docs).collect()
    taken, want = check(rows, first)
    for s in want:
        if s not in ("tiny", "long"):
            assert abs(taken[s] - want[s]) <= 1, s
    again = mixing.plan_mixture(docs.repartition(2)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    mixed = mixing.mix_documents(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {r.doc_id: r.copies for r in first if r.taken}


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    taken, want = check(rows, mixing.plan_mixture(docs).collect())
    assert all(abs(taken[s] - want[s]) <= 0.002 * want[s] for s in want)


def test_repeats_ids_of_null_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b", "s")] * 3 + [(5, "c", "s")] * 2 + [(6, None, None)], "doc_id long, text string, source string")
    found = mixing.plan_mixture(docs).collect()
    assert len(found) == 6 and sum(r.taken for r in found) == 8
    assert mixing.plan_mixture(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.plan_mixture(docs.where("doc_id = 6")).collect()] == [0]
