"""Pigeonhole matching against the plain edit-distance recurrence."""

import random
from functools import lru_cache

from tableseek.llm import decontaminate as d


@lru_cache(None)
def distance_inside(item, text):
    """Least edit distance of item to any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a != b))
    return min(row)


def edited(draw, text, n):
    out = list(text)
    for _ in range(n):
        i = draw.randrange(len(out) or 1)
        kind = draw.choice("idr") if out else "i"
        if kind == "i":
            out.insert(i, draw.choice("abc xyz"))
        elif kind == "d":
            del out[i]
        else:
            out[i] = draw.choice("abc xyz")
    return "".join(out)


def test_myers_equals_the_recurrence():
    draw = random.Random(1)
    for _ in range(300):
        item = "".join(draw.choices("abc ", k=draw.randint(1, 90)))
        text = edited(draw, item, draw.randint(0, 8)) if draw.random() < 0.7 else "".join(draw.choices("abc ", k=60))
        text = "".join(draw.choices("abc ", k=draw.randint(0, 10))) + text
        want, budget = distance_inside(item, text), draw.randint(0, 8)
        got = d.myers(item, text, budget)
        assert (got and got[0]) == (want if want <= budget else None)


def data():
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(2, 7))) for _ in range(200)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(12, 40)))) for i in range(15)] + [(90, None), (91, ""), (92, "too short"), (3, " ".join(draw.choices(words, k=20)))]
    docs = []
    for i in range(80):
        text = " ".join(draw.choices(words, k=60))
        if i % 2:
            item = items[draw.randrange(15)][1]
            spoilt = edited(draw, item, draw.randint(0, int(len(item) * 0.08)))
            text = f"{text[:100]} {spoilt.upper() if i % 3 else spoilt.replace(' ', ', ')} {text[100:]}"
        docs.append((i, text))
    return docs + [(100, None), (101, ""), (None, items[0][1]), (7, items[1][1]), (102, items[2][1] * 3)], items


def want_pairs(docs, items):
    out = []
    for doc_id, text in docs:
        for item_id, item in items:
            a, b = d.normal(item), d.normal(text)
            if len(a) >= d.MIN_CHARS and b:
                n = distance_inside(a, b)
                if n <= int(len(a) * d.RATE):
                    out.append((doc_id, item_id, n))
    return sorted(map(str, out))


def test_pairs_and_drops(spark):
    docs, items = data()
    want = want_pairs(docs, items)
    assert 20 < len(want)
    left = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, hits string")
    right = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    for block in (d.BLOCK_CHARS, 300):  # one block or many
        got = d.find_contamination(left, right, ["doc_id"], block_chars=block).collect()
        assert sorted(str(tuple(r)) for r in got) == want
        kept = d.drop_contaminated(left, right, block_chars=block)
        assert kept.columns == left.columns
        bad = {w.split(",")[0][1:] for w in want}
        rest = sorted(str(r.doc_id) for r in kept.collect())
        assert rest == sorted(str(i) for i, t in docs if not (want_pairs([(i, t)], items)))
        assert len(rest) + sum(str(i) in bad and bool(want_pairs([(i, t)], items)) for i, t in docs) == len(docs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_contamination(docs, none, ["doc_id"]).count() == 0
    assert d.drop_contaminated(docs, none).count() == 1
    assert d.find_contamination(docs.limit(0), none, ["doc_id"]).columns == ["doc_id", "item_id", "distance"]
