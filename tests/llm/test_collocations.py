"""Phrase collocations against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tableseek.llm import collocations


def brute(docs, least, top, length=5):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(lower)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, length + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        inside = {}
        for p, a in counts.items():
            if a >= least and len(p) > 2:
                for k in range(2, len(p)):
                    for i in range(len(p) - k + 1):
                        q = p[i : i + k]
                        inside[q] = max(inside.get(q, 0), a)
        found = []
        for p, a in counts.items():
            if len(p) > 1 and a >= least and 100 * inside.get(p, 0) < 100 * a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, b" ".join(p), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, docs=400):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "x", "x"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    phrases = [" ".join(draw.choices(vocabulary, k=draw.randint(2, 7))) for _ in range(15)]
    out = []
    for _ in range(docs):
        parts = []
        for _ in range(draw.randint(0, 12)):
            parts.append(draw.choice(phrases) if draw.random() < 0.3 else " ".join(draw.choices(vocabulary, weights, k=draw.randint(1, 8))))
            parts.append(draw.choice([" ", "\t ", ". ", ",", "\n", " "]))
        text = "".join(parts)
        out.append((text.upper() if draw.random() < 0.2 else text, draw.choice(["en", "en", "en", "de", None, "und"])))
    return out + [(None, "en"), ("", "fr"), (" .,\n", None), ("one two", "it")]


def run(spark, docs, **options):
    table = spark.createDataFrame([(*d, 1, "c") for d in docs], "text string, lang string, a int, phrase string").repartition(3)
    return sorted(map(tuple, collocations.collocations(table, **options).collect()))


@pytest.mark.parametrize("seed, first, top", [(1, 3, 10), (2, 1, 40), (3, 1000, 2000)])
def test_equals_brute_force(spark, seed, first, top):
    docs = corpus(seed)
    assert run(spark, docs, least=5, top=top, first=first) == brute(docs, 5, top)


def test_small_bit_maps_only_add_work(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITS", 1 << 4)
    monkeypatch.setattr(collocations, "BLOCK", 1 << 3)
    monkeypatch.setattr(collocations, "SLICE_BYTES", 300)
    docs = corpus(4)
    assert run(spark, docs, least=5, top=15, first=4) == brute(docs, 5, 15)


def test_repeated_words_and_long_texts(spark):
    docs = [("x x x y " * 30_000, "en"), ("ab" * 500_000, "en"), ("q r. " * 150, None)] + [("x y z", "en")] * 120
    assert run(spark, docs) == brute(docs, 100, 2000)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [("a b", "en")]) == []
