"""Substring and suffix-array dedup against brute force."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tableseek.llm import substring_dedup, suffix_array
from tableseek.llm.repeats import Windows, cuts

SMALL = {"chunk_bytes": 2000, "bucket_bytes": 1500, "part_bytes": 300, "hot": 6}


def corpus(seed=1, n=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(40)]
    passages = [" ".join(draw.choices(vocabulary, k=20)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(draw.choices(vocabulary, k=draw.randint(0, 30))) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(1, passages[0])  # a third of all rows share it
        if i % 5 == 0:
            parts.append(passages[draw.randint(1, 3)].replace(" ", "\n"))
        rows.append((i, draw.choice([" ", "  ", "\t"]).join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (None, rows[0][1]), (None, None), (5, rows[5][1]), (3, rows[9][1])]
    rows += [(n + 3, "a " * 90), (n + 4, "b" * 200), (n + 5, passages[0]), (n + 6, passages[0]), (n + 7, "x y"), (n + 8, "x y")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(corpus(), "doc_id long, text string")
    return frame.withColumn("n_removed", F.lit("clash")).withColumn("kept", F.lit(1)).repartition(3)


def result(df, columns):
    return sorted(df.select("doc_id", *columns).collect(), key=str)


def test_passages(docs):
    found = substring_dedup.remove_repeated_passages(docs, ["doc_id", "kept"], window=12, gram=5, **SMALL)
    got = result(found, ["n_words", "n_removed", F.sha2("kept", 256)])
    rows = corpus()
    want = sorted([(d, *x) for (d, _), x in zip(rows, brute.passages([t for _, t in rows], 12))], key=lambda r: str(type(got[0])(*r)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bytes(docs):
    found = suffix_array.remove_repeated_bytes(docs, ["doc_id", "n_removed"], window=50, gram=20, **SMALL)
    got = result(found, ["n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)])
    rows = corpus()
    want = [(d, *x) for (d, _), x in zip(rows, brute.repeated_bytes(rows, 50))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_default_sizes_agree(docs):
    small = result(suffix_array.remove_repeated_bytes(docs, ["doc_id"], **SMALL), ["n_removed", "n_spans"])
    assert small == result(suffix_array.remove_repeated_bytes(docs, ["doc_id"]), ["n_removed", "n_spans"])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.remove_repeated_passages(empty, ["doc_id"]).count() == 0
    assert suffix_array.remove_repeated_bytes(empty, ["doc_id"]).count() == 0


@pytest.mark.parametrize("text", [b"banana", b"mississippi", b"aaaaaaab", b"abcabcabcabd", bytes(range(255, -1, -1)), b"\x00\x00a\x00"])
def test_suffix_array_is_sorted(text):
    array = suffix_array.suffix_array(np.frombuffer(text, np.uint8), 64)
    assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_only_small_suffixes_are_sorted_directly():
    small = suffix_array.smaller_than_successor(np.frombuffer(b"banana", np.uint8))
    assert small.tolist() == [False, True, False, True, False, False]


def test_windows_share_names_wherever_they_stand():
    import pyarrow as pa

    of = Windows(12, 5, True)
    passage = " ".join(f"p{i}" for i in range(12))
    parts = cuts(pa.array([f"x y {passage} z", f"{passage}", f"q {passage} r s t"]), of)
    names = [set(parts[0].run_name[(parts[0].run_start <= at) & (parts[0].run_end >= at)].tolist()) for at in (2, 15, 28)]
    assert names[0] == names[1] == names[2] != set()
