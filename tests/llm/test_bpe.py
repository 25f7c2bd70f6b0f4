"""Encoding and decoding against the tiktoken library."""

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tableseek.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [
    None, "", " ", "  ", "\n", "a", "Hello world", " hello  world \n\n x", "it's we'll I'M'd 'sing ''s", "1234 567,890", "x" * 3000,
    "日本語 テスト ñandú é", "tab\tand nbsp   em", "trailing ", "a \n b", "'s't", "aaaa aaaaa aaaaaa", "<|endoftext|>", "\x00\x01 \x1c x", "🙂🙂 👩‍👩‍👧",
]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_documents(spark, reference):
    draw = random.Random(3)
    texts = TEXTS + ["".join(draw.choices("abc th e'\n 12é", k=draw.randint(1, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = reference.encode_ordinary(text or "")
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids, text
        assert got[i].n_tokens == len(ids)
        assert bytes(got[i].decoded) == (text or "").encode()


def test_forgetting_words_changes_nothing(reference, spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 50} other{i % 7} " * 3) for i in range(200)], "doc_id long, text string").coalesce(1)
    want = sorted(map(str, bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect()))
    monkeypatch.setattr(bpe, "SLICE_BYTES", 500)
    assert sorted(map(str, bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN).collect())) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(empty, PATH, public_tokenizers.PATTERN).count() == 0
