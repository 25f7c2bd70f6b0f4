"""The whole pipeline, stage by stage against brute force on the smallest table."""

import brute
import corpus_pipeline as pipeline
import numpy as np
import public_tokenizers
import tiktoken

from tableseek.llm import bpe, decontaminate

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for number, (name, stage) in enumerate(pipeline.STAGES):
        made = stage(spark, docs, SF)
        made.write.parquet(path := str(tmp_path / str(number)))
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.read.parquet(path)
        after = {r.doc_id: r for r in docs.collect()}
        if number < 4:
            assert docs.columns == pipeline.COLUMNS
        if number != 3 and number != 4:
            assert all(before[i] == after[i] for i in after)
        if number == 0:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            right = [(i in after) == bool(q) for i, q in labels.items() if i in before]
            assert np.mean(right) > 0.9
        if number == 1:
            rows = [(i, r.text) for i, r in before.items()]
            assert set(after) == {x for _, x in brute.near(rows, 5)}
        if number == 2:
            items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            exact = {i for i, r in before.items() if any(x in decontaminate.normal(r.text) for x in items)}
            assert not exact & set(after) and len(before) - len(after) <= len(exact) + 2
        if number == 3:
            assert set(before) == set(after) and all(after[i].n_chars == len(after[i].text) for i in after)
            assert not any("@mail" in r.text for r in after.values())
        if number == 4:
            ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            assert set(before) == set(after) and all(r.decoded_ok for r in after.values())
            assert all(np.frombuffer(r.ids, "<u4").tolist() == known.encode_ordinary(before[i].text) for i, r in after.items())


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "some words here", "en", "s", 15), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x" * 50_000, "en", "s", 50_000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, ids string, `row` int")
    for stage in (s for _, s in pipeline.STAGES):
        assert stage(spark, docs, SF).count() <= len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_ok"] and 0 < out.count() < 200
