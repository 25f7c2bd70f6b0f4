"""Classifier and rules."""

import numpy as np
from pyspark.sql import functions as F

from tableseek.llm import quality, quality_rules
from tableseek.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op3_quality_classifier"](spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert (got.predicted == (got.score >= 0.5)).all() and got.score.between(0, 1).all()
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert (got.predicted == got.quality).mean() > 0.95


def test_held_out_labels_are_never_read(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    measured = quality.statistics(docs, ["doc_id"])
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit_quality(measured, labels), quality.fit_quality(measured, turned)
    assert a.labelled == b.labelled and np.allclose(a.weights, b.weights) and np.allclose(a.chances, b.chances)
    crc = docs.select(quality.held_out().alias("h"), (F.crc32(F.col("doc_id").cast("string")) % 3).alias("m")).distinct().collect()
    assert sorted((r.m, r.h) for r in crc) == [(0, False), (1, True), (2, False)]


def test_isotonic():
    levels, chances = quality.pool_violators(np.arange(6.0), np.array([0, 2, 1, 0, 3, 4.0]), np.array([4, 4, 4, 0, 4, 4.0]))
    assert (np.diff(chances) > 0).all() and (np.diff(levels) > 0).all() and np.isclose(chances[1], 3 / 8)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "some words"), (1, "some words"), (1, "some words"), (5, "x" * 100_000), (6, "\n\n \t")]
    docs = spark.createDataFrame([(*r, 0.0, "clash") for r in rows], "doc_id long, text string, score double, statistics string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (5, None), (None, 1), (77, 1)], "doc_id long, quality int")
    model = quality.fit_quality(quality.statistics(docs, ["doc_id"]), labels)
    got = quality.score_documents(docs, model, ["doc_id", "text", "score"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = quality.fit_quality(quality.statistics(docs, ["doc_id"]), labels.limit(0))
    assert {r.score for r in quality.score_documents(docs, none, ["doc_id"]).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), model, ["doc_id"]).count() == 0


def test_statistics_do_not_depend_on_neighbours():
    import pyarrow as pa

    from tableseek.llm.arrays import text_views

    texts = ["One two\nOne two\n", "", "AB!! c### |", "ünï code 12", None, "the end."]
    together = quality.document_statistics(*text_views(pa.array(texts)))
    for text, row in zip(texts, together):
        assert np.allclose(quality.document_statistics(*text_views(pa.array([text], pa.string())))[0], row)


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 5, 0.1), (3, 40, 0.1), (19, 25, 0.3), (2, 700, 0.004), (25, 25, 0.5)]
    for x, n, p in cases:
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(x).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        assert np.isclose(got, sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1)), rtol=1e-9)


def test_cutoffs_keep_their_promise(spark):
    """Good documents with 1 % of odd ones: no cutoff may turn away more than the risk allows, a loose one passes."""
    rows = [(i, "de", " ".join(f"w{j}" for j in range(60)) + (" x" + "#" * 40 if i % 100 == 0 else "")) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    out = quality_rules.apply_quality_rules(docs, labels, ["doc_id"], risk=0.02)
    assert out.where("not kept and not base_failed").count() == 0
    generous = quality_rules.apply_quality_rules(docs, labels, ["doc_id"], risk=0.2)
    assert generous.where("not kept and not base_failed").count() == 60


def test_rules_on_odd_rows(spark):
    rows = [(1, None, None), (2, "", "en"), (None, "a b c d e " * 5, "xx"), (4, "l\nl\nl \n", None), (4, "l\nl\nl \n", None)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, kept string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = sorted(map(tuple, quality_rules.apply_quality_rules(docs, labels, ["doc_id"]).collect()), key=str)
    assert got == sorted([(1, 0, 0, 0, 0, 0, True, False), (2, 0, 0, 0, 0, 0, True, False), (None, 25, 25, 0, 0, 25, True, False), (4, 3, 3, 0, 1, 0, True, False), (4, 3, 3, 0, 1, 0, True, False)], key=str)
    assert quality_rules.apply_quality_rules(docs.limit(0), labels, ["doc_id"]).count() == 0
