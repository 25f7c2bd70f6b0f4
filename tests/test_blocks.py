"""Blocks of queries and tables against listed pairs."""

import numpy as np
from pyspark.sql import functions as F

from tableseek.operators import dense_index as D
from tableseek.operators import scoring as S
from tableseek.operators.ranking import top_k
from tableseek.plans import QUERIES


def vectors(spark):
    draw = np.random.default_rng(7)
    cells = [(f"t{i}", r, c, [float(x) for x in draw.normal(size=8)]) for i in range(30) for r in range(1 + i % 7) for c in range(1 + i % 3)]
    cells += [("t3copy", r, c, v) for t, r, c, v in cells if t == "t3"]
    asked = [(q, t, [float(x) for x in draw.normal(size=8)]) for q in range(25) for t in range(1 + q % 4)]
    return spark.createDataFrame(asked, "query_id long, tok_idx int, vec array<double>"), spark.createDataFrame(cells, "table_id string, row_idx int, col_idx int, vec array<double>")


def test_blocks_equal_listed_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "CELLS_PER_PIECE", 15)
    monkeypatch.setattr(S, "CELLS_PER_BLOCK", 60)
    monkeypatch.setattr(S, "TOKENS_PER_BLOCK", 20)
    monkeypatch.setattr(S, "TOKENS_AT_ONCE", 6)
    monkeypatch.setattr(S, "CELLS_AT_ONCE", 12)
    asked, cells = vectors(spark)
    keyed = cells.withColumn("key", F.concat_ws("-", "table_id", "row_idx", "col_idx"))
    for n_lists, probes in ((5, 1), (6, 2)):
        centroids = S.seeded_centroids(keyed, "key", n_lists).withColumn("centroid", F.abs(F.xxhash64("centroid")))
        scored = S.score_candidates(S.centroid_candidates(asked, cells, centroids, probes), asked, cells)
        want = top_k(scored.select("query_id", "table_id", F.round("global", 6).alias("score")), ["query_id"], [F.desc("score"), "table_id"], 4)
        got = S.best_of_lists(asked, cells, centroids, probes, 4).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_kmeans_search_lists_no_pairs(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("candidate pairs are listed")

    monkeypatch.setattr(S, "centroid_candidates", refuse)
    assert QUERIES["dense_search_kmeans"](spark, "/root/testdata/sf0.001").count() > 0


def test_probes_and_lists_meet_inside_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "VECTORS_PER_BLOCK", 40)
    monkeypatch.setattr(D, "PROBES_PER_BLOCK", 30)
    asked, cells = vectors(spark)
    keyed = cells.withColumn("vec_id", F.xxhash64("table_id", "row_idx", "col_idx"))
    index = D.DenseIndex(spark, str(tmp_path / "dense")).build(keyed, "vec_id")
    got = index.candidates(asked, 3, 4)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    probes = S.nearest_centroids(asked, index.centroids(), 3, similarity="_s")
    met = probes.join(index.lists().select("centroid", "table_id").distinct(), "centroid").groupBy("query_id", "table_id", "tok_idx").agg(F.max("_s").alias("_s"))
    want = top_k(met.groupBy("query_id", "table_id").agg(F.round(F.sum("_s"), 6).alias("score")), ["query_id"], [F.desc("score"), "table_id"], 4)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_first_best_keeps_the_order_of_ties():
    sims = np.round(np.random.default_rng(0).normal(size=(50, 9)), 0)
    assert (S._first_best(sims, 4) == np.argsort(-sims, axis=1, kind="stable")[:, :4]).all()
