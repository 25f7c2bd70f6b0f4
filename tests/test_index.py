"""Commit log and stored lexical index."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tableseek.operators import lexical_index as I
from tableseek.operators.lineage import mentioned_tables
from tableseek.sources.commit_log import CommitConflict, CommitLog


def test_versions_appear_whole_and_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"))
    assert log.latest() is None
    first, dead = log.stage("rows"), log.stage("rows")
    spark.range(3).write.parquet(log.full(first))
    assert log.commit({"folders": [first]}, 0) == 1
    spark.range(50).write.parquet(log.full(dead))  # a writer that dies before its commit
    assert log.latest()["folders"] == [first] and log.load([first]).count() == 3
    other = CommitLog(spark, str(tmp_path / "t"))
    assert other.commit({"folders": [first], "by": "other"}, 1) == 2
    with pytest.raises(CommitConflict):
        log.commit({"folders": []}, 1)
    assert log.latest()["by"] == "other" and log.versions() == [1, 2]
    assert log.vacuum({first}) == [dead]
    assert log.load([first]).count() == 3
    assert json.loads((tmp_path / "t" / "_log" / f"{1:020d}.json").read_text())["version"] == 1


def corpus(n=400, seed=7):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(150)] + ["Ünï", "x"]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, " ".join(draw.choices(words, weights, k=draw.randint(0, 40)))) for i in range(n)] + [(n, ""), (n + 1, None)]


def brute(docs, queries, k):
    tokens = {d: [t for t in re.split(r"[^\w]+|_", (x or "").lower()) if t] for d, x in docs}
    df = Counter(t for ts in tokens.values() for t in set(ts))
    n, mean = len(docs), sum(map(len, tokens.values())) / len(docs)
    out = []
    for q, text in queries:
        scores = {}
        for t in [t for t in re.split(r"[^\w]+|_", (text or "").lower()) if t]:
            for d, ts in tokens.items():
                if tf := ts.count(t):
                    scores[d] = scores.get(d, 0) + math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf / (tf + 0.9 * (0.6 + 0.4 * len(ts) / mean))
        ranked = sorted((-round(s, 6), d) for d, s in scores.items())[:k]
        out += [(q, d, -s, r) for r, (s, d) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "id long, contents string")
    asked = [(i, rows[i * 7][1]) for i in range(12)] + [(90, "w0"), (91, "never seen"), (92, ""), (93, "w1 w1 w2")]
    return rows, docs, asked, spark.createDataFrame(asked, "query_id long, text string")


def test_search_equals_brute_force(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "RANGE", 8)
    rows, docs, asked, queries = tables
    index = I.build_index(docs, str(tmp_path / "index"))
    for k in (3, 1000):
        assert sorted(map(tuple, index.search(queries, k).select("query_id", "id", "score", "rank").collect())) == brute(rows, asked, k)
    with pytest.raises(ValueError):
        I.build_index(docs, str(tmp_path / "index"))


def test_blocks_out_of_reach_are_not_scored(spark, tmp_path, monkeypatch):
    """Once k documents are found, ranges whose blocks allow less are left out."""
    monkeypatch.setattr(I, "RANGE", 4)
    monkeypatch.setattr(I, "LEADING", 1)
    rows = [(i, "rare common" if i < 3 else "common " * 5 + " ".join(f"f{i}{j}" for j in range(60))) for i in range(400)]
    index = I.build_index(spark.createDataFrame(rows, "id long, contents string"), str(tmp_path / "index"))
    queries = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    assert [r.id for r in index.search(queries, 3).orderBy("rank").collect()] == [0, 1, 2]
    scans = [p for p in index.search(queries, 3)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Relation" in p]
    assert scans and not any("contents" in p for p in scans)


def test_appends_and_merges_answer_alike(spark, tables, tmp_path):
    rows, docs, asked, queries = tables
    index = I.LexicalIndex(spark, str(tmp_path / "index"))
    for part in range(3):
        index = index.append(docs.where(F.col("id") % 3 == part))
    assert len(index.segments) == 3
    want = brute(rows, asked, 10)
    found = lambda i: sorted(map(tuple, i.search(queries, 10).select("query_id", "id", "score", "rank").collect()))
    assert found(index) == want
    old = I.LexicalIndex(spark, str(tmp_path / "index"))
    assert found(index.merge()) == want and len(index.segments) == 1
    assert len(old.segments) == 3 and found(old) == want  # a reader of the version before goes on
    assert index.terms().where("term = 'w0'").first()["df"] == sum("w0" in (t or "").split() for _, t in rows)


def test_only_buckets_of_the_query_are_read(spark, tables, tmp_path):
    _, docs, _, _ = tables
    index = I.build_index(docs, str(tmp_path / "index"))
    plan = index.blocks().where(F.col("bucket").isin([3])).select("term", "n")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:60] and "list" not in plan.split("ReadSchema")[1][:60]


def test_passages_by_rare_terms(spark, tables, tmp_path):
    rows, docs, _, _ = tables
    index = I.build_index(docs, str(tmp_path / "index"))
    asked = [(1, " ".join(rows[3][1].split()[2:7])), (2, "w0"), (3, "w0 never"), (4, ""), (5, None), (6, rows[9][1])]
    passages = spark.createDataFrame(asked, "query_id long, text string")
    got = sorted(map(tuple, I.passages_by_index(index, docs, passages).collect()))
    spaced = lambda t: " " + " ".join((t or "").lower().split()) + " "
    assert got == sorted((q, d) for q, p in asked if p and p.strip() for d, t in rows if spaced(p) in spaced(t))


def test_long_literals_and_comments_in_statements(spark):
    statements = [(1, "d", f"select '{'x' * 1_000_000}''{'y' * 10}' from t1 /*{'*' * 100_000}*/ join t2"), (2, "d", "select '" + "''" * 300_000 + "' from t2")]
    catalog = spark.createDataFrame([("d", "t1"), ("d", "t2")], "db_id string, table_name string")
    queries = spark.createDataFrame(statements, "query_id long, db_id string, sql string")
    got = {(r.query_id, r.table_name) for r in mentioned_tables(queries, catalog).collect()}
    assert got == {(1, "t1"), (1, "t2"), (2, "t2")}


def test_postings_are_dealt_by_range_once(spark, tables, tmp_path):
    """Building moves texts once, and scores add up without another exchange of postings."""
    _, docs, _, queries = tables
    index = I.build_index(docs, str(tmp_path / "index"))
    plan = index.scores(queries)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(place") == 1 and "hashpartitioning(query_id" not in plan and "hashpartitioning(key" not in plan


def test_merge_deals_anew_where_ranges_are_far_from_full(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "RANGE", 200)
    rows, docs, asked, queries = tables
    index = I.LexicalIndex(spark, str(tmp_path / "index"))
    for part in range(8):
        index = index.append(docs.where(F.col("id") % 8 == part))
    assert sum(s["ranges"] for s in index.segments) == 8
    merged = index.merge()
    assert merged.segments[0]["ranges"] == 3
    assert sorted(map(tuple, merged.search(queries, 10).select("query_id", "id", "score", "rank").collect())) == brute(rows, asked, 10)


def test_merge_adds_up_the_dictionaries(spark, tables, tmp_path):
    """A dictionary is counted from blocks once a segment, with one shuffle; a merge adds up those it replaces."""
    _, docs, _, _ = tables
    index = I.LexicalIndex(spark, str(tmp_path / "index"))
    for part in range(2):
        index = index.append(docs.where(F.col("id") % 2 == part))
    counted, written = [], index._write
    index._write = lambda blocks, docs, ranges, others, terms=None: counted.append(terms) or written(blocks, docs, ranges, others, terms)
    merged = index.merge()
    assert "list" not in counted[0].columns and not any("/blocks" in f for f in counted[0].inputFiles())
    whole = I.build_index(docs, str(tmp_path / "whole"))
    assert sorted(map(tuple, merged.terms().collect())) == sorted(map(tuple, whole.terms().collect()))


def test_hybrid_lists_share_the_postings(spark):
    """Both lists are cut from one shuffle of the postings."""
    from tableseek.plans import QUERIES

    fused = QUERIES["hybrid_ranks"](spark, "/root/testdata/sf0.01")
    fused.collect()
    plan = fused._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    moved = [p for p in plan.split("\n") if "hashpartitioning(place" in p]
    assert len(moved) == 1 and "ReusedExchange" in plan
