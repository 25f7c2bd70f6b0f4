"""Candidate lists, ranks counted from lists."""

import random

import pytest
from pyspark.sql import functions as F

from tableseek.operators import candidates as K
from tableseek.operators import metrics as M


@pytest.fixture(scope="module")
def asked(spark):
    draw = random.Random(3)
    tables = spark.createDataFrame([(f"d{i % 7 % 5}", f"d{i % 7 % 5}#sep#t{i}") for i in range(90)], "db_id string, table_id string")
    queries = spark.createDataFrame([(q, f"d{q % 6}", q // 10) for q in range(60)], "query_id bigint, db_id string, chunk bigint")
    names = [r[0] for r in tables.select("table_id").collect()]
    gold = spark.createDataFrame([(q, t) for q in range(0, 60, 2) for t in draw.sample(names, 3)], "query_id bigint, table_id string")
    return queries, tables, gold


def test_lists_hold_the_plan(spark, asked):
    queries, tables, gold = asked
    lists = K.candidate_lists(queries, tables, gold, 4, piece=5)
    assert lists.agg(F.max(F.size("tables"))).first()[0] < 20
    listed = lists.select("query_id", "own", F.explode("tables").alias("table_id"))
    plan = K.candidate_plan(queries, tables, gold, 4)
    key = ["query_id", "own", "table_id"]
    assert sorted(map(tuple, listed.select(*key).collect())) == sorted(map(tuple, plan.select(*key).collect()))
    own = queries.join(tables, "db_id").count()
    assert plan.filter("own").count() == own and plan.filter("not own").groupBy("query_id").count().filter("count > 4").isEmpty()


def test_distractors_choose_inside_the_row(asked):
    """Pairs of queries and pool tables are neither ranked by a window nor shuffled."""
    queries, tables, _ = asked
    plan = K.chunk_distractors(queries, tables, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Window" in line and "query_id" in line]


@pytest.mark.parametrize("piece", [3, 1000])
def test_counts_of_lists_are_ranks(asked, piece):
    queries, tables, gold = asked
    score = lambda t: F.when(F.crc32(t) % 11 > 0, F.pmod(F.xxhash64(t, "query_id"), F.lit(5)) / F.lit(5.0))
    draw = lambda c: F.transform(c, lambda t: F.struct(score(t).alias("score"), t.alias("key")))
    lists = K.candidate_lists(queries, tables, gold, 4, piece=piece)
    got = M.listed_metrics(lists.select("query_id", draw("tables").alias("candidates"), draw("gold").alias("positives")))
    rows = K.candidate_plan(queries, tables, gold, 4).withColumn("score", score(F.col("table_id")))
    want = {r.query_id: (r.ap, r.rr, r.n_positive) for r in M.per_query_metrics(rows, "table_id").collect()}
    found = {r.query_id: (r.ap, r.rr, r.n_positive) for r in got.collect()}
    assert want and found.keys() == want.keys()
    for q, x in want.items():
        assert found[q] == pytest.approx(x)
