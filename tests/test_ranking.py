"""Skew-safe ranks equal plain windows, also when one group holds most rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tableseek.functions.hashing import hash_key
from tableseek.operators import metrics, ranking


@pytest.fixture(scope="module")
def skewed(spark):
    """2,000 rows; group 0 holds two thirds of them and one value holds half of those."""
    return spark.range(2000).select(
        F.col("id"),
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7).alias("g"),
        F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 101).cast("bigint").alias("v"),
    )


def test_hash_ordinal_equals_window(skewed, collect_rows):
    expected = skewed.withColumn("_h", hash_key("id")).withColumn(
        "pos", F.row_number().over(Window.partitionBy("g").orderBy("_h", "id")) - 1
    )
    got = ranking.hash_ordinal(skewed, ["g"], ["id"])
    assert collect_rows(got, "g", "id", "pos") == collect_rows(expected, "g", "id", "pos")


def test_range_ordinal_equals_window(skewed, collect_rows):
    expected = skewed.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")) - 1)
    got = ranking.range_ordinal(skewed, ["g"], "v", ["id"], buckets=16)
    assert collect_rows(got, "g", "id", "pos") == collect_rows(expected, "g", "id", "pos")


def test_prefix_sum_equals_window(skewed, collect_rows):
    before = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    expected = skewed.withColumn("before", F.coalesce(F.sum("v").over(before), F.lit(0)))
    got = ranking.prefix_sum(skewed, ["g"], ["id"], "v", F.floor(F.col("id") / 300))
    assert collect_rows(got, "id", "before") == collect_rows(expected, "id", "before")


@pytest.mark.parametrize("k", [3, 1500])
def test_top_k_keeps_all_of_the_first_k(skewed, collect_rows, k):
    expected = skewed.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))).filter(f"rank <= {k}")
    got = ranking.top_k(skewed, ["g"], ["v", "id"], k)
    assert collect_rows(got, "g", "id", "rank") == collect_rows(expected, "g", "id", "rank")


def test_large_k_takes_rows_with_maps(skewed):
    mapped = skewed.withColumn("m", F.create_map(F.lit("k"), F.col("v")))
    assert ranking.top_k(mapped, ["g"], ["v", "id"], 1001).count() == 1001 + skewed.filter("g <> 0").count()


def test_top_k_limits_before_the_shuffle(skewed):
    plan = ranking.top_k(skewed, ["g"], ["v", "id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 3  # one of them ahead of the first exchange


def test_global_ids_are_dense_and_ordered(spark, skewed):
    got = ranking.global_ids(skewed.repartition(7), ["v", "id"], start=100, name="n").orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(100, 2100))
    assert [(r["v"], r["id"]) for r in got] == sorted((r["v"], r["id"]) for r in got)


def test_same_result_on_other_partitioning(skewed, collect_rows):
    a = ranking.hash_ordinal(skewed.repartition(1), ["g"], ["id"])
    b = ranking.hash_ordinal(skewed.repartition(13, "v"), ["g"], ["id"])
    assert collect_rows(a, "g", "id", "pos") == collect_rows(b, "g", "id", "pos")


def brute_ap_rr(entries):
    ranked = sorted(entries, key=lambda e: (-e[1], e[0]))
    hits, precisions, first = 0, [], None
    for i, (_, _, positive) in enumerate(ranked, 1):
        if positive:
            hits += 1
            precisions.append(hits / i)
            first = first or i
    return (sum(precisions) / hits, 1 / first) if hits else None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.integers(0, 2), st.sampled_from([0.1, 0.2, 0.21, 0.5, 3.0, -1.0]), st.booleans()), min_size=1, max_size=40
    )
)
def test_metrics_equal_brute_force(spark, entries):
    data = [(q, f"t{i:02d}", s, p) for i, (q, s, p) in enumerate(entries)]
    scores = spark.createDataFrame(data, "query_id int, table_id string, score double, positive boolean")
    got = {r["query_id"]: (r["ap"], r["rr"]) for r in metrics.per_query_metrics(scores, "table_id").collect()}
    want = {}
    for q in {d[0] for d in data}:
        value = brute_ap_rr([(t, s, p) for qq, t, s, p in data if qq == q])
        if value:
            want[q] = value
    assert got.keys() == want.keys()
    for q, pair in want.items():
        assert got[q] == pytest.approx(pair)


def test_metric_example(spark):
    scores = spark.createDataFrame(
        [(0, "t0", 0.9, True), (0, "t1", 0.1, False), (0, "t2", 0.8, True), (1, "t0", 0.2, False), (1, "t1", 0.3, False), (1, "t2", 0.1, True)],
        "query_id int, table_id string, score double, positive boolean",
    )
    row = metrics.map_mrr(metrics.per_query_metrics(scores, "table_id")).first()
    assert row["map"] == pytest.approx(2 / 3, abs=1e-6)
    assert row["mrr"] == pytest.approx(2 / 3, abs=1e-6)


def test_empty_metrics_are_zero(spark):
    scores = spark.createDataFrame([], "query_id int, table_id string, score double, positive boolean")
    assert tuple(metrics.map_mrr(metrics.per_query_metrics(scores, "table_id")).first()) == (0.0, 0.0, 0)


def test_strict_metrics_fail_without_positive(spark):
    scores = spark.createDataFrame([(0, "a", 1.0, False)], "query_id int, table_id string, score double, positive boolean")
    with pytest.raises(Exception, match="query without a positive"):
        metrics.strict_per_query(scores, "table_id").collect()


def test_info_nce_brute_force(spark):
    import math

    data = [(0, "a", 0.9, True), (0, "b", 0.4, False), (0, "c", 0.5, True), (1, "a", -0.9, True), (1, "b", 0.9, False)]
    scores = spark.createDataFrame(data, "query_id int, table_id string, score double, positive boolean")
    got = {r["query_id"]: r["loss"] for r in metrics.info_nce(scores).collect()}
    for q in (0, 1):
        every = sum(math.exp(s / 0.07) for qq, _, s, _ in data if qq == q)
        positive = sum(math.exp(s / 0.07) for qq, _, s, p in data if qq == q and p)
        assert got[q] == pytest.approx(math.log(every) - math.log(positive))


def test_medians_of_a_hot_group(spark):
    from tableseek.operators.profile import exact_medians

    df = spark.createDataFrame([("a", float(v)) for v in [1, 1, 1, 1, 9, 2, 3]] + [("b", 4.0), ("b", 6.0)], "g string, v double")
    got = {r["g"]: r["median"] for r in exact_medians(df, ["g"], "v").collect()}
    assert got == {"a": 1.0, "b": 5.0}
