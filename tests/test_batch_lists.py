"""Prepared batches as lists."""

from tableseek.operators import batches as B

SF = "/root/testdata/sf0.001"


def test_no_pairs_are_shuffled(spark):
    """Queries and candidates of a batch meet inside its row: nothing is joined or dealt after they are expanded."""
    from tableseek.plans import QUERIES

    for name in ("train_batches", "batch_invariants"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("collect_list(struct(query_id")]
        assert "Join" not in above and "Window" not in above and above.count("Aggregate") <= 2


def test_list_audit_equals_row_audit(spark):
    rows = [(0, q, c, f"t{c % 3 if q == 2 else c}", q != 1 and c == 0) for q in range(4) for c in range(5) if not (q == 3 and c == 0)]
    long = spark.createDataFrame(rows, "batch long, query_id long, candidate long, table_id string, positive boolean")
    lists = long.groupBy("batch", "query_id").agg({"batch": "max"}).drop("max(batch)").join(
        long.selectExpr("query_id", "struct(candidate, table_id, positive) c").groupBy("query_id").agg({"c": "collect_list"}).withColumnRenamed("collect_list(c)", "candidates"), "query_id"
    )
    got = B.list_invariants(lists).first().asDict()
    assert got == B.batch_invariants(long).first().asDict() == {"n_queries": 4, "no_positive": 2, "bad_index": 1, "duplicate_candidate": 1}
