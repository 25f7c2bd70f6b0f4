"""Shape bins with an end."""

from tableseek.operators import batches as B


def test_last_bin_takes_larger_tables(spark):
    shapes = spark.createDataFrame([("a", 2, 17), ("b", 2, 9), ("c", 2, 50), ("d", 2, 8)], "table_id string, n_cols int, n_rows int")
    ended = {r.table_id: (r.row_bin, r.microbatch) for r in B.shape_microbatches(shapes, 64, 16, largest=(8, 16)).collect()}
    assert ended == {"a": (16, 1), "b": (16, 1), "c": (16, 2), "d": (8, 0)}
    free = {r.table_id: r.row_bin for r in B.shape_microbatches(shapes, 64, 16).collect()}
    assert free == {"a": 32, "b": 16, "c": 64, "d": 8}
