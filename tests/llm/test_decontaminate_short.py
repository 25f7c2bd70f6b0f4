"""Short test items and items without id."""

from tableseek.llm import decontaminate as d

LONG = "a long question of the benchmark that has no number of its own at all"


def test_short_items_and_null_ids(spark):
    items = [(1, "Who wrote Faust?"), (2, "ice"), (None, LONG), (None, "So what?"), (3, ""), (4, None), (5, "?!"), (None, None)]
    docs = [(1, "Q: who wrote, FAUST"), (2, "who wrote faustus"), (3, "twice"), (4, f"x {LONG.replace('number', 'numbr')} y"), (5, "so what"), (6, "ice so what"), (7, None), (8, ""), (9, "who wrote fust")]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    want = [(1, 1, 0), (4, None, 1), (5, None, 0), (6, 2, 0), (6, None, 0)]
    for block in (d.BLOCK_CHARS, 10):
        got = [tuple(r) for r in d.find_contamination(left, right, ["doc_id"], block_chars=block).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        kept = d.drop_contaminated(left, right, block_chars=block)
        assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 7, 8, 9]
