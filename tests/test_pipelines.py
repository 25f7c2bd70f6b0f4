"""Candidates, batches, corruption, lineage, sources, checkpoints and streams on small fixtures."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableseek.operators import batches as B
from tableseek.operators import candidates as K
from tableseek.operators import lineage as L
from tableseek.operators import retrieval as X
from tableseek.operators import sampling as S
from tableseek.operators import scoring as V
from tableseek.operators.corrupt import corrupt_cells
from tableseek.operators.states import free_streaks, state_changes
from tableseek.session import scratch_path
from tableseek.sources import readers, writers
from tableseek.streaming import jobs


@pytest.fixture(scope="module")
def hot_database(spark):
    """300 tables, two thirds in one database; 60 questions, most of them there."""
    db = F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("d"), (F.col("id") % 10).cast("string")))
    tables = spark.range(300).select(db.alias("db_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("table_id"), F.lit(1).alias("n_rows"))
    qrels = spark.range(60).select(
        F.col("id").alias("query_id"), F.when((F.col("id") * 5) % 3 < 2, "hot").otherwise(F.concat(F.lit("d"), (F.col("id") * 5 % 10).cast("string"))).alias("db_id"),
        F.concat(F.lit("t"), (F.col("id") * 5).cast("string")).alias("table_id"),
    )
    return tables, qrels


def test_hard_negatives_are_complete(spark, hot_database):
    tables, qrels = hot_database
    found = K.hard_negatives(qrels, tables, 4)
    per_query = found.groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("table_id").alias("d"))
    free = tables.groupBy("db_id").agg((F.count("*") - 1).alias("free"))
    checked = qrels.join(free, "db_id").join(per_query, "query_id", "left")
    assert checked.filter("coalesce(n, 0) <> least(free, 4) or coalesce(d, 0) <> coalesce(n, 0)").isEmpty()
    assert found.join(qrels, ["query_id", "table_id"], "left_semi").isEmpty()
    assert found.join(tables.withColumnRenamed("db_id", "x"), "table_id").filter("db_id <> x").isEmpty()


def test_candidate_plan(spark, collect_rows):
    tables = spark.createDataFrame([("d0", "d0#sep#t0"), ("d0", "d0#sep#t1"), ("d1", "d1#sep#t0"), ("d2", "d2#sep#t0")], "db_id string, table_id string")
    queries = spark.createDataFrame([(0, "d0", 0), (1, "d1", 0)], "query_id bigint, db_id string, chunk bigint")
    gold = spark.createDataFrame([(0, "d0#sep#t1"), (1, "d1#sep#t0")], "query_id bigint, table_id string")
    plan = K.candidate_plan(queries, tables, gold, 1)
    assert collect_rows(plan) == collect_rows(K.candidate_plan(queries, tables, gold, 1))
    assert {r["table_id"] for r in plan.filter("own").collect()} == {"d0#sep#t0", "d0#sep#t1", "d1#sep#t0"}
    assert K.plan_violations(plan, gold).isEmpty()
    assert plan.filter("own and not positive and query_id = 1").isEmpty()


def test_epochs(spark):
    ids = spark.range(10)
    chunks = S.disjoint_chunks(ids, "id", 4)
    assert sorted(r["count"] for r in chunks.groupBy("chunk").count().collect()) == [2, 4, 4]
    assert chunks.select("id").distinct().count() == 10
    epochs = S.reshuffled_epochs(ids, "id", 20, 3).collect()
    orders = [tuple(r["id"] for r in sorted((r for r in epochs if r["epoch"] == e), key=lambda r: r["pos"])) for e in range(3)]
    assert len(set(orders)) == 3 and all(sorted(o) == list(range(10)) for o in orders)


def test_half_even_split(spark):
    counts = {r["split"]: r["count"] for r in S.split_queries(spark.range(10), "id", {"train": 0.25, "val": 0.25, "test": 0.5}).groupBy("split").count().collect()}
    assert counts == {"train": 2, "val": 2, "test": 6}
    with pytest.raises(ValueError):
        S.split_queries(spark.range(3), "id", {"train": 0.5, "val": 0.1, "test": 0.1})


def test_corpus_size_is_checked(spark):
    with pytest.raises(ValueError):
        S.fixed_corpus(spark.range(5), spark.range(9), "id", 4)
    assert S.fixed_corpus(spark.range(5), spark.range(9), "id", 7).count() == 7


def test_batch_counts(spark):
    got = [r[0] for r in spark.range(1, 11).orderBy("id").select(B.batch_count("id", 4)).collect()]
    assert got == [0, 1, 1, 1, 1, 2, 2, 2, 2, 3]


def test_corruption(spark):
    rows = [(0, "t", 0, "h", i, "same" if i % 2 else f"v{i}") for i in range(40)] + [(0, "t", 1, "const", i, "x") for i in range(20)]
    cells = spark.createDataFrame(rows + [(0, "t", 0, "h", 99, " ")], "batch int, table_id string, col_idx int, header string, row_key int, cell string")
    out = corrupt_cells(cells, 0.25).collect()
    assert len(out) == 61
    assert sum(r["label"] for r in out if r["header"] == "h") == 10
    assert sum(r["label"] for r in out if r["header"] == "const") == 5
    pool = {r["original"] for r in out if r["header"] == "h"}
    for r in out:
        if r["label"] and r["header"] == "h":
            assert r["cell"] != r["original"] and r["cell"] in pool and r["original"].strip()
        else:
            assert r["cell"] == r["original"]


LINEAGE = [
    (
        "SELECT h.level FROM [harbours] AS h RIGHT JOIN \"tide tables\" w ON w.port = h.port WHERE h.note LIKE '%join ferries%'",
        ["harbours", "tide tables"],
    ),
    ("SELECT port FROM main.ferries UNION ALL SELECT port FROM harbours /* and FROM spare */", ["ferries", "harbours"]),
    ("SELECT f(a, b), (SELECT 1 FROM ferries) FROM (harbours), spare -- FROM nothing", ["ferries", "spare"]),
    ("SELECT * FROM harbours LEFT JOIN ONLY ferries /* JOIN spare */ ON a = b, spare", ["harbours", "ferries"]),
]


@pytest.mark.parametrize("sql, want", LINEAGE)
def test_syntax_lineage(spark, sql, want):
    names = ["harbours", "ferries", "tide tables", "spare"]
    catalog = spark.createDataFrame([("d", n) for n in names], "db_id string, table_name string")
    query = spark.createDataFrame([(0, "d", sql)], "query_id int, db_id string, sql string")
    got = [r["table_name"] for r in L.syntax_tables(query, catalog).orderBy("pos").collect()]
    assert got == want


def test_mentions_equal_a_name_by_name_scan(spark):
    import re

    names = ["plain", "two words", "#odd name", "name", "Upper", "a.b", "!!", "x\\E y"]
    texts = [
        "SELECT plain, name FROM x", "select * from [two  words], [two words]", "xplain UPPER plain_2", "a.b a.bc",
        "q #odd name 'name'", "!! -- plain", "two wordsy", "", "from [x\\e y]",
    ]
    catalog = spark.createDataFrame([("d", n) for n in names], "db_id string, table_name string")
    queries = spark.createDataFrame([(i, "d", t) for i, t in enumerate(texts)], "query_id int, db_id string, sql string")
    got = {(r["query_id"], r["table_name"]) for r in L.mentioned_tables(queries, catalog).collect()}
    want = set()
    for i, text in enumerate(texts):
        scrubbed = re.sub(r"--[^\n]*|'[^']*'", " ", text)
        want |= {(i, n) for n in names if re.search(rf"(?<![A-Za-z0-9_]){re.escape(n)}(?![A-Za-z0-9_])", scrubbed, re.I)}
    assert got == want


def test_nearest_centroids_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(40, 5))
    vectors = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, vec array<double>")
    centroids = V.kmeans_centroids(vectors.select("vec"), 4)
    book = np.stack([r["vec"] for r in centroids.orderBy("centroid").collect()])
    unit = book / np.linalg.norm(book, axis=1, keepdims=True)
    got = {}
    for r in V.nearest_centroids(vectors, centroids, 2).collect():
        got.setdefault(r["vec_id"], set()).add(r["centroid"])
    assert {k: v for k, v in got.items()} == {i: set(np.argsort(-(unit @ p))[:2].tolist()) for i, p in enumerate(points)}


def test_quoted_keyword_is_a_table(spark):
    catalog = spark.createDataFrame([("d", "from")], "db_id string, table_name string")
    query = spark.createDataFrame([(0, "d", 'SELECT * FROM "from"')], "query_id int, db_id string, sql string")
    assert [r["table_name"] for r in L.syntax_tables(query, catalog).collect()] == ["from"]


def test_scores_equal_brute_force_for_a_hot_table(spark, monkeypatch):
    monkeypatch.setattr(V, "QUERIES_PER_PIECE", 2)
    rng = np.random.default_rng(7)
    cells = [("hot", i % 3, i // 3, rng.normal(size=4).tolist()) for i in range(6)] + [("small", 0, 0, rng.normal(size=4).tolist())]
    tokens = [(q, t, rng.normal(size=4).tolist()) for q in range(9) for t in range(2)]
    pairs = [(q, "hot") for q in range(9)] + [(0, "small"), (1, "empty"), (77, "hot"), (77, "small")]  # query 77 has no token
    got = {
        (r["query_id"], r["table_id"]): r
        for r in V.score_candidates(
            spark.createDataFrame(pairs, "query_id bigint, table_id string"),
            spark.createDataFrame(tokens, "query_id bigint, tok_idx int, vec array<double>"),
            spark.createDataFrame(cells, "table_id string, col_idx int, row_idx int, vec array<double>"),
        ).collect()
    }
    assert set(got) == set(pairs)
    assert all(got[pair]["global"] == got[pair]["mixture"] == 0.0 for pair in [(1, "empty"), (77, "hot"), (77, "small")])
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    for q, table in pairs[:-3]:
        mine = [c for c in cells if c[0] == table]
        best = by_col = by_row = row_mean = 0.0
        for _, _, vec in [t for t in tokens if t[0] == q]:
            sims = {(c, r): float(unit(vec) @ unit(x)) for _, c, r, x in mine}
            cols, rows = sorted({c for c, _ in sims}), sorted({r for _, r in sims})
            best += max(sims.values())
            by_col += np.mean([max(s for (c, _), s in sims.items() if c == k) for k in cols])
            by_row += np.mean([max(s for (_, r), s in sims.items() if r == k) for k in rows])
            row_mean += np.mean([unit(vec) @ unit(np.mean([x for _, _, r, x in mine if r == k], axis=0)) for k in rows])
        row = got[(q, table)]
        assert (row["global"], row["row_match"], row["column_match"]) == pytest.approx((best, by_col, by_row))
        assert row["mixture"] == pytest.approx(0.5 * by_col + 0.5 * row_mean)


def test_short_passages_are_found_whole(spark, collect_rows):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "beta, gamma!"), (3, "alphabet gamma")], "id bigint, contents string")
    passages = spark.createDataFrame([(0, "Beta Gamma"), (1, "alpha"), (2, "")], "query_id bigint, text string")
    assert collect_rows(X.passage_qrels(docs, passages)) == [(0, 1), (0, 2), (1, 1)]


def test_states_do_not_depend_on_pieces(spark, collect_rows):
    pattern = "ffbfffbbffffffbfbff"
    rows = [(h, i, i, "free" if c == "f" else "busy") for h in (0, 1) for i, c in enumerate(pattern[h:])]
    readings = spark.createDataFrame(rows, "host bigint, ts bigint, event_id bigint, state string")
    changes = [collect_rows(state_changes(readings, F.floor(F.col("ts") / n))) for n in (1, 4, 100)]
    assert changes[0] == changes[1] == changes[2]
    flagged = readings.withColumn("free", F.col("state") == "free")
    for k in (2, 3):
        found = [collect_rows(free_streaks(flagged, k, F.floor(F.col("ts") / n)), "host", "event_id") for n in (1, 4, 100)]
        want = []
        for h in (0, 1):
            run = 0
            for i, c in enumerate(pattern[h:]):
                run = run + 1 if c == "f" else 0
                if run == k:
                    want.append((h, i))
        assert found[0] == found[1] == found[2] == sorted(want)


def test_first_reading_switch(spark):
    readings = spark.createDataFrame([(0, 0, 0, "a"), (0, 1, 1, "b")], "host bigint, ts bigint, event_id bigint, state string")
    assert state_changes(readings, F.lit(0), notify_first=False).count() == 1


def test_recovery_withholds_output_until_all_databases_are_built(spark):
    path = scratch_path(spark, "ckpt")
    requested = spark.createDataFrame([("good",), ("missing",), ("no rows",)], "db_id string")
    items = spark.createDataFrame([("good", 1), ("missing", 2)], "db_id string, id int")
    asked = []

    def build(fail):
        def run(todo):
            asked.append(sorted(r["db_id"] for r in todo.collect()))
            failures = todo.filter(F.col("db_id").isin(*fail) if fail else F.lit(False)).select("db_id", F.lit("gone").alias("error"))
            return items.join(todo, "db_id", "left_semi"), failures

        return run

    left = writers.resume_by_database(spark, requested, build(["missing"]), path, "db_id string, id int", {"seed": "42"})
    assert [r["db_id"] for r in left.collect()] == ["missing"]
    with pytest.raises(ValueError):
        writers.read_staged(spark, path, {"seed": "42"}, "rows")
    with pytest.raises(ValueError):
        writers.resume_by_database(spark, requested, build([]), path, "db_id string, id int", {"seed": "1"})
    before = {f.name for f in Path(path.removeprefix("file:")).iterdir()}
    writers.resume_by_database(spark, requested, build([]), path, "db_id string, id int", {"seed": "42"})
    writers.resume_by_database(spark, requested, build([]), path, "db_id string, id int", {"seed": "42"})
    assert asked == [["good", "missing", "no rows"], ["missing"]]  # a database without rows is done, too
    assert writers.read_staged(spark, path, {"seed": "42"}, "rows").count() == 2
    assert before <= {f.name for f in Path(path.removeprefix("file:")).iterdir()}  # completion moved and rewrote nothing


def test_web_dump(spark, tmp_path):
    import gzip

    wide = {"relation": [["n"] + [str(i) for i in range(120)], ["m"] + [f"m{i}" for i in range(120)]], "pageTitle": " big  one "}
    lines = [json.dumps(wide), "", "{broken", json.dumps({"relation": [], "pageTitle": "only title"}), json.dumps({"relation": [["a", " x\t"], ["b", "y", "z"]], "pageTitle": "r"})]
    (tmp_path / "sub").mkdir()
    with gzip.open(tmp_path / "sub" / "one.json.gz", "wt", encoding="utf-8") as f:
        f.write("\n".join(lines))
    good, bad = readers.scan_web_dump(spark, str(tmp_path))
    docs = {r["id"]: r for r in readers.web_documents(good, start=10).collect()}
    assert [r["line"] for r in bad.collect()] == ["{broken"]
    assert sorted(docs) == ["10", "11", "12"]
    assert docs["11"]["contents"] == "only title" and docs["11"]["num_columns"] == 0
    assert docs["12"]["contents"].endswith("[ROWS]\nx | y")
    body = docs["10"]["contents"].split("[ROWS]\n")[1].split("\n")
    numbers = [int(row.split(" | ")[0]) for row in body]
    assert len(body) == 50 and numbers == sorted(numbers)
    assert all(row == f"{n} | m{n}" for row, n in zip(body, numbers, strict=True))
    assert docs["10"]["page_title"] == docs["10"]["table_name"] == "big one"


def test_record_files_and_questions(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"db_id": "x", "v": 1}, {"db_id": "y", "v": 1}]))
    (tmp_path / "b.json").write_text(json.dumps({"x": {"db_id": "x", "v": 2}}))
    records = readers.scan_records(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")], "db_id: string, v: int")
    assert {r["db_id"]: r["v"] for r in readers.latest_record(records, "db_id").collect()} == {"x": 2, "y": 1}
    (tmp_path / "q.json").write_text(json.dumps([{"question": "q", "db_id": "x", "SQL": "SELECT 1"}, {"question": "r", "db_id": "x", "query": "SELECT 2"}]))
    asked = readers.scan_questions(spark, {"dev": str(tmp_path / "q.json")}).collect()
    assert sorted((r["question"], r["sql"], r["source_split"]) for r in asked) == [("q", "SELECT 1", "dev"), ("r", "SELECT 2", "dev")]


def test_database_discovery(spark, tmp_path, collect_rows):
    (tmp_path / "one").mkdir()
    for p in (tmp_path / "one" / "one.sqlite", tmp_path / "two.sqlite"):
        p.write_bytes(b"x")
    found = readers.find_databases(spark, str(tmp_path))
    assert [r[0] for r in collect_rows(found, "db_id")] == ["one", "two"]
    wanted = spark.createDataFrame([("one",), ("gone",)], "db_id string")
    assert [r["db_id"] for r in readers.unresolved_databases(wanted, found).collect()] == ["gone"]
    twice = found.unionByName(found.withColumn("path", F.concat("path", F.lit("x"))))
    assert S.conflicting_roots(twice).count() == 2 and S.conflicting_roots(found).isEmpty()


def test_corpus_scan_accepts_both_title_names(spark, tmp_path):
    record = {"id": "7", "page_title": "t", "column_names": ["a"], "contents": "[TABLE]\nt\n\n[SCHEMA]\na\n\n[ROWS]\n1", "source": "webtable"}
    (tmp_path / "c.jsonl").write_text(json.dumps(record) + "\n" + json.dumps({**record, "id": "8", "column_names": []}))
    tables = readers.corpus_tables(spark, str(tmp_path / "c.jsonl")).collect()
    assert [(r["id"], r["table_name"]) for r in tables] == [("7", "t")]
    assert readers.corpus_texts(spark, str(tmp_path / "c.jsonl")).columns == ["id", "contents"]


def test_cache_merge_keeps_existing(spark, tmp_path):
    path = str(tmp_path / "cache")
    spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int").write.parquet(path)
    current = spark.createDataFrame([("a", 2)], "k string, v int")
    assert {tuple(r) for r in writers.merge_cache_file(current, path, "k").collect()} == {("a", 2), ("b", 1)}
    assert writers.merge_cache_file(current, path, "k", replace=True).count() == 2


def test_existing_corpus_is_not_overwritten(spark, tmp_path):
    docs = spark.createDataFrame([("1", "é")], "id string, contents string")
    writers.write_corpus(docs, str(tmp_path / "out"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        writers.write_corpus(docs, str(tmp_path / "out"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert "é" in text


def test_vectorisers_share_one_contract(spark):
    from tableseek.operators.vectorise import VECTORISERS, vectorise

    strings = spark.createDataFrame([("a b a",), ("a b a",), ("c",)], "s string")
    for kind in VECTORISERS:
        out = vectorise(strings, "s", 16, kind)
        assert out.columns == ["text_key", "dim", "value"]
        assert out.select("text_key").distinct().count() == 2


def test_permuted_tables_pool_to_the_same_vector(spark):
    cells = spark.range(12).select(
        F.lit("t").alias("table_id"), (F.col("id") % 3).cast("int").alias("col_idx"), F.floor(F.col("id") / 3).cast("int").alias("row_idx"),
        F.lit("h").alias("header"), F.col("id").cast("string").alias("cell"),
    )
    moved = S.shuffle_cells(cells)
    assert moved.count() == 12

    def pooled(df):
        vecs = df.withColumn("vec", F.array(F.col("cell").cast("double"), F.lit(1.0)))
        return V.pooled_vectors(vecs).filter("grain = 'table'").first()["vec"]

    assert pooled(cells) == pytest.approx(pooled(moved))
    rows = moved.groupBy("row_idx").agg(F.array_sort(F.collect_list(F.col("cell").cast("int"))).alias("r")).collect()
    assert sorted(r["r"] for r in rows) == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
