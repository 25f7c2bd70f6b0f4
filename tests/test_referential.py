"""A festival's database: chains, self references, composite and malformed keys."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tableseek.operators import databases as D
from tableseek.operators import referential as R
from tableseek.sources import sqlite as S


SCHEMA = """
CREATE TABLE stage (id INTEGER PRIMARY KEY, title TEXT);
CREATE TABLE show (id INTEGER PRIMARY KEY, note TEXT, stage_id INTEGER REFERENCES stage(id));
CREATE TABLE ticket (id INTEGER PRIMARY KEY, price REAL, show_id INTEGER REFERENCES show);
CREATE TABLE artist (id INTEGER PRIMARY KEY, mentor_id INTEGER REFERENCES artist(id));
CREATE TABLE seat (block TEXT, place INTEGER, PRIMARY KEY (block, place)) WITHOUT ROWID;
CREATE TABLE booking (id INTEGER PRIMARY KEY, block TEXT, place INTEGER, FOREIGN KEY (block, place) REFERENCES seat(block, place));
CREATE TABLE sponsor (id INTEGER PRIMARY KEY, city TEXT);
CREATE TABLE banner (id INTEGER PRIMARY KEY, sponsor_code TEXT REFERENCES sponsor(code));
"""


def festival():
    """Rows by table. Some references are NULL, some dangle, banners point at a column that sponsors lack."""
    stages = [(3 * i, f"stage {i % 5}") for i in range(1, 41)]
    shows = [(i, "late" if i % 4 else None, None if i % 50 == 0 else -i if i % 77 == 0 else 3 * (i * 7 % 40 + 1)) for i in range(1, 701)]
    tickets = [(i, i / 8, None if i % 90 == 0 else 10_000 + i if i % 61 == 0 else i * 13 % 700 + 1) for i in range(1, 1501)]
    artists = [(i, i // 2 or None) for i in range(1, 64)]
    seats = [(block, place) for block in "ABCDE" for place in range(1, 25)]
    bookings = [(i, "ABCDE"[i % 5], i * 11 % 24 + 1) for i in range(1, 801)]
    sponsors, banners = [(i, f"city {i}") for i in range(5, 9)], [(i, f"code {i}") for i in range(3)]
    return {"stage": stages, "show": shows, "ticket": tickets, "artist": artists, "seat": seats, "booking": bookings, "sponsor": sponsors, "banner": banners}


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = tmp_path_factory.mktemp("db") / "festival.sqlite"
    con = sqlite3.connect(path)
    con.executescript(SCHEMA)
    for table, rows in festival().items():
        con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    con.commit()
    con.close()
    return {"festival": str(path)}


@pytest.fixture(scope="module")
def foreign_keys(spark, database):
    columns = S.read_sqlite(spark, database, "columns")
    fks = S.resolved_foreign_keys(S.read_sqlite(spark, database, "fks"), columns)
    live = columns.select("db_id", F.col("table_name").alias("parent"), F.col("column_name").alias("parent_column"))
    known = fks.join(live, ["db_id", "parent", "parent_column"], "left_semi")
    whole = fks.groupBy("db_id", "child", "fk_id").count().join(known.groupBy("db_id", "child", "fk_id").count(), ["db_id", "child", "fk_id", "count"])
    ordered = F.array_sort(F.collect_list(F.struct("seq", "child_column", "parent_column")))
    grouped = known.join(whole, ["db_id", "child", "fk_id"], "left_semi").groupBy("db_id", "child", "parent", "fk_id").agg(ordered.alias("c"))
    return grouped.select(
        "db_id", F.concat_ws("/", "child", F.col("fk_id").cast("string")).alias("fk_id"), "child", "parent",
        F.transform("c", lambda x: x["child_column"]).alias("child_columns"), F.transform("c", lambda x: x["parent_column"]).alias("parent_columns"),
    )


def test_catalog(spark, database, collect_rows):
    names = [r[1] for r in collect_rows(S.read_sqlite(spark, database, "tables"))]
    assert names == sorted(festival())


def test_implicit_parent_column_is_the_primary_key(spark, database):
    columns = S.read_sqlite(spark, database, "columns")
    fks = S.resolved_foreign_keys(S.read_sqlite(spark, database, "fks"), columns)
    assert fks.filter("child = 'ticket'").first()["parent_column"] == "id"


def test_rows_filter_prunes(spark, database):
    rows = S.read_sqlite(spark, database).filter("table_name = 'stage'")
    assert rows.count() == 40
    assert rows.filter("rowid = 6").first()["values"] == {"id": "6", "title": "stage 2"}


def test_closed_capped_and_repeatable(spark, database, foreign_keys, collect_rows):
    assert foreign_keys.filter("child = 'banner'").isEmpty()
    rows = S.read_sqlite(spark, database)
    sampled, _ = D.sample_databases(rows, foreign_keys, max_rows=7)
    again, _ = D.sample_databases(rows, foreign_keys, max_rows=7)
    keys = collect_rows(sampled, "table_name", "rowid")
    assert keys == collect_rows(again, "table_name", "rowid")
    assert sampled.groupBy("table_name").count().agg(F.max("count")).first()[0] <= 7
    assert D.dangling_rows(sampled, sampled, foreign_keys).isEmpty()
    assert {k[0] for k in keys} >= {"stage", "show", "ticket", "seat", "booking", "banner"}


def test_emit_keeps_requested_tables_without_rows(spark, database, foreign_keys):
    rows = S.read_sqlite(spark, database).filter("table_name = 'show'")
    columns = S.read_sqlite(spark, database, "columns")
    requested = spark.createDataFrame([("festival", "show"), ("festival", "nothing")], "db_id string, table_name string")
    capped, _ = D.sample_databases(rows, foreign_keys.limit(0), max_rows=3)
    tables = {r["table_name"]: r for r in D.emit_tables(capped, columns, foreign_keys, requested).collect()}
    assert tables["nothing"]["n_rows"] == 0 and tables["nothing"]["columns"] == []
    assert [(c["header"], c["is_foreign_key"], len(c["cells"])) for c in tables["show"]["columns"]] == [
        ("id", False, 3), ("note", False, 3), ("stage_id", True, 3),
    ]


def test_orders():
    fks = [
        R.ForeignKey("b", "a", ("x",), ("x",)), R.ForeignKey("c", "b", ("x",), ("x",)), R.ForeignKey("c", "c", ("y",), ("x",)),
        R.ForeignKey("m", "n", ("x",), ("x",)), R.ForeignKey("n", "m", ("x",), ("x",)),
    ]
    tables = ["n", "c", "b", "a", "m"]
    assert R.parent_first_order(tables, fks) == ["a", "b", "c", "m", "n"]
    assert R.child_first_order(tables, fks)[:3] == ["c", "b", "a"]


def test_two_hop_alignment_is_complete(spark):
    tables = {
        "a": spark.range(500).select("id"),
        "b": spark.range(2000).select("id", (F.col("id") % 500).alias("a_id")),
        "c": spark.range(8000).select("id", (F.col("id") % 2000).alias("b_id")),
    }
    fks = [R.ForeignKey("b", "a", ("a_id",), ("id",)), R.ForeignKey("c", "b", ("b_id",), ("id",))]
    keys = {t: ["id"] for t in tables}
    final = R.aligned_sample(tables, keys, fks, 50)
    assert final["b"].join(final["a"].withColumnRenamed("id", "a_id"), "a_id", "left_anti").isEmpty()
    assert final["c"].join(final["b"].select(F.col("id").alias("b_id")), "b_id", "left_anti").isEmpty()


def test_self_reference_reaches_a_fixed_point(spark):
    """Each artist's mentor has half the number; without number 3 its whole branch goes."""
    artist = spark.range(1, 64).select("id", F.when(F.col("id") > 1, F.floor(F.col("id") / 2)).alias("mentor_id"))
    fk = R.ForeignKey("artist", "artist", ("mentor_id",), ("id",))
    kept, removed = R.prune_to_closure({"artist": artist.filter("id <> 3")}, [fk])
    left = {r["id"] for r in kept["artist"].collect()}
    assert removed == 30 and len(left) == 32 and not left & {6, 7, 13, 27, 60}
