"""File formats and streams: data of the given tables is written, read back and checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableseek.functions import text as T
from tableseek.operators import batches as B
from tableseek.operators import metrics as M
from tableseek.operators.profile import attractors, is_free
from tableseek.operators.states import free_streaks, state_changes
from tableseek.plans.lowering import ORDER_ROWS_SQL, QUESTIONS_SQL, catalog, order_tables
from tableseek.plans.profile_queries import READINGS_SQL, readings
from tableseek.plans.registry import load, query
from tableseek.plans.retrieval_queries import BM25_SQL, METRIC_SQL, judged_hits
from tableseek.plans.text_queries import _DOC_SQL
from tableseek.session import materialize, scratch_path
from tableseek.sources import readers as R
from tableseek.sources import writers as W
from tableseek.streaming import jobs as J


def web_lines(spark, d):
    """Order tables as dump lines, header first; lines of even orders are followed by a broken one."""
    tables = order_tables(spark, d)
    relation = F.transform("columns", lambda c: F.concat(F.array(c["header"]), c["cells"]))
    line = F.to_json(F.struct(relation.alias("relation"), F.concat(F.lit("  page\t"), F.col("table_name")).alias("pageTitle")))
    odd = F.substring("table_name", -1, 1).cast("int") % 2
    both = F.when(odd == 0, F.array(line, F.concat(F.lit('{"relation": [['), F.col("table_name")))).otherwise(F.array(line))
    return T.exploded(tables, both, "value")


_CLEAN_ROWS = ORDER_ROWS_SQL + """,
web AS (SELECT table_id, concat('[TABLE]
page ', split_part(table_id, '#sep#', 2), '

[SCHEMA]
line_key | partkey | suppkey | quantity | return_flag | ship_date

[ROWS]', string_agg(concat('
', concat_ws(' | ', line_key, partkey, suppkey, quantity, trim(return_flag), ship_date)), '' ORDER BY row_idx)) AS contents
  FROM order_rows GROUP BY table_id)"""


@query(
    "web_dump_scan",
    f"""WITH {_CLEAN_ROWS}
SELECT 'page ' || split_part(table_id, '#sep#', 2) AS page_title, 6 AS num_columns, md5(contents) AS contents_md5, (SELECT count(*) FROM web) AS n_ids,
  (SELECT count(*) FROM web WHERE right(table_id, 1)::INT % 2 = 0) AS n_bad FROM web""",
)
def web_dump_scan(spark, d):
    """gzip dump files with broken lines: good lines become documents with dense ids."""
    folder = scratch_path(spark, "dump")
    web_lines(spark, d).write.text(f"{folder}/part.json.gz", compression="gzip")
    good, bad = R.scan_web_dump(spark, f"{folder}/part.json.gz", "*.txt.gz")
    documents = R.web_documents(good)
    ids = documents.agg((F.max(F.col("id").cast("bigint")) + 1).alias("n")).scalar()
    return documents.select(
        "page_title", "num_columns", F.md5("contents").alias("contents_md5"), ids.alias("n_ids"),
        bad.agg(F.count("*")).scalar().alias("n_bad"),
    )


@query(
    "corpus_scan",
    f"""WITH {_DOC_SQL}
SELECT table_id AS id, split_part(table_id, '#sep#', 2) AS table_name, CAST(6 AS BIGINT) AS n_cols, n_rows, 'bird' AS source FROM docs""",
)
def corpus_scan(spark, d):
    """Corpus lines written as JSON and parsed back to tables."""
    path = scratch_path(spark, "corpus")
    tables = order_tables(spark, d)
    W.write_corpus(
        tables.select(
            F.col("table_id").alias("id"), "table_name", F.transform("columns", lambda c: c["header"]).alias("column_names"),
            T.render_document("table_name", "columns").alias("contents"), F.lit("bird").alias("source"),
        ),
        path,
    )
    back = R.corpus_tables(spark, path).filter(F.col("source") == "bird")
    return back.select(
        "id", "table_name", F.size("columns").cast("bigint").alias("n_cols"),
        T.shortest_column("columns").cast("bigint").alias("n_rows"), "source",
    )


@query(
    "question_files",
    """SELECT 'train' AS source_split, conv_id, turn, sha256(text) AS question_key, role AS sql FROM conversations WHERE role <> 'user'
UNION ALL SELECT 'dev', conv_id, turn, sha256(text), role FROM conversations WHERE role = 'user'""",
)
def question_files(spark, d):
    """Two source splits with different keys for the SQL text."""
    turns = load(spark, d, "conversations")
    db = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("db_id")
    one, two = scratch_path(spark, "questions"), scratch_path(spark, "questions")
    turns.filter("role <> 'user'").select(F.col("text").alias("question"), db, F.col("role").alias("SQL")).write.json(one)
    turns.filter("role = 'user'").select(F.col("text").alias("question"), db, F.col("role").alias("query")).write.json(two)
    asked = R.scan_questions(spark, {"train": one, "dev": two}, multi_line=False)
    parts = F.split("db_id", "/")
    return asked.select(
        "source_split", parts[0].cast("bigint").alias("conv_id"), parts[1].cast("bigint").alias("turn"),
        T.fingerprint("question").alias("question_key"), "sql",
    )


@query(
    "device_readings",
    f"""WITH {READINGS_SQL} SELECT host, count(*) AS n, CAST(sum(used::BIGINT) AS BIGINT) AS used, CAST(sum(util) AS BIGINT) AS util FROM
(SELECT host, floor(used) AS used, util FROM readings) GROUP BY host""",
)
def device_readings(spark, d):
    """Readings as comma-separated files with padded fields."""
    path = scratch_path(spark, "readings")
    rows = readings(spark, d).select(
        F.concat_ws(
            ", ", F.col("host").cast("string"), F.lit("device"), F.lit("500"),
            F.floor("memory_used_mb").cast("string"), F.col("utilization_percent").cast("string"),
        ).alias("value")
    )
    rows.write.text(path)
    return R.scan_readings(spark, path).groupBy(F.col("index").cast("bigint").alias("host")).agg(
        F.count("*").alias("n"), F.sum("memory_used_mb").alias("used"), F.sum("utilization_percent").alias("util")
    )


@query(
    "leaderboard",
    """SELECT 'supp' || l_suppkey AS model, round(avg(l_discount), 6) AS test_map, round(avg(l_tax), 6) AS test_mrr FROM lineitem GROUP BY l_suppkey""",
)
def leaderboard(spark, d):
    """One results folder per model, collected into one ranked file."""
    root, board = scratch_path(spark, "results"), scratch_path(spark, "board")
    results = load(spark, d, "lineitem").groupBy(F.concat(F.lit("supp"), F.col("l_suppkey").cast("string")).alias("model")).agg(
        F.round(F.avg("l_discount"), 6).alias("test_map"), F.round(F.avg("l_tax"), 6).alias("test_mrr")
    )
    results.withColumn("folder", F.col("model")).write.partitionBy("folder").json(root)
    found = R.scan_results(spark, f"{root}/*").withColumn("model", F.regexp_replace("model", "^folder=", ""))
    W.write_leaderboard(found, board)
    return spark.read.schema("model STRING, test_map DOUBLE, test_mrr DOUBLE").json(board)


@query(
    "match_records",
    """WITH c AS (SELECT 'supp' || l_suppkey AS table_name, l_returnflag AS matched_column, count(*) AS n_matches, count(DISTINCT l_orderkey) AS n_sources FROM lineitem GROUP BY 1, 2)
SELECT *, (SELECT CAST(sum(n_matches) AS BIGINT) FROM c) AS n_total, (SELECT count(*) FROM c) AS n_targets FROM c ORDER BY n_matches DESC, table_name, matched_column LIMIT 15""",
)
def match_records(spark, d):
    """Ranked-match JSON with a second-best match that must not count."""
    path = scratch_path(spark, "matches")
    best = F.struct(
        F.concat(F.lit("supp"), F.col("l_suppkey").cast("string")).alias("table_name"),
        F.array(F.struct(F.lit("line").alias("query_column"), F.col("l_returnflag").alias("matched_column"))).alias("column_alignment"),
    )
    load(spark, d, "lineitem").select(
        F.concat(F.lit("order"), F.col("l_orderkey").cast("string")).alias("query_table_name"), F.array(best, best).alias("top_matches")
    ).write.json(path)
    return attractors(R.scan_matches(spark, path), ["table_name", "matched_column"], "query_table_name", 15)


@query(
    "schema_files",
    """SELECT 'db' || c_nationkey AS db_id, CASE WHEN c_nationkey % 2 = 0 THEN 'new' ELSE 'old' END AS version, max(c_custkey) AS top FROM customer GROUP BY c_nationkey""",
)
def schema_files(spark, d):
    """A list file and a later dict file per nation; the later record wins."""
    old, new = scratch_path(spark, "schemas"), scratch_path(spark, "schemas")
    top = load(spark, d, "customer").groupBy("c_nationkey").agg(F.max("c_custkey").alias("top"))
    db = F.concat(F.lit("db"), F.col("c_nationkey").cast("string")).alias("db_id")

    def record(version):
        return F.struct(db, F.lit(version).alias("version"), "top")

    top.select(F.to_json(F.array(record("old"))).alias("value")).write.text(old)
    top.filter("c_nationkey % 2 = 0").select(F.to_json(F.create_map(db, record("new"))).alias("value")).write.text(new)
    records = R.scan_records(spark, [old, new], "db_id: string, version: string, top: bigint", line_sep="\n")
    return R.latest_record(records, "db_id")


@query(
    "resumed_checkpoint",
    f"""WITH {QUESTIONS_SQL} SELECT db_id, count(*) AS n_tables, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM catalog GROUP BY db_id""",
)
def resumed_checkpoint(spark, d):
    """First attempt fails for some databases, the second one builds only those and publishes."""
    path, parameters = scratch_path(spark, "checkpoint"), {"max_rows": "50", "seed": "42"}
    tables = catalog(spark, d).withColumn("db_group", F.expr("CAST(substring(db_id, 3) AS BIGINT) % 20"))
    sums = tables.groupBy("db_group", "db_id").agg(F.count("*").alias("n_tables"), F.sum("n_rows").alias("n_rows"))
    groups = sums.select(F.concat(F.lit("g"), F.col("db_group").cast("string")).alias("db_id")).distinct()
    attempts = []

    def build(todo):
        attempts.append(1)
        grouped = sums.withColumnRenamed("db_id", "name").withColumn("db_id", F.concat(F.lit("g"), F.col("db_group").cast("string")))
        rows = grouped.join(todo, "db_id", "left_semi").select("db_id", "name", "n_tables", "n_rows")
        broken = todo.filter(F.col("db_id").isin("g3", "g7") if len(attempts) == 1 else F.lit(False))
        return rows, broken.select("db_id", F.lit("unreadable").alias("error"))

    schema = "db_id string, name string, n_tables bigint, n_rows bigint"
    W.resume_by_database(spark, groups, build, path, schema, parameters, max_attempts=2)
    return W.read_staged(spark, path, parameters, "rows").select(F.col("name").alias("db_id"), "n_tables", "n_rows")


@query(
    "run_manifest",
    f"""WITH {QUESTIONS_SQL}
SELECT 42 AS seed, 50 AS max_rows, count(*) AS n_tables, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(DISTINCT db_id) AS n_databases FROM catalog""",
)
def run_manifest(spark, d):
    path = scratch_path(spark, "manifest")
    counts = catalog(spark, d).groupBy("db_id").agg(F.count("*").alias("t"), F.sum("n_rows").alias("r"))
    W.write_manifest(
        counts.agg(F.sum("t").alias("n_tables"), F.sum("r").alias("n_rows"), F.count("*").alias("n_databases")).select(
            F.lit(42).alias("seed"), F.lit(50).alias("max_rows"), "n_tables", "n_rows", "n_databases"
        ),
        path,
    )
    return spark.read.schema("seed INT, max_rows INT, n_tables BIGINT, n_rows BIGINT, n_databases BIGINT").json(path)


@query(
    "eval_shards",
    f"""WITH {QUESTIONS_SQL}, n AS (SELECT table_id, row_number() OVER (ORDER BY db_id, table_id) - 1 AS i FROM catalog)
SELECT i // 256 AS shard, count(*) AS n_tables, min(table_id) AS first_table FROM n GROUP BY 1""",
)
def eval_shards(spark, d):
    """Table shards in two parts: the writer stops after the first, the next one takes up its parameters and finishes."""
    path, parameters = scratch_path(spark, "shards"), {"table_shard_size": "256", "seed": "42"}
    placed = materialize(B.shards(catalog(spark, d).select("db_id", "table_id"), ["db_id", "table_id"], 256), "placed")
    for parts in ([0], [0, 1]):
        writer = W.StagedWriter(spark, path, parameters)
        for part in parts:
            writer.write(f"part {part}", {"shards": placed.filter(F.col("shard") % 2 == part)}, ["shard"])
    writer.finish(["part 0", "part 1"])
    back = W.read_staged(spark, path, parameters, "shards")
    return back.groupBy(F.col("shard").cast("bigint").alias("shard")).agg(
        F.count("*").alias("n_tables"), F.min("table_id").alias("first_table")
    )


def states(spark, d):
    return readings(spark, d).select("host", "ts", "event_id", _state().alias("state"))


def _state():
    free = is_free(450, 30)
    return F.when(F.col("failed"), "error").when(free, "free").otherwise("busy")


_STATES = f"{READINGS_SQL}, st AS (SELECT host, ts, event_id, CASE WHEN failed THEN 'error' WHEN 500 - used >= 450 AND util <= 30 THEN 'free' ELSE 'busy' END AS state FROM readings)"
_CHANGES = f"""WITH {_STATES}, l AS (SELECT *, lag(state) OVER (PARTITION BY host ORDER BY ts, event_id) AS previous FROM st)
SELECT host, event_id, coalesce(previous, '') AS previous, state FROM l WHERE previous IS NULL OR previous <> state"""
_STREAKS = f"""WITH {_STATES}, i AS (SELECT *, sum((state <> 'free')::INT) OVER (PARTITION BY host ORDER BY ts, event_id) AS island FROM st),
s AS (SELECT *, row_number() OVER (PARTITION BY host, island, state = 'free' ORDER BY ts, event_id) AS streak FROM i)
SELECT host, event_id, streak FROM s WHERE state = 'free' AND streak = 2"""


@query("state_changes", _CHANGES)
def changes(spark, d):
    return state_changes(states(spark, d)).select("host", "event_id", F.coalesce("previous", F.lit("")).alias("previous"), "state")


@query("free_streaks", _STREAKS)
def streaks(spark, d):
    flagged = states(spark, d).select("host", "ts", "event_id", (F.col("state") == "free").alias("free"))
    return free_streaks(flagged, k=2).select("host", "event_id", F.col("streak").cast("bigint").alias("streak"))


def reading_stream(spark, d):
    path = f"{d.rstrip('/')}/events.parquet"
    # As a glob the path may be one file as well as a folder of files.
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1000)
    events = source.parquet(path.replace("events", "event[s]"))
    shaped = events.select(
        F.col("user_id").alias("host"), "ts", "event_id", F.lit(500).alias("memory_total_mb"),
        F.col("value").alias("memory_used_mb"), F.get_json_object("props", "$.k").cast("int").alias("utilization_percent"),
        (F.col("event_type") == "error").alias("failed"),
    )
    return shaped.select("host", "ts", "event_id", _state().alias("state"))


def _watched(spark, d, label, watch, shape=lambda stream: stream):
    """Runs a watcher over all events; the delay covers the disorder of the table's files."""
    out, checkpoint = J.stream_paths(spark, label)
    end = load(spark, d, "events").agg((F.max("ts") + F.expr("INTERVAL 2 YEARS")).alias("ts"))
    return J.watch_to_the_end(shape(reading_stream(spark, d)), watch, end, out, checkpoint)


DELAY = "400 days"


@query("stream_state_changes", _CHANGES)
def stream_state_changes(spark, d):
    found = _watched(spark, d, "changes", lambda s: J.watch_states(s, delay=DELAY))
    return found.select("host", "event_id", F.coalesce("previous", F.lit("")).alias("previous"), "state")


@query("stream_free_streaks", _STREAKS)
def stream_free_streaks(spark, d):
    flagged = lambda s: s.select("host", "ts", "event_id", (F.col("state") == "free").alias("free"))
    return _watched(spark, d, "streaks", lambda s: J.watch_streaks(s, k=2, delay=DELAY), flagged).select("host", "event_id", "streak")


@query(
    "stream_reminders",
    f"""WITH RECURSIVE {_STATES},
o AS (SELECT host, event_id, state, epoch_us(ts) AS us, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS i FROM st),
r AS (SELECT host, i, event_id, state, true AS told, false AS reminder, us AS notified FROM o WHERE i = 1
  UNION ALL SELECT o.host, o.i, o.event_id, o.state, o.state <> r.state OR o.us - r.notified >= 21600000000, o.state = r.state,
    CASE WHEN o.state <> r.state OR o.us - r.notified >= 21600000000 THEN o.us ELSE r.notified END FROM r JOIN o ON o.host = r.host AND o.i = r.i + 1)
SELECT host, event_id, state, reminder FROM r WHERE told""",
)
def stream_reminders(spark, d):
    """Change alerts plus reminders after six quiet hours."""
    found = _watched(spark, d, "reminders", lambda s: J.watch_states(s, reminder_seconds=6 * 3600, delay=DELAY))
    return found.select("host", "event_id", "state", "reminder")


@query(
    "stream_shards",
    f"""WITH {QUESTIONS_SQL}, n AS (SELECT table_id, row_number() OVER (ORDER BY db_id, table_id) - 1 AS i FROM catalog)
SELECT i // 256 AS shard, count(*) AS n_tables, count(DISTINCT table_id) AS n_distinct FROM n GROUP BY 1""",
)
def stream_shards(spark, d):
    """Shards published in two waves; the consumer restarts between them, takes each once and ends at the stop marker."""
    folder, marker = scratch_path(spark, "wave"), scratch_path(spark, "marker")
    out, checkpoint = J.stream_paths(spark, "shards")
    parameters = {"seed": "42"}
    placed = materialize(B.shards(catalog(spark, d).select("db_id", "table_id"), ["db_id", "table_id"], 256), "placed")
    producer = W.StagedWriter(spark, marker, parameters)
    for wave in (0, 1):
        placed.filter(F.col("shard") % 2 == wave).select("shard", "table_id").write.mode("append").parquet(folder)
        producer.write(f"wave {wave}", {"waves": spark.range(wave, wave + 1)})
        J.consume_shards(spark, folder, "shard bigint, table_id string", out, checkpoint, parameters, marker)
    producer.finish(["wave 0", "wave 1"])
    J.consume_until_complete(spark, folder, "shard bigint, table_id string", out, checkpoint, parameters, marker)
    return spark.read.parquet(out).groupBy("shard").agg(
        F.count("*").alias("n_tables"), F.count_distinct("table_id").alias("n_distinct")
    )


@query(
    "stream_ingest",
    """SELECT p.wave, count(*) AS n, min(id) AS low, max(id) AS high, count(DISTINCT id) AS n_ids FROM (
  SELECT page_id % 2 AS wave, 1000 + row_number() OVER (ORDER BY page_id % 2, page_id) - 1 AS id FROM pages) p GROUP BY 1""",
)
def stream_ingest(spark, d):
    """Pages arrive in two waves; ids stay dense across the waves."""
    folder = scratch_path(spark, "lines")
    out, checkpoint = J.stream_paths(spark, "ingest")
    pages = load(spark, d, "pages").select("page_id", "url")
    for wave in (0, 1):
        pages.filter(F.col("page_id") % 2 == wave).write.mode("append").json(folder)
        J.ingest_corpus(spark, folder, "page_id bigint, url string", ["page_id"], out, checkpoint, start=1000)
    return spark.read.parquet(out).groupBy((F.col("page_id") % 2).alias("wave")).agg(
        F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.count_distinct("id").alias("n_ids")
    )


@query(
    "stream_metrics",
    f"WITH {BM25_SQL}, {METRIC_SQL} SELECT round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, count(*) AS n_queries FROM pq",
)
def stream_metrics(spark, d):
    """Per-query results arrive in two waves; the running sums give the overall MAP and MRR."""
    folder = scratch_path(spark, "scored")
    out, checkpoint = J.stream_paths(spark, "metrics")
    found = materialize(M.per_query_metrics(judged_hits(spark, d), "doc_id"), "per-query")
    for wave in (0, 1):
        found.filter(F.col("query_id") % 2 == wave).select("query_id", "ap", "rr").write.mode("append").parquet(folder)
        stream = spark.readStream.schema("query_id bigint, ap double, rr double").parquet(folder)
        J.accumulate_metrics(stream, out, checkpoint)
    return M.merge_chunks(spark.read.parquet(out))
