"""The device monitor as a stream: late and out-of-order readings give what the batch version gives."""

import random

from pyspark.sql import functions as F

from tableseek.operators.states import free_streaks, state_changes
from tableseek.session import scratch_path
from tableseek.streaming import jobs

SCHEMA = "host bigint, ts timestamp, event_id bigint, state string"


def frame(spark, rows):
    raw = spark.createDataFrame(rows, "host bigint, s bigint, event_id bigint, state string")
    # not from the epoch itself, where the first watermark stands
    return raw.select("host", F.timestamp_seconds(F.col("s") + 100_000).alias("ts"), "event_id", "state")


def waves_of(spark, waves, watch, label):
    """Runs the watcher after each wave of files, restarting it, and ends with a heartbeat."""
    folder, beats = scratch_path(spark, "waves"), scratch_path(spark, "beats")
    out, checkpoint = jobs.stream_paths(spark, label)
    spark.createDataFrame([], "ts timestamp").write.parquet(beats)
    with jobs.rocksdb_state(spark):
        for wave in [*waves, None]:
            if wave is None:
                spark.sql("SELECT timestamp_seconds(10000000) AS ts").write.mode("append").parquet(beats)
            else:
                frame(spark, wave).coalesce(1).write.mode("append").parquet(folder)
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
            jobs.run_to_parquet(watch(jobs.with_heartbeats(stream, beats)), out, checkpoint)
    return spark.read.parquet(out).filter(F.col("host") != jobs.HEARTBEAT_HOST)


def test_state_survives_restarts_and_reminds(spark, collect_rows):
    waves = [[(0, 0, 0, "busy"), (0, 600, 1, "free")], [(0, 1200, 2, "free"), (0, 8000, 3, "free"), (0, 9000, 4, "busy")]]
    got = waves_of(spark, waves, lambda s: jobs.watch_states(s, reminder_seconds=3600), "reminders")
    want = [(0, "", "busy", False), (1, "busy", "free", False), (3, "free", "free", True), (4, "free", "busy", False)]
    assert collect_rows(got, "event_id", F.coalesce("previous", F.lit("")), "state", "reminder") == want
    assert spark.conf.get(jobs.STATE_STORE) != jobs.ROCKSDB


def test_late_readings_find_their_place(spark, collect_rows):
    """Within the delay the order of arrival does not matter, across files and restarts."""
    draw = random.Random(5)
    rows = [(draw.randrange(3), 60 * i, i, draw.choice(["free", "free", "busy", "error"])) for i in range(200)]
    late = sorted(rows, key=lambda r: r[1] + draw.randrange(3000))
    waves = [late[:90], late[90:150], late[150:]]
    got = waves_of(spark, waves, lambda s: jobs.watch_states(s, delay="1 hour"), "late")
    want = state_changes(frame(spark, rows))
    columns = ["host", "event_id", F.coalesce("previous", F.lit("")), "state"]
    assert collect_rows(got, *columns) == collect_rows(want, *columns)
    flagged = lambda s: s.select("host", "ts", "event_id", (F.col("state") == "free").alias("free"))
    streaks = waves_of(spark, waves, lambda s: jobs.watch_streaks(flagged(s), k=2, delay="1 hour"), "streaks")
    assert collect_rows(streaks, "host", "event_id") == collect_rows(free_streaks(flagged(frame(spark, rows)), k=2), "host", "event_id")


def test_nothing_is_told_before_the_watermark(spark):
    """A reading that may still be preceded by another one waits."""
    folder, beats = scratch_path(spark, "waves"), scratch_path(spark, "beats")
    out, checkpoint = jobs.stream_paths(spark, "early")
    spark.createDataFrame([], "ts timestamp").write.parquet(beats)
    frame(spark, [(0, 0, 0, "busy"), (0, 7200, 1, "free")]).coalesce(1).write.parquet(folder)
    with jobs.rocksdb_state(spark):
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        jobs.run_to_parquet(jobs.watch_states(jobs.with_heartbeats(stream, beats), delay="1 hour"), out, checkpoint)
    assert [r.event_id for r in spark.read.parquet(out).collect()] == [0]


def test_consumer_ends_after_the_marker(spark):
    from tableseek.sources.writers import StagedWriter

    folder, marker = scratch_path(spark, "shards"), scratch_path(spark, "marker")
    out, checkpoint = jobs.stream_paths(spark, "consumer")
    spark.range(3).write.parquet(folder)
    producer = StagedWriter(spark, marker, {"seed": "1"})
    producer.write("wave", {"waves": spark.range(1)})
    producer.finish(["wave"])
    jobs.consume_until_complete(spark, folder, "id bigint", out, checkpoint, {"seed": "1"}, marker)
    assert spark.read.parquet(out).count() == 3
