"""Structured Streaming jobs: monitor, shard consumer, ingest and running metrics."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tableseek.operators.ranking import global_ids
from tableseek.session import scratch_path
from tableseek.sources.writers import StagedWriter, is_complete, table_exists

HEARTBEAT_HOST = -(2**62)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available now, append to Parquet, stop. Restarts resume."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    query = (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which stateful processors need; the setting is put back."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)


class InOrder(StatefulProcessor):
    """Hands a key's readings to ``step`` in event order, across micro-batches.

    Readings wait until the watermark has passed them; an event-time timer at the earliest one wakes the key. State is
    the waiting readings, which the watermark's delay bounds, and one carried value. ``step`` takes (key, carried,
    ts, event_id, value) and returns the new carried value and an output row or None.
    """

    def __init__(self, value: str, value_type: str, carried: str, columns: list[str], step: Callable):
        self.value, self.value_type, self.carried_type, self.columns, self.step = value, value_type, carried, columns, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at bigint, event_id bigint, value {self.value_type}")
        self.carried = handle.getValueState("carried", self.carried_type)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            micros = frame["ts"].astype("datetime64[us]").astype("int64")
            native = [None if pd.isna(v) else (v.item() if hasattr(v, "item") else v) for v in frame[self.value]]
            self.waiting.appendList(list(zip(micros.tolist(), frame["event_id"].tolist(), native)))
            first = int(micros.min())
            earliest = first if earliest is None else min(first, earliest)
        if earliest is not None:
            self.handle.registerTimer(earliest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        ready = [r for r in waiting if r[0] < passed]
        rest = waiting[len(ready) :]
        carried, found = self.carried.get() if self.carried.exists() else None, []
        for at, event_id, value in ready:
            carried, row = self.step(key[0], carried, at, event_id, value)
            if row is not None:
                found.append(row)
        if ready:
            self.carried.update(carried)
            self.waiting.clear()
            if rest:
                self.waiting.appendList([tuple(r) for r in rest])
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        if found:
            out = pd.DataFrame(found, columns=self.columns)
            out["ts"] = pd.to_datetime(out["ts"], unit="us")
            yield out

    def close(self) -> None:
        pass


def _in_order(readings: DataFrame, delay: str, processor: InOrder, schema: str) -> DataFrame:
    keyed = readings.filter("host IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp_ntz").cast("timestamp"))
    return keyed.withWatermark("ts", delay).groupBy("host").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def watch_states(readings: DataFrame, reminder_seconds: int = 0, notify_first: bool = True, delay: str = "1 hour") -> DataFrame:
    """Alerts per host when its state changes, and reminders while it does not.

    Input readings(host, ts, event_id, state); an error is a state like any other. A reminder needs an earlier
    notification. Readings count in event order, however they arrive within ``delay``; later ones are dropped. An alert
    appears once the watermark has passed its reading.
    """

    def step(host, carried, at, event_id, state):
        last, notified = carried if carried is not None else (None, None)
        changed = last != state and (last is not None or notify_first)
        due = reminder_seconds > 0 and notified is not None and at - notified >= reminder_seconds * 1_000_000
        row = (host, at, event_id, last, state, not changed) if changed or due else None
        return (state, at if row else notified), row

    columns = ["host", "ts", "event_id", "previous", "state", "reminder"]
    processor = InOrder("state", "string", "last string, notified bigint", columns, step)
    return _in_order(readings, delay, processor, "host bigint, ts timestamp, event_id bigint, previous string, state string, reminder boolean")


def watch_streaks(readings: DataFrame, k: int = 3, delay: str = "1 hour") -> DataFrame:
    """Readings(host, ts, event_id, free) at which the k-th consecutive free reading arrives, in event order."""

    def step(host, carried, at, event_id, free):
        streak = (carried[0] if carried is not None else 0) + 1 if free else 0
        return (streak,), (host, at, event_id, streak) if streak == k else None

    processor = InOrder("free", "boolean", "streak bigint", ["host", "ts", "event_id", "streak"], step)
    return _in_order(readings, delay, processor, "host bigint, ts timestamp, event_id bigint, streak bigint")


def with_heartbeats(readings: DataFrame, folder: str) -> DataFrame:
    """The stream together with heartbeats, files (ts) in ``folder``: they move the watermark and have a host of their own.

    A source that has ended needs one heartbeat beyond its last reading, or the readings of the last ``delay`` wait on.
    """
    beats = readings.sparkSession.readStream.schema("ts timestamp").parquet(folder)
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in readings.schema if f.name not in ("ts", "host", "event_id")]
    ts_type = dict(readings.dtypes)["ts"]
    beats = beats.select(F.lit(HEARTBEAT_HOST).cast(dict(readings.dtypes)["host"]).alias("host"), F.col("ts").cast(ts_type).alias("ts"), F.lit(0).cast("bigint").alias("event_id"), *others)
    return readings.unionByName(beats.select(*readings.columns))


def watch_to_the_end(readings: DataFrame, watch: Callable[[DataFrame], DataFrame], last: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs ``watch`` over all that has arrived, then once more with a heartbeat at ``last`` (ts), and reads the result."""
    spark = readings.sparkSession
    beats = f"{checkpoint}-beats"
    last.filter("false").select(F.col("ts").cast("timestamp").alias("ts")).write.parquet(beats)
    with rocksdb_state(spark):
        stream = watch(with_heartbeats(readings, beats))
        run_to_parquet(stream, out, checkpoint)
        last.select(F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(beats)
        run_to_parquet(watch(with_heartbeats(readings, beats)), out, checkpoint)
    return spark.read.parquet(out).filter(F.col("host") != HEARTBEAT_HOST)


def consume_shards(
    spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, expected: dict[str, str] | None = None, marker: str | None = None
) -> None:
    """Take every closed shard file once; the producer's parameters are compared before each micro-batch.

    Writers publish shards by rename, so a listed file is complete. The checkpoint
    remembers consumed files across restarts. ``marker`` is the producer's staged output.
    """
    shards = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(folder)

    def take(batch: DataFrame, batch_id: int) -> None:
        if expected is not None and marker is not None:
            StagedWriter(spark, marker, expected)
        # One folder per batch id: a retried batch replaces its own output.
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_batches(shards, take, checkpoint)


def consume_until_complete(
    spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, expected: dict[str, str], marker: str, wait_seconds: float = 30
) -> None:
    """Consumes until the producer's output is complete, and once more after that is seen, so no late shard is missed."""
    while True:
        complete = is_complete(spark, marker)
        consume_shards(spark, folder, schema, out, checkpoint, expected, marker)
        if complete:
            return
        time.sleep(wait_seconds)


def ingest_corpus(spark: SparkSession, folder: str, schema: str, order: list[str], out: str, checkpoint: str, start: int = 0) -> None:
    """Append arriving JSON lines to a corpus with dense ids that continue across batches."""
    lines = spark.readStream.schema(schema).json(folder)

    def append(batch: DataFrame, batch_id: int) -> None:
        taken = 0
        if table_exists(spark, out):
            taken = spark.read.parquet(out).filter(F.col("batch") < batch_id).count()
        numbered = global_ids(batch, order, start + taken)
        numbered.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_batches(lines, append, checkpoint)


def accumulate_metrics(per_query: DataFrame, out: str, checkpoint: str) -> None:
    """Running MAP and MRR over a stream of per-query rows(ap, rr) as additive sums."""
    sums = per_query.agg(F.sum("ap").alias("ap_sum"), F.sum("rr").alias("rr_sum"), F.count("*").alias("n_queries"))
    run_batches(sums, lambda batch, _: batch.write.mode("overwrite").parquet(out), checkpoint, mode="complete")


def stream_paths(spark: SparkSession, label: str) -> tuple[str, str]:
    """Output folder and checkpoint folder of one streaming run, both in the shared folder."""
    return scratch_path(spark, f"{label}-out"), scratch_path(spark, f"{label}-checkpoint")
