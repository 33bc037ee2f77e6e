"""Streams must not depend on how their rows are dealt out to micro-batches."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF, rows
from netwarden.streaming import jobs
from oracle_check import compare, connect

NAMES = ["stream_sessions", "stream_alert_counts", "stream_fresh_uses", "stream_replay_flags", "stream_reputation", "stream_drift", "stream_trust", "stream_repeat_incidents", "stream_chained_log", "stream_run_statistics"]


@pytest.fixture(scope="module")
def dealt(tmp_path_factory):
    """The events in four files by time, each a micro-batch of its own."""
    folder = tmp_path_factory.mktemp("dealt")
    events = duckdb.sql(f"SELECT * FROM '{SF}/events.parquet' ORDER BY ts, event_id").to_arrow_table()
    size = -(-events.num_rows // 4)
    for k in range(4):
        target = folder / (f"part{k}" if k else "")
        target.mkdir(exist_ok=True)
        pq.write_table(events.slice(k * size, size), target / "events.parquet")
        os.utime(target / "events.parquet", (1_700_000_000 + 60 * k,) * 2)
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_four_batches_give_the_oracle_rows(spark, dealt, name):
    problem = compare(entry.queries()[name](spark, dealt), connect(SF), entry.oracle_sql()[name])
    assert problem is None, problem


def uses(spark, folder, batches):
    """(event_id, seconds) per batch as a stream of nonce uses."""
    for k, batch in enumerate(batches):
        table = pa.table({"event_id": [e for e, _ in batch], "s": [s for _, s in batch]}, pa.schema([("event_id", pa.int64()), ("s", pa.int64())]))
        pq.write_table(table, folder / f"b{k}.parquet")
        os.utime(folder / f"b{k}.parquet", (1_700_000_000 + 60 * k,) * 2)
    stream = spark.readStream.schema("event_id long, s long").option("maxFilesPerTrigger", 1).parquet(str(folder))
    return stream.select("event_id", F.timestamp_seconds("s").alias("ts"), F.lit("a").alias("agent_id"), F.lit("n").alias("nonce"))


def test_late_uses(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    flags = jobs.replay_flags(uses(spark, source, [[(1, 1000)], [(2, 900), (3, 100)], [(4, 1250), (5, 1400)]]), seconds=300)
    got = jobs.run_available(flags, str(tmp_path / "out")).select("event_id", "replay")
    assert rows(got) == [(1, False), (2, True), (3, False), (4, True), (5, False)]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    timed = uses(spark, source, [[(1, 100_000)], [(2, 200_000)], [(3, 100), (4, 200_100)]]).withColumn("attack_type", F.lit("x"))
    counts = jobs.alert_counts(timed)
    query = counts.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert jobs.late_rows(query) == 1
    assert rows(spark.read.parquet(str(tmp_path / "rows")).select("n")) == [(1,)]


@pytest.fixture(scope="module")
def shuffled(tmp_path_factory):
    """The events in four files in no order."""
    folder = tmp_path_factory.mktemp("shuffled")
    events = duckdb.sql(f"SELECT * FROM '{SF}/events.parquet' ORDER BY md5(event_id::VARCHAR)").to_arrow_table()
    size = -(-events.num_rows // 4)
    for k in range(4):
        target = folder / (f"part{k}" if k else "")
        target.mkdir(exist_ok=True)
        pq.write_table(events.slice(k * size, size), target / "events.parquet")
        os.utime(target / "events.parquet", (1_700_000_000 + 60 * k,) * 2)
    return str(folder)


def test_repeat_incidents_of_shuffled_files(spark, shuffled):
    name = "stream_repeat_incidents"
    problem = compare(entry.queries()[name](spark, shuffled), connect(SF), entry.oracle_sql()[name])
    assert problem is None, problem


def incidents(spark, folder, batches, **options):
    """Flags of the incidents of one source, (event_id, seconds) per batch."""
    source = folder / "in"
    source.mkdir()
    alerts = uses(spark, source, batches).select(F.col("event_id").alias("alert_id"), "ts", F.lit("s").alias("source_id"))
    closing = jobs.Closing(alerts, str(folder / "end"))
    return rows(jobs.run_available(jobs.repeat_incidents(closing.stream, **options), str(folder / "out"), closing=closing).select("alert_id", "repeat"))


def test_late_incidents_get_the_batch_rule(spark, tmp_path):
    batches = [[(1, 100_000)], [(2, 90_000)], [(3, 100_600)], [(4, 101_800), (5, 99_000)], [(6, 88_300), (7, 200_000), (8, 200_000), (9, 86_400)]]
    want = [(1, True), (2, True), (3, True), (4, True), (5, False), (6, False), (7, False), (8, True), (9, False)]
    # 99,000 precedes 100,000 by less than 30 minutes, 88,300 precedes 90,000 by less and follows 86,400 by more; of equal times the first is fresh.
    assert incidents(spark, tmp_path, batches, watermark="2 days") == want


def test_incidents_behind_the_watermark_are_left_out(spark, tmp_path):
    got = incidents(spark, tmp_path, [[(1, 100_000)], [(2, 100_500), (3, 300_000)], [(5, 299_700)], [(4, 100_900)], [(6, 301_000)]], watermark="10 minutes")
    assert got == [(1, False), (2, True), (3, True), (5, False), (6, True)]
