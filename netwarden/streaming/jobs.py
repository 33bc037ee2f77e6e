"""Structured Streaming jobs. Late data: 10-minute watermark unless the caller says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from netwarden.constants import EMA_ALPHA, REJECT_BELOW_TRUST
from netwarden.functions.ordered import micros
from netwarden.operators import alerts as alert_ops, audit, detector, features
from netwarden.operators.analytics import fresh_detector, page_hinkley_step
from netwarden.operators.flows import add_flow_key
from netwarden.streaming import statistics
from netwarden.streaming.state import predecessor_within, stream_fold

WATERMARK = "10 minutes"
#: A time after all records, from which a bounded source is over; nanoseconds in 64 bits reach it.
END_OF_TIME = "2250-01-01 00:00:00"


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1) -> DataFrame:
    """A folder's table as a file stream, with the schema of its files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def run_available(stream: DataFrame, path: str, partition_by: Sequence[str] = (), closing: Closing | None = None) -> DataFrame:
    """Process everything there is into parquet below ``path`` and read it back.

    With ``closing`` the source counts as ended: what is still open (sessions, windows) is closed and written as well.
    """
    def run() -> None:
        query = (
            stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
            .outputMode("append").trigger(availableNow=True).partitionBy(*partition_by).start()
        )
        query.awaitTermination()

    run()
    if closing is not None:
        closing.write()
        run()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


class Closing:
    """The end of a bounded source: one row without values, at a time after all others, in a folder that is read along with it.

    The row moves the watermark past everything that is open; its own window or session never closes.
    """

    def __init__(self, source: DataFrame, folder: str, ts: str = "ts"):
        self.spark, self.folder, self.ts, self.schema = source.sparkSession, folder, ts, source.schema
        self.spark.createDataFrame([], self.schema).write.parquet(folder)
        self.stream = source.unionByName(self.spark.readStream.schema(self.schema).parquet(folder))

    def write(self) -> None:
        last = F.lit(END_OF_TIME).cast(self.schema[self.ts].dataType).alias(self.ts)
        row = [last if f.name == self.ts else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        self.spark.range(1).select(*row).write.mode("append").parquet(self.folder)


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were dropped, over the query's known progress."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def detect_alerts(
    records: DataFrame, model: features.FeatureModel, classifier, min_confidence: float = 0.0, emit_normal: bool = False
) -> DataFrame:
    """Record stream -> frozen encoding -> prediction -> alerts, counted for ``statistics.RunStatistics`` on the way."""
    scored = detector.predict(features.encode(records, model), classifier)
    named = scored.withColumn("attack_type", detector.class_name(F.col("class_index"), model.classes)).drop("features", "class_index")
    return alert_ops.emit_alerts(statistics.observed(named, min_confidence, emit_normal), min_confidence, emit_normal)


def live_sessions(records: DataFrame, ts: str = "ts", gap: str = "30 seconds", columns: Sequence[str] | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Closed inactivity sessions per flow."""
    keyed = add_flow_key(records.withColumn("event_time", F.col(ts).cast("timestamp")), columns)
    return (
        keyed.withWatermark("event_time", watermark)
        .groupBy("flow_key", F.session_window("event_time", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))
        .drop("w")
    )


def alert_counts(alerts: DataFrame, ts: str = "ts", length: str = "1 hour", slide: str | None = None, watermark: str = WATERMARK) -> DataFrame:
    """Alerts per type and tumbling or sliding window."""
    timed = alerts.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", watermark)
    return timed.groupBy(F.window("event_time", length, slide or length).alias("w"), "attack_type").agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.col("w.start").alias("window_start"), "attack_type", "n")


def fresh_uses(uses: DataFrame, row_id: str = "event_id", ts: str = "ts", seconds: float = 300.0) -> DataFrame:
    """Uses of a nonce that are no replay, by the rule of ``replay_flags``."""
    return replay_flags(uses, row_id, ts, seconds).filter("NOT replay").drop("replay")


def replay_flags(uses: DataFrame, row_id: str = "event_id", ts: str = "ts", seconds: float = 300.0, idle_seconds: float | None = None) -> DataFrame:
    """Exact replay rule on a stream: the window runs from the last recorded use.

    A use that comes late is a replay if it is within the window before the recorded one, and is otherwise fresh without
    becoming the recorded use. With ``idle_seconds`` a nonce is forgotten after that much processing time without a use: a job
    that runs for ever should give the window and some minutes; a job over what is available must not, as it would wait for timers.
    """
    width = int(seconds * 1_000_000)

    def fold(rows: pd.DataFrame, state: dict | None):
        used, flags = (state["used"] if state else None), []
        for at in rows["t"]:
            replay = used is not None and abs(at - used) <= width
            flags.append(replay)
            if not replay:
                used = int(at) if used is None else max(used, int(at))
        return rows[[row_id]].assign(replay=flags), {"used": used}

    keyed = uses.select("agent_id", "nonce", row_id, micros(ts).alias("t"))
    return stream_fold(keyed, ["agent_id", "nonce"], ["t", row_id], fold, f"{row_id} long, replay boolean", "used long", None if idle_seconds is None else int(idle_seconds * 1000))


def running_reputation(entries: DataFrame, recent: int = 5, penalty: float = 0.15) -> DataFrame:
    """Reputation of each agent after every micro-batch it appears in."""

    def fold(rows: pd.DataFrame, state: dict | None):
        last = [float(x) for x in state["last"].split(",") if x] if state else []
        seen, bad = (state["seen"], state["bad"]) if state else (0, 0)
        seen += len(rows)
        bad += int((~rows["accepted"].astype(bool)).sum())
        last = (last + [float(x) for x in rows["trust_value"] if pd.notna(x)])[-recent:]
        score = (sum(last) / len(last) if last else 0.0) - penalty * bad
        out = pd.DataFrame({"sequence": [int(rows["sequence"].iloc[-1])], "interactions": [seen], "violations": [bad], "reputation": [score]})
        return out, {"last": ",".join(repr(x) for x in last), "seen": int(seen), "bad": int(bad)}

    known = entries.filter(F.col("agent_id").isNotNull()).select("agent_id", "sequence", "accepted", "trust_value")
    return stream_fold(
        known, ["agent_id"], ["sequence"], fold, "sequence long, interactions long, violations long, reputation double",
        "last string, seen long, bad long",
    )


def running_drift(scores: DataFrame, keys: Sequence[str], order: str, value: str, delta: float = 0.005, limit: float = 1.0) -> DataFrame:
    """Page-Hinkley alarms as they happen."""

    def fold(rows: pd.DataFrame, state: dict | None):
        state = dict(state) if state else fresh_detector()
        alarms = [page_hinkley_step(state, float(x), delta, limit) for x in rows[value]]
        state["n"] = int(state["n"])
        return rows.loc[alarms, [order]], state

    return stream_fold(
        scores.select(*keys, order, value), keys, [order], fold, f"{order} long", "n long, mean double, total double, low double"
    )


def running_trust(scores: DataFrame, key: str, order: str, value: str, alpha: float = EMA_ALPHA, reject_below: float = REJECT_BELOW_TRUST) -> DataFrame:
    """Smoothed trust after every score, starting at 1."""

    def fold(rows: pd.DataFrame, state: dict | None):
        trust, out = (state["trust"] if state else 1.0), []
        for x in rows[value]:
            trust = alpha * float(x) + (1.0 - alpha) * trust
            out.append(trust)
        return rows[[order]].assign(trust=out, kept=[t >= reject_below for t in out]), {"trust": trust}

    return stream_fold(
        scores.select(key, order, value), [key], [order], fold, f"{order} long, trust double, kept boolean", "trust double"
    )


def repeat_incidents(alerts: DataFrame, alert_id: str = "alert_id", ts: str = "ts", minutes: int = 30, watermark: str = WATERMARK) -> DataFrame:
    """Whether the source had an earlier incident in the window, as the batch rule has it.

    An alert's flag comes when the watermark has passed it, so alerts may come in any order within the watermark; later ones are dropped and
    counted by the query's progress. State is kept per source and window, and forgotten behind the watermark.
    """
    keyed = alerts.select(F.coalesce("source_id", F.lit(alert_ops.UNKNOWN_SOURCE)).alias("source"), alert_id, F.col(ts).cast("timestamp").alias("event_time"))
    return predecessor_within(keyed.withWatermark("event_time", watermark), "source", alert_id, "event_time", minutes * 60 * 1_000_000)


def chained_sink(entries: DataFrame, path: str, checkpoint: str, chain: str = "log_id", order: str = "sequence") -> StreamingQuery:
    """Append micro-batches to hash-chained logs.

    ``entries``: chain, order, canonical. Each batch writes its own folder, so a retried batch
    overwrites itself, and leaves the chain heads for the next one.
    """
    spark = entries.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        heads = None
        if batch_id > 0:
            heads = spark.read.parquet(f"{path}/heads/{batch_id - 1}")
        done = audit.build_chain(batch, chain, [order], "canonical", heads=heads)
        done.write.mode("overwrite").parquet(f"{path}/entries/{batch_id}")
        stored = spark.read.parquet(f"{path}/entries/{batch_id}")
        newest = stored.groupBy(chain).agg(
            F.max("position").alias("position"), F.max_by("entry_hash", "position").alias("entry_hash")
        )
        if heads is not None:
            newest = newest.unionByName(heads.join(newest, chain, "left_anti"))
        newest.write.mode("overwrite").parquet(f"{path}/heads/{batch_id}")

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
