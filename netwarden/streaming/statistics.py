"""Statistics of detection runs while they run: records read, alerts emitted and suppressed, rates and seconds of every part."""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from netwarden.operators.alerts import is_emitted

NAME = "run_statistics"
COUNTS = ("records_read", "alerts_emitted", "alerts_suppressed")
#: Parts of a micro-batch and what the engine calls their steps.
PARTS = {
    "source_seconds": ("latestOffset", "getBatch"), "planning_seconds": ("queryPlanning",),
    "processing_seconds": ("addBatch",), "commit_seconds": ("walCommit", "commitOffsets", "commitBatch"),
}
SCHEMA = ", ".join(["run_id string", "batch_id long", *[f"{c} long" for c in COUNTS], *[f"{p} double" for p in PARTS], "total_seconds double", "records_per_second double"])


def counts(min_confidence: float = 0.0, emit_normal: bool = False) -> list[Column]:
    """What a run counts over its scored records."""
    emitted = F.coalesce(is_emitted(min_confidence, emit_normal), F.lit(False))
    return [F.count(F.lit(1)).alias(COUNTS[0]), F.count_if(emitted).alias(COUNTS[1]), F.count_if(~emitted).alias(COUNTS[2])]


def observed(scored: DataFrame, min_confidence: float = 0.0, emit_normal: bool = False, to: Observation | str = NAME) -> DataFrame:
    """``scored``, counted as it passes by: into an ``Observation`` in a batch, into the progress of a stream."""
    return scored.observe(to, *counts(min_confidence, emit_normal))


class RunStatistics(StreamingQueryListener):
    """One row for each micro-batch of the streams that are ``observed``; the last ``keep`` are held."""

    def __init__(self, name: str = NAME, keep: int = 10_000):
        self.name, self.rows, self.ended, self.change = name, deque(maxlen=keep), set(), threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        seen = progress.observedMetrics.get(self.name)
        if seen is None:
            return
        spent = {k: v / 1000.0 for k, v in progress.durationMs.items()}
        parts = [sum(spent.get(step, 0.0) for step in steps) for steps in PARTS.values()]
        total = spent.get("triggerExecution", sum(parts))
        read = seen["records_read"]
        row = (str(progress.runId), progress.batchId, *[seen[c] for c in COUNTS], *parts, total, read / total if total > 0 else 0.0)
        with self.change:
            self.rows.append(row)

    def onQueryTerminated(self, event) -> None:
        with self.change:
            self.ended.add(str(event.runId))
            self.change.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until what the ended ``query`` told has arrived; the engine tells it aside from the run."""
        with self.change:
            self.change.wait_for(lambda: str(query.runId) in self.ended, seconds)

    def table(self, spark: SparkSession) -> DataFrame:
        with self.change:
            rows = list(self.rows)
        return spark.createDataFrame(rows, SCHEMA)


def totals(statistics: DataFrame) -> DataFrame:
    """All micro-batches of a run in one row, with the rate over its whole time."""
    summed = statistics.groupBy("run_id").agg(F.count(F.lit(1)).alias("batches"), *[F.sum(c).alias(c) for c in (*COUNTS, *PARTS, "total_seconds")])
    return summed.withColumn("records_per_second", F.when(F.col("total_seconds") > 0, F.col("records_read") / F.col("total_seconds")).otherwise(0.0))


def stage_seconds(stages: Sequence[tuple[str, DataFrame]]) -> list[tuple[str, float]]:
    """Seconds that each of a batch run's stages adds; ``stages`` lists (name, what the run is up to there).

    Stages of one job overlap, so each prefix runs by itself, into nothing, and the difference to the one before it counts.
    """
    out, before = [], 0.0
    for name, df in stages:
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        spent = time.perf_counter() - start
        out.append((name, max(0.0, spent - before)))
        before = max(before, spent)
    return out


def batch_run(scored: DataFrame, write, stages: Sequence[tuple[str, DataFrame]] = (), min_confidence: float = 0.0, emit_normal: bool = False) -> dict:
    """Write the alerts of a batch with ``write(alerts)`` and return what was counted on the way, the rate, and the seconds of ``stages``."""
    seen = Observation(NAME)
    start = time.perf_counter()
    write(observed(scored, min_confidence, emit_normal, seen).filter(is_emitted(min_confidence, emit_normal)))
    spent = time.perf_counter() - start
    return {**seen.get, "total_seconds": spent, "records_per_second": seen.get[COUNTS[0]] / spent, **{f"{n}_seconds": s for n, s in stage_seconds(stages)}}
