"""Keyed folds as stateful stream operators, sharing their logic with the batch folds."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netwarden.functions.folds import Fold
from netwarden.session import ROCKSDB_PROVIDER

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class KeyedFold(StatefulProcessor):
    """Runs ``fold`` on each micro-batch of a key, with its state kept between batches."""

    def __init__(self, keys, key_names, order, fold, state, state_names, outputs, ttl_ms):
        self.key_names, self.order, self.fold = key_names, order, fold
        self.schema, self.state_names, self.outputs, self.ttl_ms = state, state_names, outputs, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable").reset_index(drop=True)
        previous = dict(zip(self.state_names, self.state.get())) if self.state.exists() else None
        out, new = self.fold(batch, previous)
        self.state.update(tuple(new[n] for n in self.state_names))
        out = out.copy()
        for name, value in zip(self.key_names, key):
            out[name] = value
        yield out[[*self.key_names, *self.outputs]]

    def close(self) -> None:
        pass


def use_rocksdb(df: DataFrame) -> None:
    """The only store that keyed processors run on."""
    conf = df.sparkSession.conf
    if conf.get(PROVIDER, "") != ROCKSDB_PROVIDER:
        conf.set(PROVIDER, ROCKSDB_PROVIDER)


class PredecessorWithin(StatefulProcessor):
    """Tells of every row of a key whether another row lies within ``width`` microseconds before it, by event time.

    A key is (key, span), a span being ``width`` long, so a row's predecessor lies in its own span or the one before. Rows are (t, id, own): a row
    that is not ``own`` comes from the span before, of which only the last time counts. Own rows wait until the watermark has passed them: all
    earlier rows have come by then, in whatever order, so the answers are those of a batch. State lives until the watermark has passed the span.
    """

    def __init__(self, width: int, key_name: str, id_name: str):
        self.width, self.key_name, self.id_name = width, key_name, id_name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("t", T.LongType()), T.StructField("id", T.LongType())]))
        self.last = handle.getValueState("last", T.StructType([T.StructField("t", T.LongType())]))

    def answered(self, key, rows: list[tuple[int, int]], last: int | None, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Answers for what the watermark has passed; the rest goes on waiting."""
        rows.sort()
        n = bisect.bisect_right(rows, watermark_ms * 1000, key=lambda r: r[0])
        if n:
            times = [t for t, _ in rows[:n]]
            before = [last, *times[:-1]]
            repeat = [b is not None and t - b <= self.width for t, b in zip(times, before)]
            last = times[-1]
            yield pd.DataFrame({self.key_name: [key[0]] * n, self.id_name: [i for _, i in rows[:n]], "repeat": repeat})
        if last is not None:
            self.last.update((last,))
        if n < len(rows):
            self.waiting.put(rows[n:])
            self.handle.registerTimer(rows[n][0] // 1000 + 1)
        else:
            self.waiting.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        own = batch["own"].to_numpy(bool)
        last = self.last.get()[0] if self.last.exists() else None
        seen = batch["t"].to_numpy()[~own]
        if len(seen):
            last = int(seen.max()) if last is None else max(last, int(seen.max()))
        known = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        known += list(zip(batch["t"][own].tolist(), batch["id"][own].tolist()))
        self.handle.registerTimer((key[1] + 1) * self.width // 1000 + 1)
        yield from self.answered(key, known, last, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        last = self.last.get()[0] if self.last.exists() else None
        if self.waiting.exists():
            yield from self.answered(key, [tuple(r) for r in self.waiting.get()], last, watermark)
        if watermark * 1000 >= (key[1] + 1) * self.width:
            self.last.clear()

    def close(self) -> None:
        pass


def predecessor_within(rows: DataFrame, key: str, row_id: str, event_time: str, width: int) -> DataFrame:
    """(key, row_id, repeat) for every row of a stream with a watermark on ``event_time``, once the watermark has passed it."""
    use_rocksdb(rows)
    t = F.unix_micros(event_time)
    placed = rows.select(F.col(key), F.col(row_id).cast("long").alias("id"), F.col(event_time), t.alias("t"), F.floor(t / width).alias("own_span"))
    placed = placed.select("*", F.explode(F.array(F.col("own_span"), F.col("own_span") + 1)).alias("span")).withColumn("own", F.col("span") == F.col("own_span"))
    kind = rows.schema[key].dataType.simpleString()
    return placed.drop("own_span").groupBy(key, "span").transformWithStateInPandas(
        statefulProcessor=PredecessorWithin(width, key, row_id), outputStructType=T.StructType.fromDDL(f"`{key}` {kind}, `{row_id}` long, repeat boolean"),
        outputMode="Append", timeMode="EventTime",
    )


def stream_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fold: Fold, output: str, state: str, ttl_ms: int | None = None
) -> DataFrame:
    """Streaming counterpart of ``run_fold``; ``ttl_ms`` forgets idle keys (processing time)."""
    use_rocksdb(df)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = lambda ddl: [p.split()[0] for p in ddl.split(", ")]
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], output])
    processor = KeyedFold(None, list(keys), list(order), fold, T.StructType.fromDDL(state), names(state), names(output), ttl_ms)
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=T.StructType.fromDDL(schema), outputMode="Append",
        timeMode="ProcessingTime" if ttl_ms else "None",
    )
