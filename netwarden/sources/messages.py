"""A message log as a stream source: topics of partitions that only grow, read by offset and replayed from any.

A topic is a folder whose files are its partitions: they hold a message a line, only grow, and new ones may come. An offset is the byte behind the last
message taken of every partition, so the query's checkpoint says where it goes on; a batch that is run again reads the same ranges and gives the same rows. Only whole lines are taken: a
message that is still being written waits for its end. A batch takes at most ``maxBytesPerTrigger`` of every partition, and one message at least.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from netwarden.sources import ranges

FORMAT = "message_log"
SCHEMA = "partition string, offset long, value string"
BYTES_PER_TRIGGER = 64 << 20
#: Bytes of a task's range; lines across a border belong to the range in which they begin.
RANGE_BYTES = 16 << 20


def line_end(path: str, start: int, stop: int, piece: int = 1 << 16) -> int | None:
    """The place behind the last line end in a range, read from its end."""
    with ranges.opened(path) as handle:
        at = stop
        while at > start:
            begin = max(start, at - piece)
            handle.seek(begin)
            found = handle.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return None


def next_line_end(path: str, start: int, stop: int) -> int | None:
    """The place behind the first line end in a range."""
    at = start
    for piece in ranges.chunks(path, start, stop, 1 << 16):
        found = piece.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(piece)
    return None


class Lines(InputPartition):
    def __init__(self, path: str, name: str, start: int, stop: int, end: int, first: bool):
        super().__init__((name, start))
        self.path, self.name, self.start, self.stop, self.end, self.first = path, name, start, stop, end, first


def lines_of(path: str, start: int, stop: int, end: int, first: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in a range; the last one may end behind it, before ``end``."""
    at, rest = start, b""
    if not first:  # the line that the byte before the range belongs to began in the range before
        behind = next_line_end(path, start - 1, end)
        if behind is None or behind >= stop:
            return
        at = behind
    for piece in ranges.chunks(path, at, end):
        rest += piece
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if at >= stop:
                return
            yield at, line
            at += len(line) + 1
        if at >= stop:
            return


class MessageReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options.get("maxbytespertrigger", BYTES_PER_TRIGGER))
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.progress = options.get("progresspath")
        self.taken = self.remembered()
        self.offered: dict[str, int] | None = None

    def remembered(self) -> dict[str, int]:
        """What the last reader of the query knew to be taken; nothing where it was the first."""
        try:
            return json.loads(b"".join(ranges.chunks(self.progress))) if self.progress else {}
        except FileNotFoundError:
            return {}

    def files(self) -> dict[str, tuple[str, int]]:
        return {path[len(self.path.rstrip("/")) + 1 :]: (path, size) for path, size in ranges.files_of(self.path)}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """What the next batch may take beyond what is taken. An offer that was not read had been taken before the reader began."""
        if self.offered is not None:
            self.taken = self.offered
        after = dict(self.taken)
        for name, (path, size) in self.files().items():
            start = after.get(name, 0)
            limit = min(size, start + self.most)
            end = line_end(path, start, limit) or (next_line_end(path, limit, size) if limit < size else None)
            if end is not None:
                after[name] = end
        self.offered = after
        return after

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        """Ranges between two offsets of the engine, whose word on what is taken is the only one that counts."""
        self.taken, self.offered = dict(end), None
        out = []
        files = self.files()
        for name, stop in sorted(end.items()):
            begin = start.get(name, 0)
            for at in range(begin, stop, self.range_bytes):
                out.append(Lines(files[name][0], name, at, min(at + self.range_bytes, stop), stop, at == begin))
        return out

    def read(self, partition: Lines) -> Iterator[pa.RecordBatch]:
        offsets, values = [], []

        def batch() -> pa.RecordBatch:
            text = pa.array([v.decode("utf-8", "replace") for v in values])
            return pa.RecordBatch.from_arrays([pa.array([partition.name] * len(values)), pa.array(offsets, pa.int64()), text], ["partition", "offset", "value"])

        for at, line in lines_of(partition.path, partition.start, partition.stop, partition.end, partition.first):
            offsets.append(at)
            values.append(line)
            if len(values) == 10_000:
                yield batch()
                offsets, values = [], []
        if values:
            yield batch()

    def commit(self, end: dict) -> None:
        if self.progress:
            ranges.written(self.progress, json.dumps(end).encode())


class MessageLog(DataSource):
    """``spark.readStream.format("message_log")`` with the options ``path``, ``maxBytesPerTrigger``, ``rangeBytes`` and ``progressPath``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> MessageReader:
        return MessageReader(self.options)


def read_messages(spark: SparkSession, path: str, bytes_per_trigger: int = BYTES_PER_TRIGGER, range_bytes: int = RANGE_BYTES, progress: str | None = None) -> DataFrame:
    """(partition, offset, value) of a topic's messages as a stream."""
    spark.dataSource.register(MessageLog)
    reader = spark.readStream.format(FORMAT).option("path", path)
    reader = reader if progress is None else reader.option("progressPath", progress)
    return reader.option("maxBytesPerTrigger", bytes_per_trigger).option("rangeBytes", range_bytes).load()
