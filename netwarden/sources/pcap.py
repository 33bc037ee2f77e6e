"""Packet timestamps of classic capture files of any size.

A capture is read in byte ranges; a task reads one large range or many small ones, and holds one piece at a time. A record's header tells how long the record
is, so only the first range knows where its records begin; every other range looks for the first place from which a chain of plausible headers runs on.
What it found is checked afterwards: over a file, each range must begin where the records of the ranges before it end, up to the end of the file. As
the chain from the first record is the only right one, ranges that join are right; a range that does not join is read again from the place where its
predecessor ended, until all join.
"""

from __future__ import annotations

import itertools
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from netwarden.session import checkpointed
from netwarden.sources import ranges

# Classic capture file layout.
MAGIC = 0xA1B2C3D4
FILE_HEADER, PACKET_HEADER = 24, 16
#: Longest packet that a header is believed to announce when a range looks for its first record, headers of a chain, and seconds between two of them.
LONGEST, CHAIN, STEP = 1 << 18, 6, 86_400
RANGE_BYTES = 64 << 20
#: Bytes that opening a range counts for where ranges are dealt out to tasks, and packets of small ranges that make a batch.
OPEN_BYTES, BATCH_PACKETS = 64 << 10, 20_000
FORMAT = "capture_packets"
SCHEMA = "path string, range_no int, packet int, at long, after long, ts_us long"


def byte_order(path: str, head: bytes) -> str:
    """``<`` or ``>``; another magic number, or a shorter file, is an error."""
    if len(head) < FILE_HEADER:
        raise ValueError(f"{path}: shorter than a capture file header")
    order = next((o for o in "<>" if struct.unpack(o + "I", head[:4])[0] == MAGIC), None)
    if order is None:
        raise ValueError(f"{path}: not a classic capture file")
    return order


class Pieces:
    """A file read forwards, a piece at a time."""

    def __init__(self, handle, size: int, piece: int = ranges.CHUNK):
        self.handle, self.size, self.piece = handle, size, piece
        self.start, self.data = 0, b""

    def header(self, at: int) -> bytes | None:
        """The 16 bytes at a place, or None where the file ends before."""
        if at + PACKET_HEADER > self.size:
            return None
        if not self.start <= at <= self.start + len(self.data) - PACKET_HEADER:
            self.handle.seek(at)
            self.start, self.data = at, self.handle.read(max(PACKET_HEADER, self.piece))
        return self.data[at - self.start : at - self.start + PACKET_HEADER]


def plausible(pieces: Pieces, at: int, form: struct.Struct) -> bool | None:
    """Whether a chain of headers could begin here; None where all that speaks for it is a record that the end of the file cuts off."""
    before = None
    for _ in range(CHAIN):
        head = pieces.header(at)
        if head is None:
            return at == pieces.size or before is not None and (at < pieces.size or None)  # a cut-off tail ends the file
        seconds, fraction, stored, length = form.unpack(head)
        if fraction >= 1_000_000 or stored > LONGEST or stored > length or before is not None and abs(seconds - before) > STEP:
            return False
        before, at = seconds, at + PACKET_HEADER + stored
    return True


def first_record(pieces: Pieces, start: int, stop: int, form: struct.Struct) -> int | None:
    """The first place of a range from which a chain of headers runs on, or else the first that a cut-off record could explain.

    Such a place lies no further from the end of the file than the longest record, so looking on for a better one is short.
    """
    cut_off = None
    for at in range(start, min(stop, pieces.size - PACKET_HEADER + 1)):
        found = plausible(pieces, at, form)
        if found:
            return at
        if found is None and cut_off is None:
            cut_off = at
    return cut_off


def packets_of(pieces: Pieces, path: str, range_no: int, start: int, stop: int, first: int | None = None) -> Iterator[pa.RecordBatch]:
    """The packets whose headers begin in a range, from ``first`` where that is known."""
    pieces.handle.seek(0)
    order = byte_order(path, pieces.handle.read(FILE_HEADER))
    form = struct.Struct(order + "IIII")
    if first is None:
        first = FILE_HEADER if start == 0 else first_record(pieces, start, stop, form)
    at, packet = first, 0
    while at is not None and at < stop:
        places, heads = [], []
        while at < stop and len(places) < 100_000 and (head := pieces.header(at)) is not None:
            places.append(at)
            heads.append(head)
            at += PACKET_HEADER + form.unpack(head)[2]
        if not places:
            return
        fields = np.frombuffer(b"".join(heads), order + "u4").reshape(-1, 4).astype(np.int64)
        n = len(places)
        columns = [
            pa.array([path] * n), pa.array([range_no] * n, pa.int32()), pa.array(np.arange(packet, packet + n), pa.int32()), pa.array(places, pa.int64()),
            pa.array(np.array(places) + PACKET_HEADER + fields[:, 2], pa.int64()), pa.array(fields[:, 0] * 1_000_000 + fields[:, 1], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])
        packet += n


class Ranges(InputPartition):
    """Byte ranges that one task reads, as (path, range_no, start, stop, size, first)."""

    def __init__(self, ranges_of_task: list[tuple]):
        super().__init__(ranges_of_task)
        self.ranges = ranges_of_task


def dealt(found: list[tuple], tasks: int, range_bytes: int) -> list[Ranges]:
    """The ranges in order, as many to a task as make a large range or an even share of all, whichever is less."""
    weights = [stop - start + OPEN_BYTES for _, _, start, stop, _, _ in found]
    share = min(max(range_bytes, RANGE_BYTES), max(OPEN_BYTES, -(-sum(weights) // max(tasks, 1))))
    out, held, weight = [], [], 0
    for one, w in zip(found, weights):
        if held and weight + w > share:
            out.append(Ranges(held))
            held, weight = [], 0
        held.append(one)
        weight += w
    return [*out, Ranges(held)] if held else out


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some size, as small ranges give few rows each."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH_PACKETS:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)


class CaptureReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.piece, self.tasks = int(options.get("piecebytes", ranges.CHUNK)), int(options.get("tasks", 1))
        # {path: {range: place of its first record}}; only these ranges are read where it is given.
        self.firsts = json.loads(options["firsts"]) if "firsts" in options else None

    def partitions(self) -> list[Ranges]:
        found = []
        for path, size in ranges.files_of(self.path):
            for k, start in enumerate(range(0, max(size, 1), self.bytes)):
                if self.firsts is None or str(k) in self.firsts.get(path, {}):
                    found.append((path, k, start, min(start + self.bytes, size), size, None if self.firsts is None else self.firsts[path][str(k)]))
        return dealt(found, self.tasks, self.bytes)

    def batches(self, found: list[tuple]) -> Iterator[pa.RecordBatch]:
        for path, of_path in itertools.groupby(found, key=lambda r: r[0]):
            with ranges.opened(path) as handle:
                for _, range_no, start, stop, size, first in of_path:
                    yield from packets_of(Pieces(handle, size, self.piece), path, range_no, start, stop, first)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from gathered(self.batches(partition.ranges))


class CaptureSource(DataSource):
    """``spark.read.format("capture_packets")``: the packets of capture files, by byte ranges; options ``path``, ``rangeBytes`` and ``tasks``, the number of tasks that small ranges keep busy."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)


def seams(packets: DataFrame) -> DataFrame:
    """(path, range_no, n, first, after, skipped, previous): where each range's records begin and end, and where those of the ranges before it end."""
    own = packets.groupBy("path", "range_no").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.max("after").alias("after"), F.min("packet").alias("skipped"))
    return own.withColumn("previous", F.lag("after").over(Window.partitionBy("path").orderBy("range_no")))


def read_packets(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, piece_bytes: int = ranges.CHUNK) -> DataFrame:
    """(path, range_no, packet, at, after, ts_us) of all packets, materialized, with every seam checked.

    A cut-off record ends its file. What the driver gets is one row for each seam that does not join, of which there are none unless payloads look like records.
    """
    spark.dataSource.register(CaptureSource)

    def load(**options) -> DataFrame:
        reader = spark.read.format(FORMAT).option("path", path).option("rangeBytes", range_bytes).option("pieceBytes", piece_bytes).option("tasks", 4 * spark.sparkContext.defaultParallelism)
        return checkpointed(reader.options(**options).load())

    packets = load()
    sizes = spark.createDataFrame(ranges.files_of(path), "path string, size long")
    while True:
        known = seams(packets)
        torn = known.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col("first"))).select("path", "previous", F.col("range_no").alias("until"))
        # Records must go on to the end: what follows a file's last record is shorter than a header.
        ends = known.groupBy("path").agg(F.max_by("after", "range_no").alias("previous")).join(sizes, "path").filter(F.col("previous") + PACKET_HEADER <= F.col("size"))
        open_ = torn.unionByName(ends.select("path", "previous", F.lit(None).cast("int").alias("until")))
        wrong = open_.groupBy("path").agg(F.min(F.struct("previous", "until")).alias("s")).select("path", "s.*").collect()
        if not wrong:
            return packets
        # What lies before a file's first torn seam is right, so the range in which it ends begins there; ranges that its last record covers hold no header.
        again = load(firsts=json.dumps({r["path"]: {str(r["previous"] // range_bytes): r["previous"]} for r in wrong}))
        mended = spark.createDataFrame([(r["path"], r["until"], r["previous"], r["previous"] // range_bytes) for r in wrong], "path string, until int, previous long, torn int")
        mended = mended.join(again.groupBy("path").agg(F.max("after").alias("ended")), "path", "left")
        right = F.col("until").isNull() | (F.col("range_no") < F.col("until"))
        later = (F.col("range_no") > F.col("torn")) & (F.col("at") >= F.coalesce("ended", "previous"))
        kept = packets.join(mended, "path", "left").filter(F.col("torn").isNull() | right | later).select(*packets.columns)
        packets = checkpointed(kept.unionByName(again))


def numbered(packets: DataFrame) -> DataFrame:
    """(path, packet_no, ts_us) in file order, numbered from 1."""
    earlier = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    # A range that was mended keeps the numbers of its own reading, from where it joins.
    before = seams(packets).select("path", "range_no", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("skipped")).alias("before"))
    return packets.join(before, ["path", "range_no"]).select("path", (F.col("before") + F.col("packet") + 1).alias("packet_no"), "ts_us")


def packet_timestamps(captures: DataFrame) -> DataFrame:
    """(path, packet_no, ts_us) in file order, of captures that lie whole in a table, (path, content); payloads are skipped, a cut-off tail ends a capture."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                handle = pa.BufferReader(content.as_buffer())
                yield from packets_of(Pieces(handle, handle.size()), path, 0, 0, handle.size())

    return captures.select("path", "content").mapInArrow(scan, SCHEMA).select("path", (F.col("packet") + 1).cast("long").alias("packet_no"), "ts_us")


def packet_counts(packets: DataFrame) -> DataFrame:
    return packets.groupBy("path").agg(F.count(F.lit(1)).alias("packets"))


def write_captures(captures: DataFrame, folder: str) -> None:
    """Files from rows (path, content), each by the task that holds the row."""

    def write(rows) -> None:
        for row in rows:
            ranges.written(f"{folder}/{row['path']}", bytes(row["content"]))

    captures.select("path", "content").foreachPartition(write)
