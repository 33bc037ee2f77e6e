"""Vector code compression: product codes from integer k-means, with distances read off value dictionaries.

A component x becomes the integer ``floor(scale * x)``. Vectors are cut into equal consecutive parts, each with a codebook of its own, and a vector
becomes the number of its nearest entry in each. The rows are kept in blocks of ``BLOCK_ROWS``; a block holds, for every dimension, the
dictionary of the distinct integers in it and each row's code in that dictionary. A round tabulates the squared differences of every
dictionary value to all entries, once for each dimension of a block, and the distances of the rows are gathers from those tables and sums: few
hundred values stand for thousands of rows. All sums are of integers, so neither the dealing out of rows nor the order of tasks changes a digit.

A round is one pass over the blocks; a task adds its rows up by entry before anything is shuffled, and the driver receives one row for each entry.

Rows whose vector is null or holds a null or non-finite component are dropped; so are vectors of another length than most rows have, the empty
ones included. Lengths that the parts do not divide are filled up with zeros, which change no distance. Rows that share an id are kept, each with
its own code; among the first entries they go by their components; rows without an id come last there. Fewer rows than entries make smaller codebooks; an
empty table gives an empty result; other columns are ignored. Integers of 2^27 and more could overflow 64 bits, so such a component is an error.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.frames import small_batches
from netwarden.session import checkpointed

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK_ROWS = 2048
MOST = 2**27

Codebooks = list[np.ndarray]  # entries x components of each part


def integers(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(id, v, dim, <other columns>)`` with integer components, of the rows whose components are all finite."""
    usable = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    known = rows.filter(F.coalesce(usable, F.lit(False)) & (F.size(vec_col) > 0))
    # Far components are cut here and found by their size afterwards.
    cut = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(2 * MOST))), F.lit(-float(2 * MOST))))
    return known.withColumn(vec_col, F.transform(vec_col, cut)).withColumnRenamed(vec_col, "v")


def dictionaries(v: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct values of every column, and the codes of the rows in them."""
    found = [np.unique(v[:, d], return_inverse=True) for d in range(v.shape[1])]
    return [x for x, _ in found], np.stack([c for _, c in found], axis=1).astype(np.uint16)


def blocks_of(known: DataFrame, dim: int, width: int) -> DataFrame:
    """``(ids, labels, sizes, values, codes)``: up to ``BLOCK_ROWS`` rows with the dictionaries of ``width`` dimensions."""
    names = ["ids", "labels", "sizes", "values", "codes"]

    def pack(batches):
        held: list[pa.RecordBatch] = []

        def made(rows: pa.RecordBatch) -> pa.RecordBatch:
            v = np.zeros((rows.num_rows, width), np.int64)
            v[:, :dim] = np.asarray(rows.column("v").flatten()).reshape(-1, dim)
            values, codes = dictionaries(v)
            sizes = np.array([len(x) for x in values], np.int32)
            cells = [rows.column("id").to_pylist(), rows.column("label").to_pylist(), sizes.tobytes(), np.concatenate(values).astype(np.int32).tobytes(), codes.tobytes()]
            types = [pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, types)], names)

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK_ROWS:
                rows = joined()
                yield made(rows.slice(0, BLOCK_ROWS))
                held[:] = [rows.slice(BLOCK_ROWS)] if rows.num_rows > BLOCK_ROWS else []
        if held:
            yield made(joined())

    return known.select("id", "label", "v").mapInArrow(pack, "ids array<long>, labels array<string>, sizes binary, values binary, codes binary")


def unpacked(sizes: bytes, values: bytes, codes: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """Dictionaries and codes of a stored block."""
    n = np.frombuffer(sizes, np.int32)
    return np.split(np.frombuffer(values, np.int32).astype(np.int64), np.cumsum(n)[:-1]), np.frombuffer(codes, np.uint16).reshape(-1, len(n))


def stored_rows(batch: pa.RecordBatch):
    """One block after another as a dict."""
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def nearest(values: list[np.ndarray], codes: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Entry (the lowest among equals) and squared distance of every row in every part."""
    width = len(values) // len(books)
    entry, error = np.empty((len(codes), len(books)), np.int64), np.empty((len(codes), len(books)), np.int64)
    for p, book in enumerate(books):
        tables = [(v[:, None] - book[None, :, k]) ** 2 for k, v in enumerate(values[p * width : (p + 1) * width])]
        kind = np.int32 if sum(int(t.max()) for t in tables) < 2**31 else np.int64  # the smaller numbers are read faster
        total = np.zeros((len(codes), len(book)), kind)
        for k, table in enumerate(tables):
            total += table.astype(kind)[codes[:, p * width + k]]
        entry[:, p] = total.argmin(axis=1)
        error[:, p] = total[np.arange(len(codes)), entry[:, p]]
    return entry, error


def sums_by_entry(blocks: DataFrame, books: Codebooks) -> DataFrame:
    """``(part, entry, n, sums)``, one row for each entry that is nearest to a row of a task."""
    width = books[0].shape[1]

    def run(batches):
        n = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros((len(b), width), np.int64) for b in books]
        for batch in batches:
            for stored in stored_rows(batch):
                values, codes = unpacked(**stored)
                entry, _ = nearest(values, codes, books)
                for p in range(len(books)):
                    n[p] += np.bincount(entry[:, p], minlength=len(n[p]))
                    for k in range(width):  # the sums of a block are whole numbers far below 2^53
                        d = p * width + k
                        sums[p][:, k] += np.bincount(entry[:, p], values[d][codes[:, d]], len(n[p])).astype(np.int64)
        for p in range(len(books)):
            used = np.flatnonzero(n[p])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p, np.int32)), pa.array(used, pa.int32()), pa.array(n[p][used]), pa.array(list(sums[p][used]), pa.list_(pa.int64()))],
                ["part", "entry", "n", "sums"],
            )

    partial = blocks.select("sizes", "values", "codes").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    each = [F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(width)]
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each)


class Compressor:
    """Codebooks learned from all rows of a table, and the blocks they were learned from."""

    def __init__(self, blocks: DataFrame | None, books: Codebooks, dim: int):
        self.blocks, self.books, self.dim = blocks, books, dim

    def digest(self) -> str:
        """sha256 of all components of all entries, in decimal digits."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def fit(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressor:
    """Codebooks that begin with the vectors of the smallest ids and are moved ``rounds`` times to the floor of the mean of what is nearest."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("v"))
    known = integers(own, "id", "v", scale)
    lengths = known.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"))
    most = lengths.orderBy(F.desc("n"), "dim").first()
    if most is None:
        return Compressor(None, [], 0)
    if most["most"] >= MOST:
        raise ValueError(f"components of {MOST} and more after scaling by {scale} do not fit 64-bit distances")
    known = known.filter(F.size("v") == most["dim"])
    dim, width = most["dim"], math.ceil(most["dim"] / parts)
    # The bound is found from ids alone; only rows up to it are sorted by their components.
    ids = [r[0] for r in known.select("id").orderBy(F.asc_nulls_last("id")).limit(entries).collect()]
    upto = F.lit(True) if ids[-1] is None else F.col("id") <= ids[-1]
    first = known.filter(upto).select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    start = np.zeros((len(first), width * parts), np.int64)
    start[:, :dim] = np.array([r["v"] for r in first], np.int64)
    books = [start[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    small_batches(rows.sparkSession)  # of blocks, too, few are read at a time
    blocks = checkpointed(blocks_of(known, dim, width * parts))
    for _ in range(rounds):
        for r in sums_by_entry(blocks, books).collect():  # at most parts x entries rows
            books[r["part"]][r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return Compressor(blocks, books, dim)


def encode(model: Compressor, spark) -> DataFrame:
    """``(id, label, code, error)`` of every row that was learned from; ``code`` is an array of entry numbers."""
    schema = "id long, label string, code array<int>, error long"
    if model.blocks is None:
        return spark.createDataFrame([], schema)
    books = model.books

    def run(batches):
        for batch in batches:
            for stored in stored_rows(batch):
                ids, labels = stored.pop("ids"), stored.pop("labels")
                entry, error = nearest(*unpacked(**stored), books)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(list(entry.astype(np.int32)), pa.list_(pa.int32())), pa.array(error.sum(axis=1))],
                    ["id", "label", "code", "error"],
                )

    return model.blocks.mapInArrow(run, schema)


def decode(codes: DataFrame, model: Compressor, scale: int = SCALE, code_col: str = "code") -> DataFrame:
    """``codes`` with the vector that each code stands for as ``decoded``; a column of that name is replaced."""
    books, dim = model.books, model.dim

    @F.pandas_udf("array<double>")
    def back(column):
        made = [np.concatenate([books[p][c] for p, c in enumerate(code)])[:dim] / scale for code in column]
        return column.__class__(made, index=column.index, dtype=object)

    return codes.withColumn("decoded", back(F.col(code_col)))


def error_by_label(codes: DataFrame) -> DataFrame:
    """``codes`` with the sum of the errors of all rows with the same label, null being one of them, as ``label_error``."""
    total = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return codes.join(total, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
