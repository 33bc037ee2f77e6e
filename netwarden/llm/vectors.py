"""Inverted multi-index: nearest neighbours by inner product over vectors whose two halves are quantised separately.

Inner products become distances by one more coordinate: with M the largest norm, ``sqrt(M^2 - |x|^2)`` is appended to every entry and 0 to every
query, and the nearest entry is the one of largest inner product. A bounded sample gives a codebook for each half; a pair of centroids is a cell,
and every row lies in one cell. A query visits cells in the order of the summed distances of its halves to the two centroids, which a heap yields
without sorting all pairs, until they hold the wanted share of all rows; the entries of those cells are ranked by the inner product of the
original vectors, in double precision, added up from the first component to the last, so equal vectors have equal scores.

The share is not fixed: on the sample, whose neighbours are known by brute force, it is the least that reaches ``RECALL`` of them. As the sample is
thinner than the table, its neighbours are farther off, so the table's are reached sooner. No cell is cut: cells are dealt in order over shards of
``SHARD_ROWS`` rows, a cell over that is spread over several, and every query that visits it meets each of them. Blocks of ``QUERY_ROWS`` queries meet a
shard in tasks of their own, so neither a common vector nor many queries grow a task.

Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without an id or of another length than most rows
have. Rows that share an id are found once, by the best of them; of queries that share an id the smallest vector is asked. Ties go to the smaller
id. A query with fewer candidates than asked for gets them all; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netwarden.session import checkpointed

SEED = 42
#: Rows that codebooks and share are learned from, at most, and those of them that ask.
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 400
#: Centroids of a half, at most: the table of cells has the square of it.
MOST_CENTROIDS = 1024
#: Share of the sample's neighbours that the visited cells must hold.
RECALL = 0.95
#: Entries and queries that one task compares.
SHARD_ROWS, QUERY_ROWS = 4096, 8192
ROUNDS = 12


@dataclass
class Index:
    """Codebooks, and what a query visits."""

    halves: list[np.ndarray]  # centroids of either half; the second has the added coordinate
    norm: float  # the largest norm M
    dim: int
    n_rows: int
    share: float


def valid(vector: Column) -> Column:
    """Whether a vector takes part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(usable & F.exists(vector, lambda x: x != 0), F.lit(False))


def prepared(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vector)`` of the rows that take part."""
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    return out.filter(F.col("id").isNotNull() & valid(F.col("vector")))


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x)


def split(x: np.ndarray, norm: float | None) -> list[np.ndarray]:
    """Both halves, with the added coordinate of entries or, without ``norm``, of queries."""
    cut = (x.shape[1] + 1) // 2
    added = np.zeros(len(x)) if norm is None else np.sqrt(np.maximum(0.0, norm * norm - (x * x).sum(axis=1)))
    return [x[:, :cut], np.column_stack([x[:, cut:], added])]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1))


def centroids_of(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from k rows of the sample; a centroid without rows stays."""
    out = x[np.random.default_rng(SEED).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        nearest = distances(x, out).argmin(axis=1)
        counts = np.bincount(nearest, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, nearest, x)
        out[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return out


def cells_of(x: np.ndarray, index: Index) -> np.ndarray:
    """Cell of every entry: first centroid times the number of second ones, plus the second."""
    first, second = (distances(h, c).argmin(axis=1) for h, c in zip(split(x, index.norm), index.halves))
    return first * len(index.halves[1]) + second


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells with rows, by the sum of a query's distances to both centroids, until they hold ``wanted`` rows.

    Either list is sorted; the pair after (i, j) is (i + 1, j) or (i, j + 1), so the heap holds one pair of each row of pairs at most.
    """
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[one].tolist(), second[two].tolist()
    one, two, width = one.tolist(), two.tolist(), len(second)
    heap, found, held = [(a[0] + b[0], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = one[i] * width + two[j]
        if counts[cell]:
            found.append(cell)
            held += counts[cell]
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return found


def share_needed(x: np.ndarray, index: Index, k: int, recall: float) -> float:
    """The least share of the sample's rows, in the order of traversal, that holds ``recall`` of its queries' neighbours."""
    cells = cells_of(x, index)
    counts = np.bincount(cells, minlength=len(index.halves[0]) * len(index.halves[1]))
    asked = np.arange(0, len(x), max(1, len(x) // SAMPLE_QUERIES))[:SAMPLE_QUERIES]
    one, two = (distances(h[asked], c) for h, c in zip(split(x, None), index.halves))
    needed = []
    for i, q in enumerate(asked.tolist()):
        scores = x @ x[q]
        scores[q] = -np.inf
        near = np.argpartition(-scores, k)[:k] if len(x) > k + 1 else np.flatnonzero(np.arange(len(x)) != q)
        order = np.add.outer(one[i], two[i]).ravel().argsort(kind="stable")
        reached = np.empty(len(order))
        reached[order] = np.cumsum(counts[order])
        needed.append(reached[cells[near]])
    needed = np.concatenate(needed)
    return float(np.quantile(needed, recall) / len(x)) if len(needed) else 1.0


def fit(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, recall: float = RECALL) -> Index | None:
    """Codebooks and share from at most ``SAMPLE_ROWS`` rows, drawn by a hash; None where no row takes part."""
    known = prepared(rows, id_col, vec_col).withColumn("dim", F.size("vector"))
    of_dim = known.groupBy("dim").agg(F.count("*").alias("n"), F.max(squared_norm(F.col("vector"))).alias("most"))
    most = of_dim.orderBy(F.desc("n"), "dim").first()
    if most is None:
        return None
    # A tenth is left for chance; rows beyond the bound go, in the order of their hashes.
    bound = int(2**62 * min(1.0, 0.9 * SAMPLE_ROWS / most["n"]))
    hashed = F.xxhash64("id", "vector", F.lit(SEED)).bitwiseAND(F.lit(2**62 - 1))
    drawn = known.filter(F.col("dim") == most["dim"]).withColumn("h", hashed).filter(F.col("h") < bound).select("h", "id", "vector").toPandas()
    drawn = drawn.sort_values(["h", "id"]).head(SAMPLE_ROWS)
    if drawn.empty:  # a handful of rows, none below the bound
        drawn = known.filter(F.col("dim") == most["dim"]).limit(1).select("vector").toPandas()
    x = np.stack(drawn["vector"].to_numpy()).astype(np.float64)
    size = min(MOST_CENTROIDS, max(4, 1 << round(math.log2(max(1.0, most["n"] / 32)) / 2)))
    index = Index([], math.sqrt(most["most"]), most["dim"], most["n"], 1.0)
    index.halves = [centroids_of(h, size) for h in split(x, index.norm)]
    index.share = share_needed(x, index, k, recall)
    return index


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


def placed(rows: DataFrame, index: Index, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(id, vector, cell, place)`` for every row that takes part; ``place`` numbers the rows, to deal them out."""

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                cells = cells_of(matrix(batch.column("vector"), index.dim), index)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(cells, pa.int32())], ["id", "vector", "cell"])

    known = prepared(rows, id_col, vec_col).filter(F.size("vector") == index.dim)
    return known.mapInArrow(assign, "id long, vector array<double>, cell int").withColumn("place", F.monotonically_increasing_id())


def shards_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First shard of every cell and the number of shards it is spread over; cells that follow each other share a shard."""
    spread = np.maximum(1, -(-counts // SHARD_ROWS))
    first = np.zeros(len(counts), np.int64)
    shard = held = 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > SHARD_ROWS:
            shard, held = shard + 1, 0
        first[cell] = shard
        held += n
        if spread[cell] > 1:
            shard, held = shard + int(spread[cell]), 0
    return first, spread


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of the components."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        total += q[:, k] * x[:, k]
    return total


def best_of(query_ids: np.ndarray, q: np.ndarray, seen: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best ``(position of the query, id, score)`` of the entries that ``seen`` (queries x entries) allows."""
    allowed = seen & (ids[None, :] != query_ids[:, None])
    rough = np.where(allowed, q @ x.T, -np.inf)
    most = k * int(np.unique(ids, return_counts=True)[1].max())
    if most < len(ids):  # rounding differs from the exact sum by far less than the margin
        margin = 1e-10 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        allowed &= rough >= (np.partition(rough, len(ids) - most, axis=1)[:, len(ids) - most] - margin)[:, None]
    at, entry = np.nonzero(allowed)
    score = exact(q[at], x[entry])
    order = np.lexsort((-score, ids[entry], at))  # of one id the best row
    once = np.append(True, (np.diff(at[order]) != 0) | (np.diff(ids[entry][order]) != 0))[: len(order)]
    at, entry, score = at[order][once], entry[order][once], score[order][once]
    order = np.lexsort((ids[entry], -score, at))
    at, entry, score = at[order], entry[order], score[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at)
    return at[rank < k], ids[entry[rank < k]], score[rank < k]


def search(entries: DataFrame, queries: DataFrame, index: Index | None, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest of ``entries`` found for each of ``queries`` but the row of its own id."""
    spark = entries.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    stored = checkpointed(placed(entries, index, id_col, vec_col))
    counts = np.zeros(len(index.halves[0]) * len(index.halves[1]), np.int64)
    for cell, n in stored.groupBy("cell").count().collect():  # at most a row for each pair of centroids
        counts[cell] = n
    first, spread = shards_of(counts)
    wanted = max(4 * k, math.ceil(index.share * index.n_rows))

    asked = prepared(queries, id_col, vec_col).filter(F.size("vector") == index.dim).groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = max(1, math.ceil(asked.count() / QUERY_ROWS))

    def visits(batches):
        for batch in batches:
            q = matrix(batch.column("vector"), index.dim)
            one, two = (distances(h, c) for h, c in zip(split(q, None), index.halves))
            for i in range(batch.num_rows):
                by_shard: dict[int, list[int]] = {}
                for cell in traverse(one[i], two[i], counts, wanted):
                    for shard in range(first[cell], first[cell] + spread[cell]):
                        by_shard.setdefault(shard, []).append(cell)
                own = batch.slice(i, 1)
                again = pa.array(np.zeros(len(by_shard), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [own.column("id").take(again), own.column("vector").take(again), pa.array(list(by_shard), pa.int64()), pa.array(list(by_shard.values()), pa.list_(pa.int32()))],
                    ["id", "vector", "shard", "cells"],
                )

    visited = asked.mapInArrow(visits, "id long, vector array<double>, shard long, cells array<int>")
    visited = visited.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))

    def shards(batches):
        for batch in batches:
            cell = np.asarray(batch.column("cell"))
            shard = first[cell] + np.asarray(batch.column("place")) % spread[cell]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), batch.column("cell"), pa.array(shard, pa.int64())], ["id", "vector", "cell", "shard"])

    dealt = stored.mapInArrow(shards, "id long, vector array<double>, cell int, shard long")
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def rerank(near: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(near) and len(asking):
            x, ids = np.stack(near["vector"].to_numpy()), near["id"].to_numpy()
            known, cell = np.unique(near["cell"].to_numpy(), return_inverse=True)
            for at in range(0, len(asking), 256):
                part = asking.iloc[at : at + 256]
                seen = np.zeros((len(part), len(known)), bool)
                for i, cells in enumerate(part["cells"]):
                    place = np.searchsorted(known, cells)
                    ours = place < len(known)
                    ours[ours] = known[place[ours]] == np.asarray(cells)[ours]
                    seen[i, place[ours]] = True
                own = part["id"].to_numpy()
                row, vec, score = best_of(own, np.stack(part["vector"].to_numpy()), seen[:, cell], ids, x, k)
                out.append(pd.DataFrame({"query_id": own[row], "vec_id": vec, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = dealt.groupBy("shard", "block").cogroup(visited.groupBy("shard", "block")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
