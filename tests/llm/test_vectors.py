"""The multi-index against brute force."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from netwarden.llm import queries, vectors

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, asked, k):
    """Neighbours by inner product, added up in order; rows are (id, vector)."""
    out = {}
    for q, v in asked:
        scores = {}
        for i, x in rows:
            if i != q:
                total = 0.0
                for a, b in zip(v, x):
                    total += a * b
                scores[i] = max(total, scores.get(i, -np.inf))
        best = sorted(scores.items(), key=lambda p: (-p[1], p[0]))[:k]
        out[q] = [(r + 1, i, s) for r, (i, s) in enumerate(best)]
    return out


def found(spark, rows, asked, k=20, index=None):
    df = spark.createDataFrame(rows, SCHEMA)
    index = index or vectors.fit(df, k=k)
    out = {}
    for r in sorted(vectors.search(df, spark.createDataFrame(asked, SCHEMA), index, k).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_pairs_of_centroids_come_in_order_of_their_sum():
    rng = np.random.default_rng(3)
    for _ in range(30):
        first, second = rng.integers(0, 9, rng.integers(1, 7)).astype(float), rng.integers(0, 9, rng.integers(1, 7)).astype(float)
        counts = rng.integers(0, 4, len(first) * len(second))
        sums = np.add.outer(first, second).ravel()
        got = vectors.traverse(first, second, counts, 10**6)
        assert sorted(got) == np.flatnonzero(counts).tolist()
        assert np.all(np.diff(sums[got]) >= 0)
        some = vectors.traverse(first, second, counts, 5)
        assert some == got[: len(some)]
        assert counts[some].sum() >= min(5, counts.sum()) and counts[some[:-1]].sum() < 5


def test_all_cells_give_the_exact_result(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(i), (rng.normal(size=6) * rng.choice([0.1, 1, 30])).tolist()) for i in rng.permutation(300)]
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(120)]  # copies: ties go to the smaller id
    asked = [r for r in rows if r[0] % 7 == 0]
    index = vectors.fit(spark.createDataFrame(rows, SCHEMA))
    index.share = 1.0
    want = brute(rows, asked, 20)
    assert found(spark, rows, asked, index=index) == want
    monkeypatch.setattr(vectors, "SHARD_ROWS", 16)  # the copies' cell is spread over many shards, queries over blocks
    monkeypatch.setattr(vectors, "QUERY_ROWS", 9)
    assert found(spark, rows, asked, index=index) == want


def test_norms_of_any_size_are_found(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * rng.lognormal()).tolist()) for i in range(1500)]
    asked = rows[::30]
    got, want = found(spark, rows, asked, 10), brute(rows, asked, 10)
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert all(len(got[q]) == 10 for q in want)


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, folder):
    path = f"/root/testdata/{folder}"
    got = queries.QUERIES["op11_neighbours"](spark, path).toPandas()
    table = pq.read_table(f"{path}/embeddings.parquet").to_pandas()
    x, ids = np.stack([np.asarray(v, float) for v in table["embedding"]]), table["vec_id"].to_numpy()
    hits = asked = 0
    for q, part in got.groupby("query_id"):
        own = x[ids == q][0]
        scores = x @ own
        scores[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21))
        assert np.allclose(part["score"], scores[np.searchsorted(ids, part["vec_id"])], rtol=0, atol=1e-12)
        assert sorted(zip(-part["score"], part["vec_id"])) == list(zip(-part["score"], part["vec_id"]))
        hits += len(set(best) & set(part["vec_id"]))
        asked += 20
    assert asked == 20 * (ids % 20 == 0).sum()
    assert hits >= 0.9 * asked


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, None), (4, [0.0, -0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, [1.0, 1.0, 1.0]), (None, [5.0, 5.0]), (9, []),
        (10, [0.5, 0.5]), (2, [2.0, 1.0]), (10, [0.25, 0.5]),
    ]
    got = found(spark, rows, rows)
    assert {q: [i for _, i, _ in g] for q, g in got.items()} == {1: [2, 10], 2: [1, 10], 10: [1, 2]}
    assert got[1] == [(1, 2, 4.0), (2, 10, 1.5)]  # the better of both rows 10
    assert got[10] == [(1, 1, 1.25), (2, 2, 1.0)]  # asked by the smaller of both vectors


def test_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert vectors.search(none, none, vectors.fit(none)).collect() == []
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0])], SCHEMA)
    for name in ["id", "vector", "cell", "place", "shard", "block", "dim", "h", "score", "rank", "query_id"]:
        rows = rows.withColumn(name, F.lit("x"))
    assert {tuple(r) for r in vectors.search(rows, rows, vectors.fit(rows)).collect()} == {(1, 1, 2, 4.0), (2, 1, 1, 4.0)}
    assert vectors.search(rows, none, vectors.fit(rows)).collect() == []
