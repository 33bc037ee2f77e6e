"""Vector codes against a plain version."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netwarden.llm import codes, queries
from netwarden.llm.frames import table

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """(id, label, code, error) of every row, and the codebooks; rows are (id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-len(kept[0][1]) // parts)
    cut = lambda v, p: (v + [0] * parts)[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        coded = []
        for i, v, label in kept:
            best = [min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)]
            coded.append((i, label, [k for _, k in best], sum(d for d, _ in best)))
        if turn < rounds:
            for p in range(parts):
                for k in range(len(books[p])):
                    own = [cut(v, p) for (_, v, _), c in zip(kept, coded) if c[2][p] == k]
                    if own:
                        books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    return coded, books


def compared(spark, rows, schema=SCHEMA, **kw):
    df = spark.createDataFrame(rows, schema).repartition(3)
    model = codes.fit(df, **kw)
    got = sorted(((r["id"], r["code"], r["error"], r["label"], r["label_error"]) for r in codes.error_by_label(codes.encode(model, spark)).collect()), key=repr)
    coded, books = plain(rows, **kw)
    total = {}
    for _, label, _, error in coded:
        total[label] = total.get(label, 0) + error
    assert got == sorted(((i, c, e, None if label is None else str(label), total[label]) for i, label, c, e in coded), key=repr)
    assert [b.tolist() for b in model.books] == books
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    assert model.digest() == digest
    return model


@pytest.mark.parametrize("dim,entries,block", [(8, 16, 2048), (8, 16, 7), (6, 300, 50), (3, 4, 2048), (1, 5, 11)])
def test_against_the_plain_version(spark, monkeypatch, dim, entries, block):
    monkeypatch.setattr(codes, "BLOCK_ROWS", block)
    rng = np.random.default_rng(dim)
    rows = [(int(i), rng.choice([rng.normal(size=dim), np.round(rng.normal(size=dim))], axis=0).tolist(), [None, 1, 2, 7][i % 4]) for i in rng.permutation(180) - 40]
    rows += rows[:25]  # repeated rows
    rows += [(rows[0][0], [0.5] * dim, 3), (None, [0.25] * dim, None)]
    compared(spark, rows, entries=entries)


def test_large_and_negative_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) * 30_000).tolist(), 0) for i in range(60)]
    compared(spark, rows, entries=8)
    with pytest.raises(ValueError, match="64-bit"):
        codes.fit(spark.createDataFrame([(1, [1e30, 1.0], 0)], SCHEMA))


def test_what_is_dropped(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 0.25, 0.125, 0.0], 1), (2, [0.0] * 4, None)]
    bad = [(3, None, 1), (4, [nan, 1.0, 1.0, 1.0], 1), (5, [1.0, inf, 1.0, 1.0], 1), (6, [1.0, None, 1.0, 1.0], 1), (7, [], 1), (8, [1.0], 1)]
    model = codes.fit(spark.createDataFrame(good + bad, SCHEMA))
    coded = codes.encode(model, spark).orderBy("id")
    assert [(r["id"], r["code"], r["error"]) for r in coded.collect()] == [(1, [0, 0, 0, 0], 0), (2, [1, 1, 1, 0], 0)]
    assert [r["decoded"] for r in codes.decode(coded, model).orderBy("id").collect()] == [[0.5, 0.25, 0.125, 0.0], [0.0] * 4]
    empty = codes.fit(spark.createDataFrame(bad[:4], SCHEMA))
    assert codes.error_by_label(codes.encode(empty, spark)).collect() == []


def test_other_columns(spark):
    df = spark.createDataFrame([(1, [0.5, 0.25], 1), (2, [0.1, 0.2], 2)], SCHEMA)
    for name in ["id", "v", "dim", "n", "code", "error", "ids"]:
        df = df.withColumn(name, F.lit("x"))
    assert codes.encode(codes.fit(df), spark).count() == 2


def test_query_over_the_whole_table(spark):
    path = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, path, "embeddings").collect()]
    coded, books = plain(rows)
    total = {}
    for _, label, _, error in coded:
        total[label] = total.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    want = sorted((i, "".join(f"{k:02x}" for k in c), e, total[label], digest) for i, label, c, e in coded)
    assert sorted(tuple(r) for r in queries.QUERIES["op13_vector_codes"](spark, path).collect()) == want
