"""Boosted trees: traversal against a plain walk, held-out accuracy, edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from netwarden.llm import quality
from netwarden.llm.frames import held_out, table


def walk(forest, row):
    total = forest.start
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
        at = 0
        for _ in range(quality.DEPTH):
            at = 2 * at + 1 + int(row[feature[at]] > threshold[at])
        total += leaf[at - (2**quality.DEPTH - 1)]
    return 1 / (1 + np.exp(-total))


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    forest = quality.train(x[:1500], y[:1500])
    scores = forest.score(x)
    assert np.allclose(scores[:50], [walk(forest, r) for r in x[:50]])
    assert ((scores[1500:] > 0.5) == y[1500:]).mean() > 0.95


def test_degenerate_training():
    assert quality.train(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (quality.train(np.ones((5, 3)), np.ones(5)).score(np.zeros((2, 3))) > 0.9).all()


def test_statistics():
    got = dict(zip(quality.STATISTICS, quality.statistics_of("a a b\n\na a b\n#1")))
    assert got["words"] == 7 and got["lines"] == 3 and got["repeated_next"] == 2 / 7 and round(got["repeated_lines"], 3) == 0.333
    assert len(quality.statistics_of(None)) == len(quality.STATISTICS) == len(quality.statistics_of("x" * 200_000))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = quality.score(docs, quality.fit(docs, labels)).withColumnRenamed("id", "doc_id").withColumn("held", held_out(F.col("doc_id"), 5, 0))
    rows = scored.join(labels, "doc_id").filter("held and quality is not null").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert len(bad) > 50 and np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.99
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)


def test_edges(spark):
    rows = [(1, None, 3), (1, "", 3), (None, "some text here", 3), (2, "x " * 50_000, 3), (2, "x " * 50_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.fit(docs, none)).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), none)).count() == 0
    some = spark.createDataFrame([(2, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0)], none.schema)
    got = quality.score(docs, quality.fit(docs, some)).collect()
    assert all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["id"] == 2}) == 1
