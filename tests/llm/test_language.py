"""Byte network: tables against plain convolution, held-out accuracy, edge cases."""

import numpy as np
from pyspark.sql import functions as F

from netwarden.llm import language
from netwarden.llm.frames import held_out, table


def small_network():
    rng = np.random.default_rng(3)
    letters = {"a": b"abcde ", "b": b"vwxyz "}
    windows, marks = [], []
    for mark, name in enumerate(letters):
        for _ in range(150):
            windows.append(rng.choice(np.frombuffer(letters[name], np.uint8), language.WINDOW))
            marks.append(mark)
    return language.train(np.array(windows), np.array(marks), list(letters))


def test_tables_give_the_filters_responses():
    net = small_network()
    windows = np.random.default_rng(4).integers(0, 256, (7, language.WINDOW)).astype(np.uint8)
    pooled, _ = net.responses(windows)
    hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
    want = language.softmax(hidden @ net.parts["out"] + net.parts["out_bias"])
    got = np.exp(language.log_probabilities(net, net.tables(), windows.ravel()))
    assert np.allclose(got, want, atol=1e-4)


def test_blocks_do_not_change_the_answer(monkeypatch):
    net = small_network()
    data = np.random.default_rng(5).integers(0, 256, 40 * language.WINDOW).astype(np.uint8)
    whole = language.log_probabilities(net, net.tables(), data)
    monkeypatch.setattr(language, "BLOCK_BYTES", 3 * language.WINDOW)
    assert np.allclose(whole, language.log_probabilities(net, net.tables(), data), atol=1e-5)


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    found = language.predict(docs, language.fit(docs)).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    n, right = found.filter(held_out(F.col("id"), 3, 1)).agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 3000 and right / n > 0.98


def test_edges(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "123 !? 456", "de", 1), (7, "words " * 40_000, "en", 1), (None, "words again", None, 1), (7, "words " * 40_000, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    net = language.fit(docs)
    got = language.predict(docs, net).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["id"]: r["lang_pred"] for r in got if r["id"] in (1, 2, 3)} == {1: "und", 2: "und", 3: "und"}
    assert {(r["id"], r["lang_pred"]) for r in got if r["id"] in (None, 7)} == {(None, "en"), (7, "en")}
    nothing = language.fit(docs.limit(0))
    assert nothing is None and {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), net).count() == 0


def test_columns_of_any_name(spark):
    rows = [(i, "some words in english" if i % 2 else "einige worte auf deutsch", "en" if i % 2 else "de") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ["h", "chosen", "id", "windows", "score", "lang_pred"]:
        docs = docs.withColumn(name, F.lit("x"))
    assert language.predict(docs, language.fit(docs)).count() == 12
