"""Statistics against brute force, the learned list, and the filter."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netwarden.llm import rules
from netwarden.llm.frames import table


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t", "one", "a b c d e", "a b c d e a b c d e", "x " * 3000, "#" * 50, "a\n\na\n \n a\na", "é\x0bß\x0c日本   x", "😀 <b> |&$"]
    for _ in range(200):
        out.append("".join(rng.choice(["a", "b", "c d", " ", " ", "\n", "#", "same line\n", "w%d" % rng.randrange(30)]) + rng.choice([" ", " ", ""]) for _ in range(rng.randrange(90))))
    return out


def test_statistics(spark):
    rows = list(enumerate(texts() + texts()[:3]))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string")
    judged = rules.judge(docs, [])
    s = F.col(rules.STATISTICS)
    got = judged.select("doc_id", s["n_words"], s["word_chars"], s["n_symbols"], s["lines"]["dup"], s["n_repeat_words"], s["base_failed"], s["kept"]).collect()
    for r in got:
        want = brute(dict(rows)[r[0]])
        assert tuple(r)[1:7] == want and r[7] == (not want[5])


def test_covering_finds_a_planted_rule():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(rules.FEATURES)))
    bad = (x[:, 0] > 0.8) & (x[:, 1] <= 0.6)
    found = rules.learn(x, bad, np.arange(3000) % 3 == 0)
    judged = np.zeros(3000, bool)
    for rule in found:
        judged |= rules.covers(rule, x)
    assert (judged & bad).sum() > 0.95 * bad.sum() and (judged & ~bad).sum() < 0.03 * bad.sum()


def test_no_rule_from_chance():
    rng = np.random.default_rng(2)
    assert rules.learn(rng.random((2000, len(rules.FEATURES))), rng.random(2000) < 0.1, np.arange(2000) % 3 == 0) == []


@pytest.fixture(scope="module")
def learned(spark):
    sf = "/root/testdata/sf0.01"
    return rules.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))


def test_labelled_documents(spark, learned):
    sf = "/root/testdata/sf0.1"
    judged = rules.judge(table(spark, sf, "documents"), learned).join(table(spark, sf, "labels"), "doc_id").filter("quality is not null")
    s = F.col(rules.STATISTICS)
    counts = {(r[0], r[1]): r[2] for r in judged.filter(~s["base_failed"]).groupBy("quality", s["kept"]).count().collect()}
    assert counts.get((1, False), 0) <= 0.002 * counts[1, True]
    assert counts[0, False] >= 0.9 * (counts[0, False] + counts.get((0, True), 0))


def test_filter_keeps_columns(spark, learned):
    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, 0), (1, text, 0), (None, text, 1), (2, "short", 1), (3, None, 1)], "doc_id long, text string, kept int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    left = rules.good_only(docs, labels)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 1]
    assert rules.good_only(docs.limit(0), labels).count() == 0
    assert rules.fit(docs, labels.union(spark.createDataFrame([(1, None, None), (None, 1, 0)], labels.schema))) == []
