"""Fill-in-middle against a plain version over all units."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from netwarden.llm import infill, queries
from netwarden.llm.frames import table

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PIECES = ["a", "word", " ", "  ", "\n", "\t\x0b", "é", "😀", "日本語", " ", " ", "<", ">", "<P", "S>", "\x1c", "\x85", "0"]


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_every_boundary(block):
    rng = random.Random(block)
    for _ in range(150):
        text = "".join(rng.choices(PIECES, k=rng.randint(1, 40)))
        units = UNIT.findall(text)
        blocks = infill.Blocks(text.encode(), block)
        assert (blocks.n, blocks.chars) == (len(units), len(text))
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert blocks.boundary(k) == (len(before.encode()), len(before))


def test_rows_against_the_plain_version(spark):
    rng = random.Random(9)
    texts = [None, "", " ", "\n\t", "one", "a <P> b", "x<S>", "<M>", "<P <S M>"] + ["".join(rng.choices(PIECES, k=rng.randint(1, 60))) for _ in range(400)]
    texts += ["word " * 50_000, "x" * 300_000, "😀 " * 40_000]
    rows = [(i * 37 - 500, t) for i, t in enumerate(texts)] + [(None, "null id"), (3, "same row"), (3, "same row")]
    made = infill.restore(infill.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = sorted(((i, *plain(i, t), t or "") for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in made), key=repr) == want
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_query_over_the_whole_table(spark):
    path = "/root/testdata/sf0.01"
    got = {r["doc_id"]: tuple(r) for r in queries.QUERIES["op12_fill_in_middle"](spark, path).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = table(spark, path, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        *head, output = plain(doc_id, text)
        assert got[doc_id] == (doc_id, *head, sha(output), sha(text or ""))


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert infill.restore(infill.fill_in_middle(docs.limit(0))).collect() == []
    for name in ["id", "h", "n", "form", "output", "restored", "prefix_chars"]:
        docs = docs.withColumn(name, F.lit("x"))
    made = infill.restore(infill.fill_in_middle(docs))
    assert made.columns == ["id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert made.first()["restored"] == "a b c"
