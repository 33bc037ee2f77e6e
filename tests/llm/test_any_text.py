"""Texts and columns as they come: no operator stops at a long run of anything, or at a column of a name that it uses itself."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netwarden.llm import bpe, decontam, infill, language, pii, quality, repeats, rules, secrets, simhash

SIZE = 200_000
RUNS = {
    "comma-joined numbers": "1," * (SIZE // 2), "decimals": "0.25," * (SIZE // 5), "zeros": "0" * SIZE, "digits": "1 " * (SIZE // 2), "dots": "1." * (SIZE // 2),
    "one letter": "a" * SIZE, "one emoji": "😀" * (SIZE // 4), "keys": ("token=" + "Zx8kQ2" * 5 + " ") * (SIZE // 40), "lines": "\n" * SIZE, "brackets": "((" * (SIZE // 2), "hex": "0f" * (SIZE // 2),
}
NAMES = ["h", "chosen", "ids", "decodes", "n_tokens", "own", "pos", "fp", "node", "id", "w", "slots", "spans", "stats", "root", "a", "b", "at"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(400)]
    rows = [(k, t) for k, t in enumerate(RUNS.values())] + [(100 + k, " ".join(rng.choices(words, k=40))) for k in range(30)] + [(200, None), (201, "")]
    out = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    for name in NAMES:
        out = out.withColumn(name, F.lit("x"))
    return out


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(100, 130)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "alpha beta gamma 5 apples and 6 pears for Tom today")], "item_id long, text string")


GIVEN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
CASES = {
    "decontam": lambda d, m, i: decontam.without_benchmark(d, i),
    "quality": lambda d, m, i: quality.score(d, quality.fit(d, m)),
    "bpe": lambda d, m, i: bpe.decode(bpe.encode(d, *GIVEN), *GIVEN),
    "bpe columns": lambda d, m, i: bpe.with_ids(d, *GIVEN),
    "repeats": lambda d, m, i: repeats.without_repeats(d),
    "pii": lambda d, m, i: pii.search(d, {(3, "digits=10"): 3.0}),
    "secrets": lambda d, m, i: secrets.without_secrets(d),
    "language": lambda d, m, i: language.predict(d, language.fit(d)),
    "simhash": lambda d, m, i: simhash.near_duplicates(d),
    "rules": lambda d, m, i: rules.judge(d, rules.fit(d, m)),
    "infill": lambda d, m, i: infill.fill_in_middle(d),
}


@pytest.mark.parametrize("name", CASES)
def test_operators(docs, marks, items, name):
    made = CASES[name](docs, marks, items)
    assert len(set(made.columns)) == len(made.columns)
    assert len(made.collect()) == docs.count()


def test_stages(spark, docs, marks, items, tmp_path):
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        rows = spark.read.parquet(f"{tmp_path}/{name}")
    kept = rows.collect()
    assert {r["doc_id"] for r in kept} & set(range(100, 130))
    assert set(rows.columns) == {*docs.columns}
    assert all(r["decodes"] and r["n_tokens"] * 4 == len(r["ids"]) for r in kept)
