"""The stages on one another's results, and the registered queries."""

import corpus_pipeline
import public_tokenizers
import tiktoken
import __spark_entry__ as entry
from netwarden.llm import bpe, simhash
from netwarden.llm.frames import table

SF = "/root/testdata/sf0.001"


def test_every_query_is_registered():
    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality_rules" and len(corpus_pipeline.STAGES) == 5


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = [len(before)]
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, SF)
        if name != "tokenization":
            assert left.columns == docs.columns
        left.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    raw = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    codec = bpe.Codec(raw, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rows = docs.collect()
    for r in rows:
        assert memoryview(bytes(r["ids"])).cast("I").tolist() == library.encode_ordinary(r["text"]) and r["decodes"]
        assert r["n_tokens"] * 4 == len(r["ids"]) and r["n_chars"] == len(r["text"])
        assert "[SECRET]" in r["text"] or r["text"] == before[r["doc_id"]]
    shingles = {r["doc_id"]: set(simhash.shingles_of(before[r["doc_id"]], 5)) for r in rows}
    ids = sorted(shingles)
    close = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if len(shingles[a] & shingles[b]) > 0.9 * len(shingles[a] | shingles[b])]
    assert close == []


def test_run_and_empty_input(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for name in ("documents", "labels", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
