"""One query for each operator: it applies the operator to a whole table and derives the columns to compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netwarden.llm import bpe, chat, codes, decontam, infill, language, pii, quality, repeats, rules, secrets, simhash, vectors
from netwarden.llm.frames import held_out, table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, as it stands or with other values in its slots."""
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by the boosted trees."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held = held_out(F.col("id"), 5, 0).alias("held_out")
    return scored.select(F.col("id").alias("doc_id"), held, "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    import public_tokenizers

    given = tokenizer("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    done = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), *given), *given)
    return done.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def joined(found, kinds: list[str]):
    """``kind:start:end`` of an array of spans, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


@query
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 100 bytes that start earlier as well."""
    left = repeats.without_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return left.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: matches of the patterns, and what the random field adds."""
    docs = table(spark, sf_dir, "documents")
    found = pii.search(docs, pii.fit(docs))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
        F.sha2(joined(F.col("base"), pii.KINDS), 256).alias("base_sha256"), joined(F.col("spans"), pii.KINDS).alias("spans"),
    )


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: those of the patterns, and random tokens."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda x: x["kind"] < 3), secrets.KINDS), 256).alias("base_sha256"), joined(F.col("spans"), secrets.KINDS).alias("spans"),
    )


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and read back from the format; one more conversation says marker strings."""
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_conversations(turns, tokenizer("byte_bpe_50k.json")))


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 3, 1).alias("held_out"), "lang_pred", "score")


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=3)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the judgement of the learned decision list."""
    docs = table(spark, sf_dir, "documents")
    judged = rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels")))
    s = F.col(rules.STATISTICS)
    return judged.select(
        "doc_id", s["n_words"].alias("n_words"), s["word_chars"].alias("word_chars"), s["n_symbols"].alias("n_symbols"),
        s["lines"]["dup"].cast("long").alias("n_dup_lines"), s["n_repeat_words"].alias("n_repeat_words"),
        s["base_failed"].alias("base_failed"), s["kept"].alias("kept"),
    )


@query
def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.search(rows, rows.filter(F.col("vec_id") % 20 == 0), vectors.fit(rows))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed, and rebuilt from what was written."""
    filled = infill.restore(infill.fill_in_middle(table(spark, sf_dir, "documents")))
    return filled.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of every vector, its error and that of all rows with its label."""
    model = codes.fit(table(spark, sf_dir, "embeddings"))
    coded = codes.error_by_label(codes.encode(model, spark))
    digits = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.select(F.col("id").alias("vec_id"), digits.alias("code"), "error", "label_error", F.lit(model.digest()).alias("codebooks_sha256"))
