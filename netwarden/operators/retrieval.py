"""TF-IDF retrieval and the text risk of a plan's rationale."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from netwarden.constants import CAPABILITY_PROSE, KNOWLEDGE, RATIONALE, THREAT_MAP
from netwarden.functions.text import unicode_regex, words
from netwarden.operators import postings
from netwarden.session import stored

MIN_SCORE = 0.05
NAMED_FLOOR = 0.6
#: Characters of text whose terms one task counts, about.
COUNTED_CHARS = 8_000_000


def term_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf). Texts are placed by key first, so counting needs no shuffle of the far larger token rows.

    A task holds the terms of its texts while it counts, so there are as many tasks as the length of all texts asks for.
    """
    chars = texts.agg(F.sum(F.length(text))).first()[0] or 0
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / COUNTED_CHARS))
    placed = texts.select(key, text).repartition(tasks, key)
    return placed.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term").agg(
        F.count(F.lit(1)).alias("tf")
    )


def inverse_document_frequency(counts: DataFrame, n_docs: int) -> DataFrame:
    """Smoothed idf per term; ``counts`` has one row per (document, term)."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select(
        "term", "df", (F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0).alias("idf")
    )


def weighted(counts: DataFrame, idf: DataFrame, key: str, parts: int = 1, stay: bool = False) -> DataFrame:
    """(key, term, w) with unnormalized tf*idf; terms outside the vocabulary drop out, and a term's rows are spread over ``parts``. With ``stay``,
    for stored tables, the rows of common terms are not shuffled."""
    join = postings.join_common_terms if stay else postings.join_terms
    return join(counts, idf, key, parts).select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))


def retrieve(
    corpus: DataFrame,
    queries: DataFrame,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    query_key: str = "query_id",
    query_text: str = "query",
    top_k: int = 2,
    part_docs: int = postings.PART_DOCS,
) -> DataFrame:
    """The ``top_k`` documents per query by TF-IDF cosine, above the minimum score.

    Only postings that can lift a document over the minimum and the query's k-th score are opened.
    """
    n_docs, n_queries = corpus.count(), queries.count()
    parts, query_parts = postings.parts_of(n_docs, part_docs), postings.parts_of(n_queries, part_docs)
    # Terms are counted once; document frequencies, weights and lengths read the counts.
    counts = stored(term_counts(corpus, doc_key, doc_text), "terms")
    idf = stored(inverse_document_frequency(counts, n_docs), "idf")
    docs, asked = weights_of(counts, term_counts(queries, query_key, query_text), idf, doc_key, query_key, parts, query_parts)
    return postings.search(docs, stored(asked, "asked"), doc_key, query_key, top_k, MIN_SCORE, parts, query_parts)


def weights_of(
    counts: DataFrame, asked_counts: DataFrame, idf: DataFrame, doc_key: str, query_key: str, parts: int = 1, query_parts: int = 1
) -> tuple[DataFrame, DataFrame]:
    """Normalized weights (key, term, w) of what documents hold of the terms asked for, and of the queries."""
    asked = weighted(asked_counts, idf, query_key, query_parts)
    wanted = idf.join(asked_counts.select("term").distinct(), "term", "left_semi")
    docs = postings.normalized(weighted(counts, wanted, doc_key, parts), postings.lengths(weighted(counts, idf, doc_key, parts, stay=True), doc_key), doc_key)
    return docs, postings.normalized(asked, postings.lengths(asked, query_key), query_key)


def knowledge_base(spark) -> DataFrame:
    return spark.createDataFrame(KNOWLEDGE, "doc_id string, title string, content string").withColumn(
        "text", F.concat_ws(" ", "title", "content")
    )


def alert_query(df: DataFrame) -> Column:
    return F.concat(
        F.col("attack_type"), F.lit(" attack from "), F.coalesce("source_id", F.lit("unknown")),
        F.lit(" targeting "), F.coalesce("target_asset", F.lit("unknown")),
    )


def alert_context(alerts: DataFrame, knowledge: DataFrame, top_k: int = 2) -> DataFrame:
    """Each distinct alert question with its snippets folded into one text."""
    asked = alerts.select(alert_query(alerts).alias("query")).distinct().withColumn("query_id", F.col("query"))
    found = retrieve(knowledge, asked, top_k=top_k).join(knowledge, "doc_id")
    line = F.concat(F.lit("- **["), "doc_id", F.lit("] "), "title", F.lit("**: "), "content")
    folded = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("__l"))
    text = F.concat_ws(
        "\n", F.lit("### Retrieved Security Knowledge & Playbook Rules:"), F.transform("__l", lambda x: x["line"])
    )
    return asked.select("query_id").join(folded, "query_id", "left").select(
        F.col("query_id").alias("query"), F.when(F.col("__l").isNull(), "").otherwise(text).alias("context")
    )


def _render(template: str, attack_type: str, source: str, asset: str, playbooks: str) -> str:
    return template.format(attack_type=attack_type, source_id=source, target_asset=asset, playbooks=playbooks)


def risk_vocabulary() -> dict[str, float]:
    """Term -> idf of the fixed rationale corpus (templates and rendered examples)."""
    texts = list(RATIONALE.values())
    for attack, (severity, _, _, playbooks) in THREAT_MAP.items():
        texts.append(_render(RATIONALE[severity], attack, "10.0.0.1", "asset-01", ", ".join(playbooks)))
        prose = ", ".join(CAPABILITY_PROSE.get(p, p) for p in playbooks)
        texts.append(
            f"Detected {attack} activity from the source targeting the asset; recommending {prose} to contain the threat."
        )
    df = Counter(term for text in texts for term in set(re.findall(r"\w{2,}", text.lower())))
    return {term: math.log((1 + len(texts)) / (1 + n)) + 1 for term, n in sorted(df.items())}


def fill_template(severity: Column, attack: Column, source: Column, asset: Column, playbooks: Column) -> Column:
    """The severity's rationale text with its fields filled in."""
    fields = {"attack_type": attack, "source_id": source, "target_asset": asset, "playbooks": playbooks}
    out = None
    for name, template in RATIONALE.items():
        pieces = [
            fields[p] if i % 2 else F.lit(p) for i, p in enumerate(re.split(r"\{(\w+)\}", template)) if p
        ]
        out = F.when(severity == name, F.concat(*pieces)) if out is None else out.when(severity == name, F.concat(*pieces))
    return out


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def _known_terms(text: Column, vocabulary: dict[str, float]) -> Column:
    """The vocabulary's terms in a text, as often as they occur."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(unicode_regex(r"\w{2,}")), F.lit(0))
    return F.filter(found, lambda t: t.isin(list(vocabulary)))


def _idf(vocabulary: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in vocabulary.items() for x in pair])


def _count(terms: Column, term: Column) -> Column:
    return F.size(F.filter(terms, lambda x: x == term))


def _term_weights(text: Column, vocabulary: dict[str, float]) -> Column:
    """Array of (term, n, tf * idf) for the vocabulary's terms in a text."""
    idf = _idf(vocabulary)

    def weights(known: Column) -> Column:
        return F.transform(
            F.array_distinct(known), lambda t: F.struct(t.alias("term"), _count(known, t).alias("n"), (_count(known, t) * idf[t]).alias("w"))
        )

    return _let(_known_terms(text, vocabulary), weights)


def _weight(vector: Column, term: Column) -> Column:
    return F.coalesce(F.get(F.filter(vector, lambda q: q["term"] == term), F.lit(0))["w"], F.lit(0.0))


def _total(vector: Column, of) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, p: acc + of(p))


def _cosine(a: Column, b: Column) -> Column:
    def of(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        norm = lambda v: F.sqrt(_total(v, lambda p: p["w"] * p["w"]))
        return F.when((F.size(x) > 0) & (F.size(y) > 0), _total(x, lambda p: p["w"] * _weight(y, p["term"])) / (norm(x) * norm(y))).otherwise(0.0)

    return _let(F.struct(a.alias("x"), b.alias("y")), of)


def _risk(cosine: Column, text: Column, attack: Column) -> Column:
    """1 - cosine within 0 and 1; a text that names the attack is no further than the floor."""
    plain = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    near = lambda c: F.when(F.contains(plain(text), plain(attack)), F.greatest(c, F.lit(NAMED_FLOOR))).otherwise(c)
    return _let(cosine / (1.0 + 1e-9), lambda c: 1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), near(c))))


def semantic_risk(rationale: Column, template: Column, attack: Column) -> Column:
    """1 - cosine between rationale and template over the fixed vocabulary.

    The vocabulary is a constant of a few hundred terms, so each row is scored on its own, by
    built-in functions and without a shuffle.
    """
    vocabulary = risk_vocabulary()
    return _risk(_cosine(_term_weights(rationale, vocabulary), _term_weights(template, vocabulary)), rationale, attack)


def explain_risk(plans: DataFrame, key: str, num_words: int = 8) -> DataFrame:
    """Risk change when each of the first distinct words is removed; needs rationale, template, attack_type.

    A text is made a vector once. Removing a word changes only the words that hold it, so product and length are corrected by the
    terms that these lose and gain.
    """
    vocabulary = risk_vocabulary()
    idf = _idf(vocabulary)
    words_of = F.filter(F.split(F.coalesce("rationale", F.lit("")), r"[\s\p{Z}]+"), lambda w: w != "")
    vectors = plans.select(
        key, "rationale", "attack_type", words_of.alias("words"), _term_weights(F.col("rationale"), vocabulary).alias("x"),
        _term_weights(F.col("template"), vocabulary).alias("y"),
    )
    c = F.col
    scored = vectors.select(
        "*", _total(c("x"), lambda p: p["w"] * _weight(c("y"), p["term"])).alias("dot"), _total(c("x"), lambda p: p["w"] * p["w"]).alias("xx"),
        _total(c("y"), lambda p: p["w"] * p["w"]).alias("yy"), _total(c("x"), lambda p: p["n"].cast("double")).alias("n"),
    )
    cosine = lambda dot, xx, n: F.when((n > 0) & (c("yy") > 0), dot / F.sqrt(xx * c("yy"))).otherwise(0.0)
    base = scored.withColumn("base", _risk(cosine(c("dot"), c("xx"), c("n")), c("rationale"), c("attack_type")))
    exploded = base.select("*", F.explode(F.slice(F.array_distinct("words"), 1, num_words)).alias("word"))
    touched = F.array_join(F.filter("words", lambda w: F.contains(w, c("word"))), " ")
    pair = F.struct(
        _known_terms(touched, vocabulary).alias("lost"), _known_terms(F.replace(touched, c("word"), F.lit("")), vocabulary).alias("gained")
    )
    changes = _let(pair, lambda p: F.transform(
        F.array_distinct(F.concat(p["lost"], p["gained"])),
        lambda t: F.struct(t.alias("term"), (_count(p["gained"], t) - _count(p["lost"], t)).alias("n")),
    ))
    weighed = F.transform(changes, lambda d: F.struct(
        d["n"].alias("n"), (d["n"] * idf[d["term"]]).alias("w"), _weight(c("x"), d["term"]).alias("x"), _weight(c("y"), d["term"]).alias("y")
    ))
    without = _let(weighed, lambda d: cosine(
        c("dot") + _total(d, lambda p: p["w"] * p["y"]), c("xx") + _total(d, lambda p: p["w"] * (2.0 * p["x"] + p["w"])),
        c("n") + _total(d, lambda p: p["n"].cast("double")),
    ))
    masked = F.replace("rationale", c("word"), F.lit(""))
    return exploded.select(key, "word", (c("base") - _risk(without, masked, c("attack_type"))).alias("delta"))
