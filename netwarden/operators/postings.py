"""Bounded top-k search over term weights: posting lists in blocks of like weight, opened only where they can change a result.

A posting is the weight of a term in a document, over the length of the document's vector, so a score is a sum of products. The postings of a term lie in
blocks by weight (``STEPS`` blocks for every halving), each with its largest weight; a block is dealt out over parts of the documents, so no
term's postings lie under one key.

A query opens blocks in two passes. The first opens its most promising small blocks, and scores the ``PROBE_DOCS`` documents of which it saw most; the
k-th of these scores bounds the k-th best from below. The second pass gives every term a cut such that cuts times query weights add up to no more than a share of
that bound: blocks below the cuts stay closed, those first whose closing saves most postings for the bound it takes, which are the large blocks of terms
that stand in most documents. A document that no open block shows cannot be among the best, nor can one whose sum over open blocks, with all that
closed ones could add, stays under the bound. The others get the rest of their score from their own weights, looked up by document and term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from netwarden.session import stored

#: Blocks for each halving of the weight, and blocks of a term; the last one has all smaller weights.
STEPS, LEVELS = 4, 64
#: Postings that the first pass opens for each query, about, and documents that it scores.
PROBE_ROWS, PROBE_DOCS = 512, 32
#: Share of the bound that closed blocks may take. The rest lets documents that are seen go without being scored.
CLOSED_SHARE = 0.6
#: Documents of a part; a block has at most about as many postings.
PART_DOCS = 100_000
#: Parts that one term's rows are spread over in a join with a table of terms, at most.
MOST_SPREAD = 64
#: Terms whose rows need no shuffle to meet a table of terms, and the length of the longest of them: about 10 MB.
COMMON_TERMS, COMMON_LENGTH = 100_000, 64


def parts_of(n: int, part_docs: int) -> int:
    return max(1, -(-n // part_docs))


def join_terms(rows: DataFrame, terms: DataFrame, key: str, parts: int) -> DataFrame:
    """Inner join with a table of one row per term; the rows of a term are spread over as many keys as there are parts of documents."""
    if (spread := min(parts, MOST_SPREAD)) == 1:
        return rows.join(terms, "term")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(spread)))
    return salted.join(terms.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long")))), ["term", "salt"]).drop("salt")


def join_common_terms(rows: DataFrame, terms: DataFrame, key: str, parts: int, common: int = COMMON_TERMS) -> DataFrame:
    """``join_terms`` that leaves the rows of the ``common`` terms in most documents (``df``) where they are; both tables are read twice, so they should be stored."""
    few = stored(terms.filter(F.length("term") <= COMMON_LENGTH).orderBy(F.desc("df"), "term").limit(common), "common")
    rare = rows.join(F.broadcast(few.select("term")), "term", "left_anti")
    return rows.join(F.broadcast(few), "term").unionByName(join_terms(rare, terms, key, parts))


def lengths(weights: DataFrame, key: str) -> DataFrame:
    """(key, length) of the vectors (key, term, w)."""
    return weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))


def normalized(weights: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, term, w) with the weights over the length of their vector."""
    return weights.join(known, key).select(key, "term", (F.col("w") / F.col("length")).alias("w"))


def blocks_of(postings: DataFrame, doc_key: str, parts: int) -> DataFrame:
    """The postings with their ``level``, from the heaviest, and ``part``."""
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.floor(-F.log2("w") * STEPS))).cast("int")
    return postings.withColumn("level", level).withColumn("part", F.pmod(F.xxhash64(doc_key), F.lit(parts)).cast("int"))


def lists_of(held: DataFrame) -> DataFrame:
    """(term, levels): every term's blocks as (level, top, n)."""
    blocks = held.groupBy("term", "level").agg(F.max("w").alias("top"), F.count(F.lit(1)).alias("n"))
    return blocks.groupBy("term").agg(F.collect_list(F.struct("level", "top", "n")).alias("levels"))


def postings_of(opened: DataFrame, held: DataFrame, parts: int) -> DataFrame:
    """The postings of opened blocks ``(..., term, level)``."""
    dealt = opened.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else opened.withColumn("part", F.lit(0))
    return dealt.join(held, ["term", "level", "part"])


def lower_bounds(blocks: DataFrame, asked: DataFrame, held: DataFrame, parts: int, query_key: str, doc_key: str, top_k: int) -> DataFrame:
    """(query, floor): what the k-th score of a query is at least, from documents in its most promising small blocks."""
    first = Window.partitionBy(query_key).orderBy((F.col("u") * F.col("top")).desc(), "term", "level").rowsBetween(Window.unboundedPreceding, -1)
    small = blocks.filter(F.col("n") <= PROBE_ROWS).withColumn("before", F.coalesce(F.sum("n").over(first), F.lit(0)))
    opened = small.filter(F.col("before") < PROBE_ROWS).select(query_key, "term", "u", "level")
    seen = postings_of(opened, held, parts).groupBy(query_key, doc_key).agg(F.sum(F.col("u") * F.col("w")).alias("seen"))
    place = lambda c: F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(c), doc_key))
    most = seen.withColumn("place", place("seen")).filter(F.col("place") <= max(PROBE_DOCS, top_k)).select(query_key, doc_key)
    scored = most.join(asked, query_key).join(held, [doc_key, "term"]).groupBy(query_key, doc_key).agg(F.sum(F.col("u") * F.col("w")).alias("floor"))
    return scored.withColumn("place", place("floor")).filter(F.col("place") == top_k).select(query_key, "floor")


def cuts(blocks: DataFrame, floors: DataFrame, query_key: str, min_score: float) -> DataFrame:
    """(query, term, u, level, top, closed, floor, slack): which blocks a query leaves closed, and what all of them could add to a score."""
    # Rounding differs by far less than the margins.
    floor = F.greatest(F.lit(min_score), F.coalesce(F.col("floor") * (1 - 1e-9), F.lit(0.0))) - 1e-12
    upwards = Window.partitionBy(query_key, "term").orderBy(F.desc("level"))
    cost = F.col("u") * (F.col("top") - F.coalesce(F.lag("top").over(upwards), F.lit(0.0)))
    # A block is closed after the lighter ones of its term, so it is as dear as the dearest of them.
    priced = blocks.withColumn("cost", cost).withColumn("price", F.max(F.col("cost") / F.col("n")).over(upwards.rowsBetween(Window.unboundedPreceding, 0)))
    cheapest = Window.partitionBy(query_key).orderBy("price", "term", F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)
    known = priced.withColumn("spent", F.sum("cost").over(cheapest)).join(floors, query_key, "left").withColumn("floor", floor)
    known = known.withColumn("closed", F.col("spent") <= CLOSED_SHARE * F.col("floor"))
    slack = F.coalesce(F.max(F.when(F.col("closed"), F.col("spent"))).over(Window.partitionBy(query_key)), F.lit(0.0))
    return known.select(query_key, "term", "u", "level", "n", "closed", "floor", slack.alias("slack"))


def candidates(cut: DataFrame, held: DataFrame, parts: int, query_key: str, doc_key: str) -> DataFrame:
    """(query, document, score so far) of the documents in open blocks that can still reach the query's bound."""
    met = postings_of(cut.filter("NOT closed").select(query_key, "term", "u", "level", "floor", "slack"), held, parts)
    summed = met.groupBy(query_key, doc_key).agg(F.sum(F.col("u") * F.col("w")).alias("score"), F.first("floor").alias("floor"), F.first("slack").alias("slack"))
    return summed.filter(F.col("score") + F.col("slack") > F.col("floor")).select(query_key, doc_key, "score")


def plans(postings: DataFrame, asked: DataFrame, doc_key: str, query_key: str, top_k: int, min_score: float, parts: int = 1, query_parts: int = 1) -> tuple[DataFrame, DataFrame]:
    """The postings in blocks, and every query's open and closed blocks, both materialized."""
    held = stored(blocks_of(postings, doc_key, parts), "postings")
    asked = asked.withColumnRenamed("w", "u")
    blocks = join_terms(asked, lists_of(held), query_key, query_parts).select(query_key, "term", "u", F.explode("levels").alias("b")).select(query_key, "term", "u", "b.*")
    blocks = stored(blocks, "blocks")
    return held, stored(cuts(blocks, lower_bounds(blocks, asked, held, parts, query_key, doc_key, top_k), query_key, min_score), "cuts")


def search(
    postings: DataFrame, asked: DataFrame, doc_key: str, query_key: str, top_k: int, min_score: float, parts: int = 1, query_parts: int = 1
) -> DataFrame:
    """(query, document, score, place): the best documents of every query above ``min_score``; ties go to the larger key.

    ``postings`` and ``asked`` hold the normalized weights of documents and queries, (key, term, w), none of them negative; postings of terms
    that nobody asks for may be left out.
    """
    held, cut = plans(postings, asked, doc_key, query_key, top_k, min_score, parts, query_parts)
    met = stored(candidates(cut, held, parts, query_key, doc_key), "met")
    # What lies in closed blocks, looked up in the documents that are left.
    unseen = cut.filter("closed").groupBy(query_key, "term").agg(F.first("u").alias("u"), F.min("level").alias("closed"))
    rest = met.select(query_key, doc_key).join(unseen, query_key).join(held, [doc_key, "term"]).filter(F.col("level") >= F.col("closed"))
    scored = met.unionByName(rest.select(query_key, doc_key, (F.col("u") * F.col("w")).alias("score")))
    scored = scored.groupBy(query_key, doc_key).agg(F.sum("score").alias("score")).filter(F.col("score") > min_score)
    best = Window.partitionBy(query_key).orderBy(F.round("score", 12).desc(), F.col(doc_key).desc())
    return scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top_k)
