"""Quality rules: document statistics and a decision list learned from labels, both as Spark expressions.

The list is learned by sequential covering. A rule is a conjunction of thresholds on statistics; it grows, condition by condition, by
information gained on two thirds of the labelled rows, loses its last conditions again while that raises its worth on the other third, and is
kept if nearly all it covers there is of low quality. Rows it covers leave, and the next rule is sought. The list becomes one
``CASE`` expression, so a document is judged by the first rule that holds.

The labelled sample is bounded by ``max_rows``, the rows with the smallest hash of their id. Null texts have no words; empty texts too;
repeated rows are judged alike; an empty table gives an empty result, and without labels of both kinds the list is empty and keeps everything.
Columns of any name may come along: statistics live in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netwarden.llm.frames import let, words

WINDOW = 5
#: Least words, and largest percentage of words in repeated windows, of the base rule.
LEAST_WORDS, MOST_REPEATED = 10, 20
STATISTICS = "__quality_statistics"
#: What rules may test: signs of junk that do not depend on the language, unlike the length of words.
FEATURES = ["symbol_rate", "repeat_rate", "dup_line_rate", "n_words"]


def _repeat_words(w: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words occurring at least twice."""
    spans = F.when(F.size(w) >= WINDOW, F.sequence(F.lit(0), F.size(w) - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(spans, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def covered(starts: Column) -> Column:
        own = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0), lambda a, x: a + x)

    def repeated(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]))
        return let(F.array_sort(F.transform(twice, lambda p: p["i"])), covered)

    def count(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, repeated))

    return let(hashes, count)


def statistics(text: Column) -> Column:
    """Struct of the counts of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def over(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    return let(words(text), over)


def features(s: Column) -> dict[str, Column]:
    """Scale-free statistics a rule may test."""
    n = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return {
        "symbol_rate": s["n_symbols"] / n,
        "repeat_rate": s["n_repeat_words"] / n,
        "dup_line_rate": s["lines"]["dup"] / F.greatest(s["lines"]["n"], F.lit(1)),
        "n_words": s["n_words"].cast("double"),
    }


def base_failed(s: Column) -> Column:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > MOST_REPEATED * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        values = x[:, FEATURES.index(self.feature)]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, s: Column) -> Column:
        value = features(s)[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    mask = np.ones(len(x), bool)
    for condition in rule:
        mask &= condition.holds(x)
    return mask


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Information gained per covered row of the sought class, times their number."""
    return p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))


def _grow(x: np.ndarray, bad: np.ndarray, cuts: int) -> Rule:
    rule: Rule = ()
    mask = np.ones(len(x), bool)
    while len(rule) < 4 and (p0 := bad[mask].sum()) and (n0 := (~bad[mask]).sum()):
        best = (1e-6, None)
        for f, name in enumerate(FEATURES):
            values, marks = x[mask, f], bad[mask]
            order = np.argsort(values, kind="stable")
            values, marks = values[order], np.cumsum(marks[order])
            ends = np.flatnonzero(values[1:] > values[:-1])
            if not len(ends):
                continue
            ends = ends[np.unique(np.linspace(0, len(ends) - 1, cuts).astype(int))]
            p, total = marks[ends].astype(float), ends + 1.0
            middle = (values[ends] + values[ends + 1]) / 2
            for above, pp, nn in ((False, p, total - p), (True, p0 - p, n0 - (total - p))):
                gains = _gain(p0, n0, pp, nn)
                at = int(np.argmax(gains))
                if gains[at] > best[0]:
                    best = (gains[at], Condition(name, above, float(middle[at])))
        if best[1] is None:
            break
        rule += (best[1],)
        mask &= best[1].holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> tuple[Rule, float, float]:
    """The prefix of the rule worth most on rows it has not seen, its share of low quality there, and that share by Laplace's rule."""
    def worth(r: Rule) -> float:
        mask = covers(r, x)
        p, n = bad[mask].sum(), (~bad[mask]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=())
    hits, n = bad[covers(best, x)].sum(), covers(best, x).sum()
    return (best, hits / n, (hits + 1) / (n + 2)) if best and n else ((), 0.0, 0.0)


def learn(x: np.ndarray, bad: np.ndarray, held: np.ndarray, min_precision: float = 0.98, min_sure: float = 0.85, max_rules: int = 16, cuts: int = 256) -> list[Rule]:
    """Ordered rules for rows marked ``bad``; ``held`` rows only prune. A rule must be right on ``min_precision`` of the held rows it
    covers, and on enough of them for ``min_sure`` by Laplace's rule."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < max_rules:
        rule = _grow(x[left & ~held], bad[left & ~held], cuts)
        rule, precision, sure = _prune(rule, x[left & held], bad[left & held])
        if precision < min_precision or sure < min_sure:
            return rules
        rules.append(rule)
        left &= ~covers(rule, x)
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_precision: float = 0.98, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules learned from at most ``max_rows`` labelled documents."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.select(F.col("doc_id").alias("label_id"), F.col("quality"), F.xxhash64("doc_id").alias("h")).orderBy("h", "label_id", "quality").limit(max_rows)
    # At most max_rows rows of three numbers, whatever the input.
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marks), F.col("id") == F.col("label_id"))
    measured = sample.select("quality", "h", statistics(F.col("text")).alias("s"))
    rows = measured.select(F.col("quality") == 0, F.pmod("h", F.lit(3)) == 0, *[c.alias(n) for n, c in features(F.col("s")).items()]).orderBy("h").limit(max_rows).collect()
    if not rows:
        return []
    data = np.array([tuple(r) for r in rows], float)
    return learn(data[:, 2:], data[:, 0] == 1, data[:, 1] == 1, min_precision)


def verdict(rules: list[Rule], s: Column) -> Column:
    """Whether a document stays: the first rule that holds says no."""
    case = None
    for rule in rules:
        test = F.lit(True)
        for condition in rule:
            test = test & condition.column(s)
        case = F.when(test, F.lit(False)) if case is None else case.when(test, F.lit(False))
    return F.lit(True) if case is None else case.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with the struct of statistics; ``kept`` in it is the judgement."""
    measured = docs.withColumn(STATISTICS, statistics(F.col(text_col)))
    s = F.col(STATISTICS)
    failed = base_failed(s)
    return measured.withColumn(STATISTICS, s.withField("base_failed", failed).withField("kept", ~failed & verdict(rules, s)))


def good_only(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass base rule and decision list, columns unchanged."""
    rules = fit(docs, labels, text_col=text_col)
    # One condition over one evaluation; a column of its own would be computed again in the filter.
    return docs.filter(let(statistics(F.col(text_col)), lambda s: ~base_failed(s) & verdict(rules, s)))
