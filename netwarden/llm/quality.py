"""Quality classifier: histogram gradient-boosted trees over document statistics, scored by array traversal.

Every statistic is cut into at most ``BINS`` quantile bins. A tree of fixed depth is grown level by level from histograms of gradients and
curvatures over all its nodes at once. The finished trees lie in three arrays (statistic, threshold, leaf value), so a batch of documents goes down
all trees with ``DEPTH`` numpy steps.

Labels are taken from at most ``max_rows`` rows, those with the smallest hash of the id. A null text counts as an empty text and is scored as
such; repeated rows get the same score; without labels of both kinds every score is the share of label 1 (one half without any label); an empty
table gives an empty result; columns other than the id and the text are ignored. Statistics cover whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netwarden.llm.frames import held_out, map_batches

BINS, DEPTH, TREES, RATE, PENALTY, LEAST_CURVATURE = 64, 4, 60, 0.15, 1.0, 2.0
STATISTICS = [
    "words", "mean_word", "longest_word", "distinct_words", "repeated_next", "repeated_threes", "lines", "repeated_lines", "letters", "digits", "capitals",
    "marks", "spaces", "high_bytes", "bracketed", "common_word",
]


def _byte_classes() -> np.ndarray:
    kinds = np.zeros((256, 7), np.float64)
    for b in range(256):
        c = chr(b)
        kinds[b] = [b < 128 and c.isalpha(), b < 128 and c.isdigit(), b < 128 and c.isupper(), c in "#*$%&|<>", b < 128 and c.isspace(), b >= 128, c in "[](){}"]
    return kinds


CLASSES = _byte_classes()


def statistics_of(text: str | None) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``; counts as shares but for words and lines."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    sizes = list(map(len, words))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    threes = len(words) - 2 - len(set(zip(words, words[1:], words[2:]))) if len(words) > 2 else 0
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASSES / max(1, len(data))
    letters, digits, capitals, marks, spaces, high, bracketed = shares.tolist()
    return [
        float(len(words)), sum(sizes) / n, float(max(sizes, default=0)), len(counts) / n, sum(map(eq, words, words[1:])) / n, threes / n, float(len(lines)),
        (len(lines) - len(set(lines))) / max(1, len(lines)), letters, digits, capitals, marks, spaces, high, bracketed, max(counts.values(), default=0) / n,
    ]


@dataclass(frozen=True)
class Forest:
    """Complete trees as heaps: inner node j goes to 2j+1, or to 2j+2 when its statistic is above its threshold."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        if len(self.feature):
            trees = np.arange(len(self.feature))
            at = np.zeros((len(x), len(trees)), np.int64)
            rows = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
            total += self.leaf[trees, at - (2**DEPTH - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def _constant(share: float) -> Forest:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return Forest(float(np.log(share / (1 - share))), np.zeros((0, 2**DEPTH - 1), np.int64), np.zeros((0, 2**DEPTH - 1)), np.zeros((0, 2**DEPTH)))


def train(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for the log-likelihood of ``y`` (0 or 1)."""
    if not len(y):
        return _constant(0.5)
    start = _constant(float(y.mean()))
    if y.min() == y.max():
        return start
    cuts = []
    for column in x.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) < BINS else np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])))
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    total = np.full(len(y), start.start)
    features, limits, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        gradient, curvature = y - p, p * (1 - p)
        feature, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            chosen = np.full((width, 2), -1)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                size = len(cut) + 1
                key = (at - first) * size + binned[:, f]
                g = np.bincount(key, gradient, width * size).reshape(width, size).cumsum(axis=1)
                h = np.bincount(key, curvature, width * size).reshape(width, size).cumsum(axis=1)
                gl, hl, g0, h0 = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + PENALTY) + (g0 - gl) ** 2 / (h0 - hl + PENALTY) - g0**2 / (h0 + PENALTY)
                gain[(hl < LEAST_CURVATURE) | (h0 - hl < LEAST_CURVATURE)] = 0
                most = gain.argmax(axis=1)
                value = gain[np.arange(width), most]
                better = value > best
                best[better] = value[better]
                chosen[better] = np.stack([np.full(width, f), most], axis=1)[better]
            for k, (f, cut) in enumerate(chosen):
                if f >= 0:
                    feature[first + k], threshold[first + k] = f, cuts[f][cut]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        ends = at - (2**DEPTH - 1)
        leaf = RATE * np.bincount(ends, gradient, 2**DEPTH) / (np.bincount(ends, curvature, 2**DEPTH) + PENALTY)
        total += leaf[ends]
        features.append(feature)
        limits.append(threshold)
        leaves.append(leaf)
    return Forest(start.start, np.array(features), np.array(limits), np.array(leaves))


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([statistics_of(t) for t in texts.to_pylist()])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """A forest learned from at most ``max_rows`` labelled documents whose id is not held out."""
    marks = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0))
    marks = marks.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("int").alias("quality"), F.xxhash64("doc_id").alias("h")).orderBy("h", "quality").limit(max_rows)
    # At most max_rows rows of three numbers, whatever the input.
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marks), F.col("id") == F.col("label_id"))

    def measure(batch: pa.RecordBatch) -> dict:
        return {"quality": batch.column(0), "h": batch.column(1), "x": pa.array(list(_matrix(batch.column(2))), pa.list_(pa.float64()))}

    rows = map_batches(sample.select("quality", "h", "text"), measure, "quality int, h bigint, x array<double>").orderBy("h", "quality", "x").limit(max_rows).collect()
    return train(np.array([r.x for r in rows]), np.array([float(r.quality == 1) for r in rows]))


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score)``: how likely label 1 is for every text."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "score": forest.score(_matrix(batch.column(1)))}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), run, f"id {kind}, score double")
