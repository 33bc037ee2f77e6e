"""Isolation-forest scoring of behaviour features."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

TREES = 100
SAMPLE = 256


def _path_average(n: int) -> float:
    """Mean unsuccessful-search depth of a binary tree over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(points: np.ndarray, rng: np.random.Generator, depth: int, limit: int):
    """Nested lists: [feature, threshold, left, right] or a leaf's expected depth."""
    spread = np.flatnonzero(points.max(axis=0) > points.min(axis=0)) if len(points) > 1 else []
    if depth >= limit or len(spread) == 0:
        return depth + _path_average(len(points))
    feature = int(rng.choice(spread))
    low, high = points[:, feature].min(), points[:, feature].max()
    threshold = float(rng.uniform(low, high))
    left = points[:, feature] <= threshold
    return [feature, threshold, _grow(points[left], rng, depth + 1, limit), _grow(points[~left], rng, depth + 1, limit)]


def _depths(tree, points: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    if not isinstance(tree, list):
        out[rows] += tree
        return
    feature, threshold, left, right = tree
    goes_left = points[rows, feature] <= threshold
    if goes_left.any():
        _depths(left, points, rows[goes_left], out)
    if not goes_left.all():
        _depths(right, points, rows[~goes_left], out)


def fit_forest(population: DataFrame, features: Sequence[str], key: str, seed: int = 0, trees: int = TREES, max_samples: int = SAMPLE) -> dict:
    """A forest in which each tree has its own sample of ``max_samples`` rows out of the whole population.

    A row is a candidate of a tree if its hash for that tree is small enough that twice the sample is expected; the smallest
    hashes are the sample, so copies of a task draw the same rows. Trees are grown in tasks, one group of at most ``max_samples``
    rows for each; only the grown trees reach the driver.
    """
    n = population.count()
    limit = max(1, math.ceil(math.log2(max(min(max_samples, n), 2))))
    share = min(1.0, (2 * max_samples + 64) / max(n, 1))
    bound = int(share * (1 << 32))
    draw = lambda t: F.pmod(F.xxhash64(t, F.lit(seed), F.col(key)), F.lit(1 << 32))
    chosen = F.filter(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), draw(t).alias("draw"))), lambda x: x["draw"] < bound)
    points = population.select(F.col(key).alias("__key"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.inline(chosen))
    order = Window.partitionBy("tree").orderBy("draw", "__key")
    sample = points.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= max_samples).drop("__key")
    columns = [f"x{i}" for i in range(len(features))]

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        values = rows.sort_values("place")[columns].to_numpy()
        return pd.DataFrame({"tree": [tree], "size": [len(rows)], "grown": [json.dumps(_grow(values, np.random.default_rng([seed, tree]), 0, limit))]})

    grown = sample.groupBy("tree").applyInPandas(grow, "tree int, size int, grown string").orderBy("tree").collect()  # one row a tree
    size = max((r["size"] for r in grown), default=1)
    return {"trees": [json.loads(r["grown"]) for r in grown], "scale": _path_average(size) or 1.0}


def behaviour_score(df: DataFrame, features: Sequence[str], forest: dict, name: str = "behaviour_score") -> DataFrame:
    """Normality in (0, 1): logistic of four times the forest's decision value."""

    @F.pandas_udf(T.DoubleType())
    def score(*columns: pd.Series) -> pd.Series:
        points = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        depth = np.zeros(len(points))
        for tree in forest["trees"]:
            _depths(tree, points, np.arange(len(points)), depth)
        decision = 0.5 - np.power(2.0, -(depth / len(forest["trees"])) / forest["scale"])
        return pd.Series(1.0 / (1.0 + np.exp(-4.0 * decision)))

    return df.withColumn(name, score(*[F.col(f).cast("double") for f in features]))
