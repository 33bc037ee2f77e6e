"""Fit-once feature encoding: impute, standardize, one-hot, label encode, class weights."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from netwarden.functions.ordered import exact_quantiles
from netwarden.operators.clean import finite_or_null
from netwarden.operators.flows import quoted

MAX_CATEGORIES = 64
NUMERIC = (T.NumericType, T.BooleanType)


@dataclass(frozen=True)
class FeatureModel:
    """Everything learned from the training rows; a few numbers per column."""

    numeric: dict[str, list[float]] = field(default_factory=dict)  # column -> [median, mean, scale]
    categorical: dict[str, dict] = field(default_factory=dict)  # column -> {fill, categories, pooled}
    classes: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(len(c["categories"]) + bool(c["pooled"]) for c in self.categorical.values())

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "FeatureModel":
        return FeatureModel(**json.loads(text))


def _number(column: str) -> Column:
    return finite_or_null(quoted(column).cast("double"))


def numeric_stats(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, median, mean, scale) after median imputation; population deviation, 0 becomes 1."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), _number(c).alias("x")) for c in columns])
    medians = exact_quantiles(train.select(F.inline(cells)), ["column"], "x", {"median": 0.5})
    known = {r["column"]: r["median"] for r in medians.collect()}  # one row per column
    filled = {c: F.coalesce(_number(c), F.lit(known.get(c, 0.0))) for c in columns}
    moments = train.agg(
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(filled.values())],
        *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(filled.values())],
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(known.get(c, 0.0)).alias("median"), F.col(f"m{i}").alias("mean"),
            F.when(F.col(f"s{i}") == 0, 1.0).otherwise(F.col(f"s{i}")).alias("scale"),
        )
        for i, c in enumerate(columns)
    ])
    return moments.select(F.inline(rows))


def category_counts(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, fill): values of each column after most-frequent imputation."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns])
    counts = train.select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    present = counts.filter(F.col("value").isNotNull())
    fill = present.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("fill"))
    nulls = counts.filter(F.col("value").isNull()).select("column", F.col("n").alias("__nulls"))
    return (
        present.join(fill, "column").join(nulls, "column", "left")
        .withColumn("n", F.col("n") + F.when(F.col("value") == F.col("fill"), F.coalesce("__nulls", F.lit(0))).otherwise(0))
        .drop("__nulls")
    )


def category_ranks(train: DataFrame, columns: Sequence[str], top: int = MAX_CATEGORIES + 1) -> DataFrame:
    """The ``top`` most frequent values per column, ties by value.

    The rank filter keeps at most ``top`` rows per column in every task before the shuffle.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    ranked = category_counts(train, columns).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top)


def fit_features(train: DataFrame, columns: Sequence[str], label: str | None = None, max_categories: int = MAX_CATEGORIES) -> FeatureModel:
    """Learn the encoding from training rows only."""
    kinds = {f.name: f.dataType for f in train.schema}
    numeric = [c for c in columns if isinstance(kinds[c], NUMERIC)]
    textual = [c for c in columns if c not in numeric]
    stats = {r["column"]: [r["median"], r["mean"], r["scale"]] for r in numeric_stats(train, numeric).collect()} if numeric else {}
    categorical = {}
    if textual:
        top = category_ranks(train, textual, max_categories + 1).collect()  # <= 65 rows per column
        for c in textual:
            mine = sorted((r for r in top if r["column"] == c), key=lambda r: r["rank"])
            pooled = len(mine) > max_categories
            kept = [r["value"] for r in mine[: max_categories - 1 if pooled else max_categories]]
            categorical[c] = {"fill": mine[0]["fill"] if mine else "", "categories": sorted(kept), "pooled": pooled}
    classes = label_classes(train, label) if label else []
    return FeatureModel({c: stats[c] for c in numeric}, categorical, classes)


def pooled_values(train: DataFrame, model: FeatureModel) -> DataFrame:
    """(column, value) seen in training but pooled as infrequent."""
    pooled = [c for c, spec in model.categorical.items() if spec["pooled"]]
    if not pooled:
        return train.sparkSession.createDataFrame([], "column string, value string")
    rare = category_counts(train, pooled).select("column", "value")
    kept = F.lit(False)
    for c in pooled:
        kept = kept | ((F.col("column") == c) & F.col("value").isin(model.categorical[c]["categories"]))
    return rare.filter(~kept)


def encode(df: DataFrame, model: FeatureModel, rare: DataFrame | None = None, name: str = "features") -> DataFrame:
    """Append the feature vector; works on batch and streaming frames alike.

    Values never seen in training give zeros. When the model pools infrequent values, pass
    ``rare`` (see ``pooled_values``); only rows holding an infrequent or unseen value carry a
    join key, the others are spread by a key of their own, so frequent values cause no skew.
    """
    missing = [c for c in model.columns if c not in df.columns]
    if missing:
        raise KeyError(f"input columns missing: {missing}")
    parts = [
        (F.coalesce(_number(c), F.lit(median)) - F.lit(mean)) / F.lit(scale) for c, (median, mean, scale) in model.numeric.items()
    ]
    out = df
    for i, (c, spec) in enumerate(model.categorical.items()):
        value = F.coalesce(quoted(c).cast("string"), F.lit(spec["fill"]))
        parts += [(value == F.lit(category)).cast("double") for category in spec["categories"]]
        if spec["pooled"]:
            if rare is None:
                raise ValueError("this model pools infrequent values; pass the pooled_values table")
            seen = rare.filter(F.col("column") == c).select(F.col("value").alias(f"__k{i}"), F.lit(1.0).alias(f"__r{i}"))
            own = F.concat(F.lit("\u0000"), F.xxhash64(*[quoted(x) for x in df.columns]).cast("string"))
            out = out.withColumn(f"__k{i}", F.when(value.isin(spec["categories"]), own).otherwise(value)).join(seen, f"__k{i}", "left")
            parts.append(F.coalesce(F.col(f"__r{i}"), F.lit(0.0)))
    vector = F.array(*parts).cast("array<double>") if parts else F.array().cast("array<double>")
    helpers = [x for x in out.columns if x.startswith(("__k", "__r")) and x not in df.columns]
    return out.withColumn(name, vector).drop(*helpers)


def label_classes(df: DataFrame, label: str) -> list[str]:
    """Sorted class names; a null label is the class UNKNOWN."""
    return [r[0] for r in df.select(F.coalesce(quoted(label).cast("string"), F.lit("UNKNOWN")).alias("c")).distinct().orderBy("c").collect()]


def encode_label(df: DataFrame, label: str, classes: Sequence[str], name: str = "y") -> DataFrame:
    """Index of the label in the sorted classes; an unseen label is null."""
    text = F.coalesce(quoted(label).cast("string"), F.lit("UNKNOWN"))
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), text)
    return df.withColumn(name, F.when(position > 0, position - 1))


def class_weights(df: DataFrame, label: str, *keys: str) -> DataFrame:
    """Balanced weights N / (k * n_c), over the table or per key."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys)  # one row per class and key
    return counts.withColumn(
        "weight", F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    )
