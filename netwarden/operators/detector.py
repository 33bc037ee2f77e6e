"""Multiclass traffic detector: weighted training, model choice, prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from netwarden.operators.features import class_weights
from netwarden.operators.metrics import summary_metrics


def train_detector(
    train: DataFrame, val: DataFrame, vector: str = "features", label: str = "y", strengths: Sequence[float] = (0.0, 0.01, 0.1)
) -> tuple[LogisticRegressionModel, float]:
    """Train with balanced class weights; keep the model with the best validation macro-F1."""
    weights = class_weights(train, label).select(label, "weight")
    ready = train.join(weights, label).withColumn("x", array_to_vector(vector)).withColumn(label, F.col(label).cast("double"))
    best = None
    for strength in strengths:
        model = LogisticRegression(featuresCol="x", labelCol=label, weightCol="weight", regParam=strength, maxIter=40, standardization=False).fit(ready)
        scored = predict(val, model, vector).withColumn("truth", F.col(label).cast("double"))
        f1 = summary_metrics(scored, "truth", "class_index").first()["macro_f1"]
        if best is None or f1 > best[1]:
            best = (model, f1)
    return best


def predict(df: DataFrame, model: LogisticRegressionModel, vector: str = "features") -> DataFrame:
    """Most likely class and its probability; also works on a stream."""
    scored = model.transform(df.withColumn("x", array_to_vector(vector)))
    probability = vector_to_array("probability")
    return scored.withColumn("confidence", F.array_max(probability)).withColumn("class_index", F.col("prediction")).drop(
        "x", "rawPrediction", "probability", "prediction"
    )


def class_name(index, classes: Sequence[str]):
    return F.element_at(F.array(*[F.lit(c) for c in classes]), index.cast("int") + 1)
