"""Classification metrics over (true, predicted) label columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """Count per (true, pred) pair that occurs, labels as text."""
    return rows.groupBy(F.col(true).cast("string").alias("true"), F.col(pred).cast("string").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_report(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """Precision, recall, F1, support per class, plus macro and weighted averages."""
    cells = confusion(rows, true, pred)
    actual = cells.groupBy(F.col("true").alias("label")).agg(
        F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n"))), F.lit(0)).alias("tp")
    )
    said = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("said"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    classes = actual.join(said, "label", "full_outer").select("label", zero("support").alias("support"), zero("tp").alias("tp"), zero("said").alias("said"))
    p, r = _ratio(F.col("tp"), F.col("said")), _ratio(F.col("tp"), F.col("support"))
    per_class = classes.select("label", p.alias("precision"), r.alias("recall"), _ratio(2.0 * p * r, p + r).alias("f1"), "support")
    weight = F.sum("support")
    averages = per_class.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * F.col("support")) / weight).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
        weight.alias("support"),
    )
    rows_of = lambda kind: F.struct(
        F.lit(f"{kind} avg").alias("label"), *[F.col(f"{kind}_{m}").alias(m) for m in ("precision", "recall", "f1")], F.col("support")
    )
    return per_class.unionByName(averages.select(F.inline(F.array(rows_of("macro"), rows_of("weighted")))))


def summary_metrics(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """Accuracy and macro precision/recall/F1; a class without predictions counts as 0."""
    report = class_report(rows, true, pred).filter("label = 'macro avg'")
    accuracy = rows.agg(F.avg((F.col(true) == F.col(pred)).cast("double")).alias("accuracy"))
    return (
        report.select(*[F.col(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")], F.lit(1).alias("__one"))
        .join(accuracy.withColumn("__one", F.lit(1)), "__one").drop("__one")
    )


def confusion_matrix(rows: DataFrame, true: str, pred: str) -> DataFrame:
    """Dense matrix over the labels present, in long form; its size is set by the classes."""
    cells = confusion(rows, true, pred)
    labels = cells.select(F.explode(F.array("true", "pred")).alias("label")).distinct()
    every = labels.agg(F.array_sort(F.collect_set("label")).alias("labels"))
    grid = every.select(F.explode("labels").alias("true"), "labels").select("true", F.explode("labels").alias("pred"))
    return grid.join(cells, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def lowest_recall(rows: DataFrame, true: str, pred: str, n: int = 5) -> DataFrame:
    report = class_report(rows, true, pred).filter(~F.col("label").isin("macro avg", "weighted avg"))
    return report.orderBy("recall", "label").limit(n).select("label", "recall", "support")


def binary_metrics(rows: DataFrame, true: Column, pred: Column) -> DataFrame:
    """Positive-vs-negative counts and rates for boolean columns."""
    counted = rows.agg(
        F.count_if(true & pred).alias("tp"), F.count_if(~true & pred).alias("fp"),
        F.count_if(~true & ~pred).alias("tn"), F.count_if(true & ~pred).alias("fn"),
    )
    c = F.col
    p, r = _ratio(c("tp"), c("tp") + c("fp")), _ratio(c("tp"), c("tp") + c("fn"))
    return counted.select(
        "tp", "fp", "tn", "fn",
        _ratio(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"),
        p.alias("precision"), r.alias("recall"), _ratio(2.0 * p * r, p + r).alias("f1"),
        _ratio(c("fp"), c("fp") + c("tn")).alias("fpr"), _ratio(c("fn"), c("fn") + c("tp")).alias("fnr"),
    )


def attack_detection(rows: DataFrame, true: str, pred: str, normal: str = "Normal") -> DataFrame:
    """How well any attack is told from normal traffic."""
    return binary_metrics(rows, F.col(true) != normal, F.col(pred) != normal).select("precision", "recall")


def run_statistics(scored: DataFrame, min_confidence: float = 0.0, emit_normal: bool = False) -> DataFrame:
    """Records read, alerts emitted and suppressed."""
    keep = F.col("confidence") >= min_confidence
    if not emit_normal:
        keep = keep & (F.col("attack_type") != "Normal")
    return scored.agg(
        F.count(F.lit(1)).alias("records_read"), F.count_if(keep).alias("alerts_emitted"), F.count_if(~keep).alias("alerts_suppressed")
    )
