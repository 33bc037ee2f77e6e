"""Key figures, reputation, drift, forecasts and threshold validation over the audit log."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from netwarden.constants import THRESHOLD_GRID, TRUST_LEVELS, WEIGHT_GRID
from netwarden.functions.folds import RUN_ROWS, run_fold
from netwarden.functions.ordered import Blocks, order_blocks, with_rank

SCORES = ["semantic_risk", "context_consistency", "behavioral_trust", "trust_value"]


def acceptance_rate(audit: DataFrame) -> DataFrame:
    return audit.agg(
        F.count(F.lit(1)).alias("entries"),
        F.coalesce(F.avg(F.col("accepted").cast("double")), F.lit(0.0)).alias("acceptance_rate"),
    )


def trust_level_distribution(audit: DataFrame) -> DataFrame:
    """Entries per level, zero-filled, with unscored entries as ``hard_rejected``."""
    level = F.when(F.col("trust_value").isNull(), "hard_rejected").otherwise(F.col("trust_level"))
    counts = audit.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    levels = audit.sparkSession.createDataFrame([(x,) for x in [*TRUST_LEVELS, "hard_rejected"]], "level string")
    return levels.join(counts, "level", "left").select("level", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def agent_summary(audit: DataFrame) -> DataFrame:
    return audit.filter(F.col("agent_id").isNotNull()).groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("interactions"),
        F.count("trust_value").alias("scored"),
        F.avg(F.col("accepted").cast("double")).alias("acceptance_rate"),
        F.avg("trust_value").alias("mean_trust"),
        F.min("sequence").alias("first_seen"),
    )


def top_bottom_agents(summary: DataFrame, n: int = 3, min_scored: int = 2) -> DataFrame:
    """Best and worst ``n`` agents by mean trust; the sides may overlap."""
    eligible = summary.filter(F.col("scored") >= min_scored)
    sides = []
    for side, order in (
        ("top", [F.desc("mean_trust"), F.asc("first_seen")]),
        ("bottom", [F.asc("mean_trust"), F.desc("first_seen")]),
    ):
        picked = eligible.orderBy(*order).limit(n)  # the report's size is n by definition
        place = F.row_number().over(Window.partitionBy("side").orderBy(*order))
        sides.append(picked.withColumn("side", F.lit(side)).withColumn("place", place))
    return sides[0].unionByName(sides[1])


def kpi_report(audit: DataFrame, n: int = 3, min_scored: int = 2) -> DataFrame:
    """All key figures as (section, item, value) rows."""
    rate = acceptance_rate(audit).select(
        F.lit("overall").alias("section"), F.lit("acceptance_rate").alias("item"), F.col("acceptance_rate").alias("value")
    )
    levels = trust_level_distribution(audit).select(F.lit("level"), "level", F.col("n").cast("double"))
    summary = agent_summary(audit)
    agents = summary.select(F.lit("agent_acceptance"), "agent_id", "acceptance_rate")
    ranked = top_bottom_agents(summary, n, min_scored).select("side", "agent_id", "mean_trust")
    return rate.union(levels).union(agents).union(ranked)


def reputation(audit: DataFrame, recent: int = 5, penalty: float = 0.15) -> DataFrame:
    """Mean of the last scored values minus a penalty per violation.

    The row-number filter keeps at most ``recent`` rows per agent in every map task before
    the shuffle, so a very active agent costs no more than a quiet one.
    """
    known = audit.filter(F.col("agent_id").isNotNull())
    newest = Window.partitionBy("agent_id").orderBy(F.desc("sequence"))
    last = (
        known.filter(F.col("trust_value").isNotNull())
        .select("agent_id", "sequence", "trust_value")
        .withColumn("__rn", F.row_number().over(newest))
        .filter(F.col("__rn") <= recent)
        .groupBy("agent_id")
        .agg(F.avg("trust_value").alias("recent_trust"))
    )
    totals = known.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("interactions"), F.count_if(~F.col("accepted")).alias("violations")
    )
    score = F.coalesce("recent_trust", F.lit(0.0)) - F.lit(penalty) * F.col("violations")
    return totals.join(last, "agent_id", "left").select(
        "agent_id", "interactions", "violations", score.alias("reputation")
    )


def page_hinkley_step(state: dict, value: float, delta: float, limit: float) -> bool:
    """Advance the detector in place; True on an alarm (the state is then cleared)."""
    state["n"] += 1
    state["mean"] += (value - state["mean"]) / state["n"]
    state["total"] += value - state["mean"] - delta
    state["low"] = min(state["low"], state["total"])
    if state["total"] - state["low"] > limit:
        state.update(n=0, mean=0.0, total=0.0, low=0.0)
        return True
    return False


def fresh_detector() -> dict:
    return {"n": 0, "mean": 0.0, "total": 0.0, "low": 0.0}


def drift_points(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: str,
    delta: float = 0.005,
    limit: float = 1.0,
    blocks: Blocks | None = None,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Page-Hinkley alarms per key: (keys, position, order value); the detector restarts after each."""
    blocks = blocks or order_blocks(df, order)
    ranked = with_rank(df.select(*keys, order, value), keys, [order], blocks, "position")

    def fold(rows: pd.DataFrame, state: dict | None):
        state = dict(state) if state else fresh_detector()
        alarms = [page_hinkley_step(state, float(x), delta, limit) for x in rows[value]]
        return rows[["position", order]].assign(alarm=alarms), state

    kind = df.schema[order].dataType.simpleString()
    folded = run_fold(
        ranked, keys, ["position"], order_blocks(ranked, "position", rows=blocks.rows), fold,
        f"position long, {order} {kind}, alarm boolean", "n long, mean double, total double, low double", run_rows,
    )
    return folded.filter("alarm").select(*keys, (F.col("position") - 1).alias("index"), order)


def audit_drift(audit: DataFrame, delta: float = 0.005, limit: float = 1.0) -> DataFrame:
    """Alarms per agent and score field; entries without an agent count as ``unknown``."""
    scored = audit.filter(F.col("trust_value").isNotNull()).withColumn("agent_id", F.coalesce("agent_id", F.lit("unknown")))
    long = scored.select("agent_id", "sequence", *SCORES).unpivot(["agent_id", "sequence"], SCORES, "field", "score")
    return drift_points(long, ["agent_id", "field"], "sequence", "score", delta, limit)


def round_drift(trust_log: DataFrame, delta: float = 0.005, limit: float = 1.0) -> DataFrame:
    """Alarms per client over rounds; rounds without the client contribute nothing."""
    long = trust_log.select("round", F.explode("trust_scores").alias("client_id", "trust"))
    return drift_points(long, ["client_id"], "round", "trust", delta, limit)


def forecast(
    df: DataFrame,
    key: str,
    order: list[str],
    value: str,
    horizon: int = 3,
    band: float = 1.0,
    clip: tuple[float, float] | None = (0.0, 1.0),
    blocks: Blocks | None = None,
) -> DataFrame:
    """Least-squares trend per key, extended ``horizon`` steps with a residual band."""
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    blocks = blocks or order_blocks(df, order)
    x = with_rank(df.select(key, *order, value), [key], order, blocks, "__rn").withColumn(
        "__x", (F.col("__rn") - 1).cast("double")
    )
    fit = x.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.regr_slope(value, "__x"), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept(value, "__x"), F.max(value)).alias("__start"),
        F.sqrt(
            F.greatest(
                F.lit(0.0),
                F.coalesce(
                    F.regr_syy(value, "__x") - F.regr_slope(value, "__x") * F.regr_sxy(value, "__x"), F.lit(0.0)
                ) / F.count(F.lit(1)),
            )
        ).alias("__spread"),
    )
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    point = F.col("slope") * (F.col("n") + F.col("step") - 1) + F.col("__start")
    bounded = (lambda c: F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), c))) if clip else (lambda c: c)
    return steps.select(
        key, "n", "slope", "step",
        bounded(point).alias("point"),
        bounded(point - band * F.col("__spread")).alias("lower"),
        bounded(point + band * F.col("__spread")).alias("upper"),
    )


def trust_forecast(audit: DataFrame, field: str = "trust_value", horizon: int = 3) -> DataFrame:
    scored = audit.filter(F.col("trust_value").isNotNull()).withColumn("agent_id", F.coalesce("agent_id", F.lit("unknown")))
    direction = F.when(F.col("slope") > 1e-6, "rising").when(F.col("slope") < -1e-6, "falling").otherwise("flat")
    return forecast(scored, "agent_id", ["ts", "sequence"], field, horizon).withColumn("trend", direction)


def label_summary(labels: DataFrame, audit: DataFrame, min_samples: int = 20) -> DataFrame:
    """One row: labels, distinct labelled decisions, unmatched labels, readiness."""
    known = audit.select(F.col("sequence").alias("audit_sequence"), F.lit(True).alias("__known"))
    return labels.join(known, "audit_sequence", "left").agg(
        F.count(F.lit(1)).alias("labels"),
        F.countDistinct(F.when(F.col("__known"), F.col("audit_sequence"))).alias("labelled_decisions"),
        F.count_if(F.col("__known").isNull()).alias("unmatched"),
    ).withColumn("ready", F.col("labelled_decisions") >= min_samples)


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def agreement_by_level(labels: DataFrame, audit: DataFrame, min_samples: int = 20) -> DataFrame:
    """Share of labels that say "correct" per trust level; empty until enough decisions are labelled."""
    ready = label_summary(labels, audit, min_samples).select("ready")
    matched = labels.join(
        audit.select(F.col("sequence").alias("audit_sequence"), "trust_level"), "audit_sequence"
    ).filter(F.col("trust_level").isNotNull())
    levels = matched.groupBy("trust_level").agg(
        F.count(F.lit(1)).alias("n_labels"), F.count_if(F.col("label") == "correct").alias("n_correct")
    )
    gate = ready.filter("ready").select(F.lit(1).alias("__one"))
    return (
        levels.withColumn("__one", F.lit(1)).join(gate, "__one", "left_semi").drop("__one")
        .withColumn("agreement", F.col("n_correct") / F.col("n_labels"))
    )


def unmatched_labels(labels: DataFrame, audit: DataFrame) -> DataFrame:
    return labels.join(audit.select(F.col("sequence").alias("audit_sequence")), "audit_sequence", "left_anti")


def production_reviews(labels: DataFrame, audit: DataFrame) -> DataFrame:
    live = audit.filter(F.col("executor_mode") == "production").select(F.col("sequence").alias("audit_sequence"), "incident_id")
    return labels.join(live, "audit_sequence").select("audit_sequence", "label_id", "label", "analyst_id", "incident_id")


def weight_grid(feedback: DataFrame, weights=tuple(WEIGHT_GRID), thresholds=tuple(THRESHOLD_GRID)) -> DataFrame:
    """Precision, recall and F1 of every weight/threshold candidate, in one pass over the feedback."""
    want = F.col("expected_accepted")
    aggregates, cells = [], []
    for i, (ws, wc, wb) in enumerate(weights):
        trust = F.lit(ws) * (1.0 - F.col("semantic_risk")) + F.lit(wc) * F.col("consistency") + F.lit(wb) * F.col("behavioral_trust")
        for j, (low, medium, high) in enumerate(thresholds):
            said = trust >= F.lit(low)
            name = f"{i}_{j}"
            aggregates += [
                F.count_if(said & want).alias(f"tp_{name}"),
                F.count_if(said & ~want).alias(f"fp_{name}"),
                F.count_if(~said & want).alias(f"fn_{name}"),
            ]
            cells.append(
                F.struct(
                    F.lit(i).alias("weights_no"), F.lit(j).alias("thresholds_no"),
                    F.lit(ws).alias("ws"), F.lit(wc).alias("wc"), F.lit(wb).alias("wb"), F.lit(low).alias("low"),
                    F.col(f"tp_{name}").alias("tp"), F.col(f"fp_{name}").alias("fp"), F.col(f"fn_{name}").alias("fn"),
                )
            )
    grid = feedback.agg(*aggregates).select(F.inline(F.array(*cells)))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    scored = grid.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return scored.withColumn(
        "f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0))
    ).orderBy(F.desc("f1"), "weights_no", "thresholds_no")


def derive_labels(decisions: DataFrame, expected: str = "expected_accepted") -> DataFrame:
    """Label each decision by comparing it with what was expected."""
    label = (
        F.when(F.col("accepted") == F.col(expected), "correct")
        .when(F.col("accepted"), "false_positive")
        .otherwise("false_negative")
    )
    return decisions.withColumn("label", label)


def validation_report(decisions: DataFrame, min_samples: int = 20) -> DataFrame:
    """Agents, labels, reputation, readiness and the best weight candidate as (section, item, value) rows."""
    labelled = derive_labels(decisions)
    labels = labelled.select(F.col("sequence").alias("audit_sequence"), "label", F.col("incident_id").alias("label_id"))
    parts = [
        label_counts(labels).select(F.lit("labels").alias("section"), F.col("label").alias("item"), F.col("n").cast("double").alias("value")),
        agent_summary(decisions).select(F.lit("mean_trust"), "agent_id", "mean_trust"),
        reputation(decisions).select(F.lit("reputation"), "agent_id", "reputation"),
        label_summary(labels, decisions, min_samples).select(F.lit("ready"), F.lit("ready"), F.col("ready").cast("double")),
        agreement_by_level(labels, decisions, min_samples).select(F.lit("agreement"), "trust_level", "agreement"),
        weight_grid(
            decisions.filter(F.col("trust_value").isNotNull()).withColumn("consistency", F.col("context_consistency"))
        ).limit(5).select(F.lit("grid_f1"), F.concat_ws("_", "weights_no", "thresholds_no"), "f1"),
    ]
    report = parts[0]
    for part in parts[1:]:
        report = report.union(part)
    return report
