"""Alert enrichment, response planning and plan lint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netwarden.constants import ASSET_TARGETED, SOURCE_TARGETED, THREAT_MAP
from netwarden.functions.ordered import with_trailing_sums
from netwarden.functions.text import canonicalize
from netwarden.operators.retrieval import fill_template

UNKNOWN_SOURCE = "unknown-source"


def threat_mapping(spark: SparkSession) -> DataFrame:
    """The fixed attack-type table (15 rows)."""
    rows = [(k, *v) for k, v in THREAT_MAP.items()]
    return spark.createDataFrame(
        rows, "attack_type string, severity string, priority string, mitre_techniques array<string>, allowed_playbooks array<string>"
    )


def enrich(alerts: DataFrame, strict: bool = False) -> DataFrame:
    """Attach severity, priority, techniques and playbooks; unmapped types count as Normal."""
    mapping = threat_mapping(alerts.sparkSession)
    if strict and not alerts.join(F.broadcast(mapping), "attack_type", "left_anti").isEmpty():
        raise KeyError("an alert has an attack type without a mapping")
    known = F.coalesce(F.col("attack_type").isin(list(THREAT_MAP)), F.lit(False))
    keyed = alerts.withColumn("mapped", known).withColumn("__key", F.when(known, F.col("attack_type")).otherwise("Normal"))
    return keyed.join(F.broadcast(mapping.withColumnRenamed("attack_type", "__key")), "__key").drop("__key")


def mapping_gaps(classes: DataFrame, column: str = "attack_type") -> DataFrame:
    """Classes without a mapping, and mapping entries no class uses."""
    mapping = threat_mapping(classes.sparkSession).select("attack_type")
    seen = classes.select(F.col(column).alias("attack_type")).distinct()
    return seen.join(mapping, "attack_type", "left_anti").withColumn("gap", F.lit("unmapped")).unionByName(
        mapping.join(seen, "attack_type", "left_anti").withColumn("gap", F.lit("dead"))
    )


def is_emitted(min_confidence: float = 0.0, emit_normal: bool = False) -> Column:
    """Whether a scored record becomes an alert."""
    keep = F.col("confidence") >= min_confidence
    return keep if emit_normal else keep & (F.col("attack_type") != "Normal")


def emit_alerts(scored: DataFrame, min_confidence: float = 0.0, emit_normal: bool = False) -> DataFrame:
    """Drop Normal and weak predictions; clean the provenance fields of what remains."""
    return scored.filter(is_emitted(min_confidence, emit_normal)).withColumn("source_id", canonicalize(F.col("source_id"))).withColumn(
        "target_asset", canonicalize(F.col("target_asset"))
    )


def action_target(capability: Column, source: Column, asset: Column) -> Column:
    return F.when(capability.isin(SOURCE_TARGETED), source).otherwise(asset)


def expected_target(capability: Column, source: Column, asset: Column) -> Column:
    """The only target that agrees with the threat context; null where none is bound."""
    return F.when(capability.isin(SOURCE_TARGETED), source).when(capability.isin(ASSET_TARGETED), asset)


def with_repeat_activity(alerts: DataFrame, alert_id: str = "alert_id", ts: str = "ts", minutes: int = 30) -> DataFrame:
    """Mark alerts whose source already had an incident in the window."""
    keyed = alerts.withColumn("source", F.coalesce("source_id", F.lit(UNKNOWN_SOURCE)))
    counted = with_trailing_sums(keyed, ["source"], ts, alert_id, minutes * 60, {"prior_incidents": F.lit(1).cast("long")})
    return counted.withColumn("repeat", F.col("prior_incidents") > 0)


def plan_columns(context: DataFrame, alert_id: str, minutes: int) -> DataFrame:
    """Plan fields from enriched alerts that carry ``source`` and ``repeat``."""
    playbooks = F.col("allowed_playbooks")
    actions = F.transform(
        playbooks,
        lambda p: F.struct(p.alias("capability"), action_target(p, F.col("source_id"), F.col("target_asset")).alias("target")),
    )
    base = fill_template(
        F.col("severity"), F.col("attack_type"), F.col("source"),
        F.coalesce("target_asset", F.lit("unknown-asset")),
        F.when(F.size(playbooks) == 0, "no playbooks").otherwise(F.array_join(playbooks, ", ")),
    )
    suffix = F.concat(F.lit(" Repeat activity from "), F.col("source"), F.lit(f" observed in the last {minutes} minutes."))
    return (
        context.withColumn("actions", actions)
        .withColumn("rationale", F.when(F.col("repeat"), F.concat(base, suffix)).otherwise(base))
        .withColumn("plan_confidence", F.when(F.col("repeat"), F.least(F.lit(1.0), F.col("confidence") + 0.05)).otherwise(F.col("confidence")))
        # Derived from the alert, so a retried task produces the same id.
        .withColumn(
            "incident_id",
            F.concat_ws("-", "source", "priority", F.substring(F.md5(F.col(alert_id).cast("string")), 1, 8)),
        )
    )


def decide(alerts: DataFrame, alert_id: str = "alert_id", ts: str = "ts", minutes: int = 30) -> DataFrame:
    """Alert -> plan: one action per playbook, rationale by severity, repeat correlation."""
    return plan_columns(with_repeat_activity(enrich(alerts), alert_id, ts, minutes), alert_id, minutes)


def incident_history(plans: DataFrame, ts: str = "ts") -> DataFrame:
    """History rows recorded for planned incidents."""
    return plans.select(
        F.col("source").alias("entity_id"),
        F.lit("incident").alias("kind"),
        F.col(ts).alias("timestamp"),
        F.create_map(
            F.lit("attack_type"), "attack_type", F.lit("target_asset"), "target_asset",
            F.lit("severity"), "severity", F.lit("incident_id"), "incident_id",
        ).alias("payload"),
    )


def lint_plans(plans: DataFrame) -> DataFrame:
    """Reasons a proposed plan is unusable; clean plans get their null parameters dropped.

    Needs ``actions array<struct<capability, target, parameters map>>``, ``rationale`` and
    ``allowed_playbooks``.
    """
    named = F.transform("actions", lambda a: a["capability"])
    foreign = F.array_sort(F.array_except(named, F.col("allowed_playbooks")))
    allowed = F.array_sort("allowed_playbooks")
    reasons = F.array_compact(
        F.array(
            F.when(
                F.size(foreign) > 0,
                F.concat(
                    F.lit("capabilities not in allowed_playbooks: "), F.array_join(foreign, ", "),
                    F.lit(" (allowed: "), F.array_join(allowed, ", "), F.lit(")"),
                ),
            ),
            F.when(F.size("actions") == 0, "plan has no actions - propose at least one of the allowed playbooks"),
            F.when(F.trim("rationale") == "", "rationale is empty"),
        )
    )
    cleaned = F.transform(
        "actions",
        lambda a: F.struct(
            a["capability"].alias("capability"), a["target"].alias("target"),
            F.map_filter(a["parameters"], lambda _, v: v.isNotNull()).alias("parameters"),
        ),
    )
    return plans.withColumn("errors", reasons).withColumn("actions", F.when(F.size("errors") == 0, cleaned).otherwise(F.col("actions")))


def alert_coverage(plans: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Alerts per attack type and whether each expected capability was ever planned."""
    capabilities = F.transform("actions", lambda a: a["capability"])
    seen = [F.coalesce(F.bool_or(F.array_contains(capabilities, c)), F.lit(False)).alias(f"saw_{c}") for c in expected]
    return plans.groupBy("attack_type").agg(F.count(F.lit(1)).alias("alerts"), *seen)
