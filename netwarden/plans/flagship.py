"""End-to-end jobs built from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netwarden.constants import EMA_ALPHA, HIGH_RISK
from netwarden.functions.ordered import order_blocks, with_ema
from netwarden.operators import alerts as alert_ops, anomaly, retrieval, trust
from netwarden.session import checkpointed


def behavioral_trust(plans: DataFrame) -> DataFrame:
    """``plan_id, behavioral_trust``: the agent's smoothed normality, from what its plans ask for and how often it plans."""
    asked = plans.select(
        F.col("plan_id").alias("sequence"), F.col("as_of").alias("ts"), "agent_id", F.size("actions").alias("action_count"),
        F.size(F.filter("actions", lambda a: a["capability"].isin(list(HIGH_RISK)))).alias("high_risk_count"), (F.size("actions") == 0).alias("policy_violation"),
    )
    features = trust.behaviour_features(asked, "sequence")
    # The windows leave one agent's rows together; scoring wants them spread.
    features = checkpointed(features.select("sequence", "ts", "agent_id", *trust.FEATURES).repartition("sequence"))
    scored = anomaly.behaviour_score(features, trust.FEATURES, anomaly.fit_forest(features, trust.FEATURES, key="sequence"))
    smoothed = with_ema(scored, ["agent_id"], ["ts", "sequence"], order_blocks(scored, ["ts", "sequence"]), "behaviour_score", EMA_ALPHA, 1.0, "behavioral_trust")
    return smoothed.select(F.col("sequence").alias("plan_id"), "behavioral_trust")


def run_incidents(alerts: DataFrame, agent: str = "responder", limits: dict | None = None) -> DataFrame:
    """Alerts -> plans -> trust decisions of one agent. Text risk comes from the rationale, behavioural trust from the agent's history,
    the hourly quota counts all its actions, and a nonce that it used before is a replay."""
    planned = alert_ops.decide(alerts)
    template = retrieval.fill_template(
        F.col("severity"), F.col("attack_type"), F.coalesce("source_id", F.lit("unknown-source")),
        F.coalesce("target_asset", F.lit("unknown-asset")),
        F.when(F.size("allowed_playbooks") == 0, "no playbooks").otherwise(F.array_join("allowed_playbooks", ", ")),
    )
    no_parameters = F.create_map().cast("map<string,struct<s:string,d:double,b:boolean>>")
    actions = F.transform(
        "actions", lambda a: F.struct(a["capability"].alias("capability"), a["target"].alias("target"), no_parameters.alias("parameters"))
    )
    plans = (
        planned.withColumn("plan_id", F.col("alert_id")).withColumn("template", template).withColumn("actions", actions)
        .withColumn("agent_id", F.lit(agent))
        .withColumn("as_of", F.col("ts")).withColumn("issued_at", F.col("ts"))
        # Derived from the incident, so a retried task repeats the same nonce.
        .withColumn("nonce", F.sha2("incident_id", 256))
    )
    # History, quota and replay each read the plans again.
    plans = checkpointed(plans)
    return trust.evaluate_plans(plans.join(behavioral_trust(plans), "plan_id"), limits or trust.LIMITS)
