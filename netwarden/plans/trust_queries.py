"""Trust boundary checks, scores and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from netwarden.constants import CAPABILITIES, HIGH_RISK, LOW_RISK
from netwarden import fixtures
from netwarden.operators import alerts, anomaly, audit, retrieval, trust
from netwarden.plans.alert_queries import _MAPPING, _word_sql
from netwarden.plans.registry import Tables, query

FEW = {**trust.LIMITS, "max_actions": 3, "actions_per_hour": 4}


def timestamp(micros):
    return F.timestamp_micros(F.col(micros)).cast("timestamp_ntz")


def action_list(context):
    """Adds ``actions``, built from each row's own columns."""
    none = lambda kind: F.lit(None).cast(kind)
    text = lambda c: F.struct(c.alias("s"), none("double").alias("d"), none("boolean").alias("b"))
    number = lambda c: F.struct(none("string").alias("s"), c.alias("d"), none("boolean").alias("b"))
    fields = ", ".join(f"'{name}', {sql}" for name, sql in fixtures.ACTION_FIELDS.items())
    raw = F.expr(f"transform(sequence(0L, plan_id % 4), k -> named_struct({fields}))")
    built = lambda a: F.struct(
        a["capability"].alias("capability"), a["target"].alias("target"),
        F.create_map(F.lit("note"), text(a["note"]), F.lit("amount"), number(a["amount"])).alias("parameters"),
    )
    return context.withColumn("actions", F.transform(raw, built))


def plans(t: Tables):
    """One plan per order: its actions, threat context and session."""
    context = alerts.enrich(action_list(t.plan_context))
    return (
        context.withColumn("as_of", timestamp("as_of_us")).withColumn("issued_at", timestamp("issued_us"))
        .withColumn("incident_id", F.concat(F.lit("plan-"), F.col("plan_id").cast("string")))
    )


def joined(column: str):
    return F.array_join(column, "; ").alias("reasons")


def _names(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _finding(value: str) -> str:
    word = _word_sql(f"lower({value})", f"translate(lower({value}), '01345$7@!', 'oieasstai')")
    return f"""CASE WHEN regexp_matches({value}, '^[A-Za-z0-9+/]{{16,}}={{0,2}}$') AND length({value}) % 4 = 0 THEN 'looks base64-encoded (decodes to: ''' || decode(from_base64({value})) || ''')'
 WHEN regexp_matches({value}, '^(?:[0-9a-fA-F]{{2}}){{8,}}$') THEN 'looks hex-encoded' WHEN regexp_matches({value}, '%[0-9a-fA-F]{{2}}') THEN 'contains URL-percent-encoding'
 ELSE 'looks leetspeak-obfuscated (decodes to contain ''' || {word} || ''')' END"""


_PLANS = f"""{_MAPPING}, {fixtures.oracle_actions()},
actions AS (SELECT * FROM plan_actions),
context AS (SELECT c.*, m.severity, m.playbooks, 'plan-' || plan_id AS incident_id FROM plan_context c JOIN mapping m ON m.key = c.attack_type ),
found AS (SELECT plan_id, string_agg(concat_ws('; ', 'action target for ''' || capability || ''' ' || {_finding('target')}, 'parameter ''note'' ' || {_finding('note')},
   CASE WHEN abs(amount) > 1e6 THEN 'parameter ''amount'' exceeds max magnitude' END), '; ' ORDER BY k) FILTER (concat_ws('; ', {_finding('target')}, {_finding('note')}, CASE WHEN abs(amount) > 1e6 THEN 'x' END) <> '') AS action_reasons, count(*) AS n FROM actions GROUP BY 1),
quota AS (SELECT plan_id, agent_id, n, CAST(coalesce(sum(n) OVER (PARTITION BY agent_id ORDER BY as_of_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW), 0) - n AS BIGINT) AS recent FROM context JOIN found USING (plan_id)),
stage1 AS (SELECT c.*, f.n, concat_ws('; ', CASE WHEN as_of_us - issued_us > 300000000 THEN 'session expired' END, CASE WHEN as_of_us < issued_us THEN 'session issued_at is in the future' END,
   CASE WHEN f.n > 3 THEN 'too many actions: ' || f.n || ' > 3' END, f.action_reasons,
   CASE WHEN q.recent + f.n > 4 THEN 'hourly action quota exceeded (' || (q.recent + f.n) || ' > 4: ' || q.recent || ' in the last hour + ' || f.n || ' in this plan)' END,
   'rationale ' || {_finding('rationale')}) AS reasons1 FROM context c JOIN found f USING (plan_id) JOIN quota q USING (plan_id)),
controls AS (SELECT a.plan_id, string_agg(CASE WHEN a.capability NOT IN {_names(CAPABILITIES)} THEN 'capability ''' || a.capability || ''' not in tool whitelist'
   WHEN NOT list_contains(c.playbooks, a.capability) THEN 'capability ''' || a.capability || ''' not authorized for this threat context (allowed: ' || array_to_string(c.playbooks, ', ') || ')' END, '; ' ORDER BY k) AS cap_reasons,
   avg(CASE WHEN a.capability IN ('block_source', 'rate_limit') THEN CASE WHEN a.target = c.source_id THEN 1e0 ELSE 0e0 END WHEN a.capability = 'isolate_segment' THEN CASE WHEN a.target = c.target_asset THEN 1e0 ELSE 0e0 END
     WHEN a.target IS NULL THEN 1e0 ELSE 0e0 END) AS consistency, list(a.capability ORDER BY k) AS names FROM actions a JOIN context c USING (plan_id) GROUP BY 1),
stage2 AS (SELECT s.*, concat_ws('; ', CASE WHEN trim(rationale) = '' THEN 'rationale is empty' END, k.cap_reasons) AS reasons2, consistency, names FROM stage1 s JOIN controls k USING (plan_id))"""


@query("session_freshness", "plan_context", f"WITH {_PLANS} SELECT plan_id, concat_ws('; ', CASE WHEN as_of_us - issued_us > 300000000 THEN 'session expired' END, CASE WHEN as_of_us < issued_us THEN 'session issued_at is in the future' END) AS reasons FROM context")
def _(t: Tables):
    p = plans(t).withColumn("r", trust.session_reasons(F.col("as_of"), F.col("issued_at")))
    return p.select("plan_id", joined("r"))


@query("plan_size_bounds", "plan_context", f"WITH {_PLANS} SELECT plan_id, CASE WHEN n > 3 THEN 'too many actions: ' || n || ' > 3' ELSE '' END AS reasons FROM found")
def _(t: Tables):
    return plans(t).withColumn("r", trust.size_reasons(F.col("actions"), 3)).select("plan_id", joined("r"))


@query("action_checks", "plan_context", f"WITH {_PLANS} SELECT plan_id, coalesce(action_reasons, '') AS reasons FROM found")
def _(t: Tables):
    return trust.normalize_actions(plans(t)).select("plan_id", joined("action_reasons"))


@query("action_quota", "plan_context", f"WITH {_PLANS} SELECT plan_id, recent AS recent_actions, recent + n > 4 AS over FROM quota")
def _(t: Tables):
    return trust.with_quota(plans(t), limit=4).select("plan_id", "recent_actions", (F.size("quota_reasons") > 0).alias("over"))


@query("rationale_check", "plan_context", f"WITH {_PLANS} SELECT plan_id, coalesce('rationale ' || {_finding('rationale')}, '') AS reasons FROM context")
def _(t: Tables):
    return trust.rationale_check(plans(t)).select("plan_id", joined("rationale_reasons"))


@query("plan_preprocessing", "plan_context", f"WITH {_PLANS} SELECT plan_id, reasons1 AS reasons, reasons1 = '' AS stage1_ok FROM stage1")
def _(t: Tables):
    return trust.preprocess_plans(plans(t), FEW).select("plan_id", joined("stage1_reasons"), "stage1_ok")


@query("deterministic_controls", "plan_context", f"WITH {_PLANS} SELECT plan_id, reasons2 AS reasons FROM stage2")
def _(t: Tables):
    reasons = trust.control_reasons(F.col("incident_id"), F.col("rationale"), F.col("actions"), F.col("allowed_playbooks"))
    return plans(t).withColumn("r", reasons).select("plan_id", joined("r"))


@query("context_consistency", "plan_context", f"WITH {_PLANS} SELECT plan_id, round(consistency, 6) AS consistency FROM controls")
def _(t: Tables):
    value = trust.context_consistency(F.col("actions"), F.col("source_id"), F.col("target_asset"))
    return plans(t).select("plan_id", F.round(value, 6).alias("consistency"))


_TRUST = "4e-1 * (1e0 - semantic_risk) + 3e-1 * consistency + 3e-1 * behavioral_trust"
_LEVEL = "CASE WHEN value < 4e-1 THEN 'low' WHEN value < 65e-2 THEN 'medium' WHEN value < 85e-2 THEN 'high' WHEN value IS NOT NULL THEN 'verified' END"
_MODE = "CASE level WHEN 'low' THEN 'read_only' WHEN 'medium' THEN 'recommendation' WHEN 'high' THEN 'restricted_action' WHEN 'verified' THEN 'autonomous_execution' END"


@query("trust_scores", "plan_context", f"""WITH {_PLANS}, valued AS (SELECT plan_id, round({_TRUST}, 9) AS value FROM context JOIN controls USING (plan_id)), levelled AS (SELECT *, {_LEVEL} AS level FROM valued)
SELECT plan_id, round(value, 6) AS trust_value, level AS trust_level, {_MODE} AS autonomy_mode FROM levelled""")
def _(t: Tables):
    consistency = trust.context_consistency(F.col("actions"), F.col("source_id"), F.col("target_asset"))
    value = F.round(trust.trust_value(F.col("semantic_risk"), consistency, F.col("behavioral_trust")), 9)
    scored = plans(t).withColumn("trust_value", value).withColumn("trust_level", trust.trust_level(F.col("trust_value")))
    return scored.select("plan_id", F.round("trust_value", 6).alias("trust_value"), "trust_level", trust.autonomy_mode(F.col("trust_level")).alias("autonomy_mode"))


@query("eligible_actions", "plan_context", f"""WITH {_PLANS}, modes AS (SELECT c.plan_id, playbooks, names, CASE plan_id % 3 WHEN 0 THEN 'restricted_action' WHEN 1 THEN 'autonomous_execution' ELSE 'recommendation' END AS mode FROM context c JOIN controls USING (plan_id)),
eligible AS (SELECT plan_id, CASE WHEN mode = 'recommendation' THEN [] ELSE list_filter(names, lambda c: c IN {_names(CAPABILITIES)} AND list_contains(playbooks, c) AND (mode <> 'restricted_action' OR c IN {_names(LOW_RISK)})) END AS e FROM modes),
done AS (SELECT *, e[1:CAST(len(e) - plan_id % 2 AS INTEGER)] AS ok FROM eligible)
SELECT plan_id, array_to_string(e, ',') AS eligible, CASE WHEN len(e) = 0 THEN 'not_attempted' WHEN len(e) - plan_id % 2 <= 0 THEN 'failed' WHEN plan_id % 2 = 1 THEN 'partially_executed' WHEN plan_id % 5 = 0 THEN 'executed' ELSE 'simulated' END AS status FROM done""")
def _(t: Tables):
    kind = F.col("plan_id") % 3
    mode = F.when(kind == 0, "restricted_action").when(kind == 1, "autonomous_execution").otherwise("recommendation")
    e = plans(t).withColumn("e", trust.eligible_actions(F.col("actions"), mode, F.col("allowed_playbooks")))
    ok = F.slice("e", F.lit(1), F.greatest(F.lit(0), F.size("e") - (F.col("plan_id") % 2).cast("int")))
    executor = F.when(F.col("plan_id") % 5 == 0, "production").otherwise("simulate")
    return e.select("plan_id", F.array_join("e", ",").alias("eligible"), trust.execution_status(F.col("e"), ok, executor).alias("status"))


def _decided(stage: str) -> str:
    """The decision of every row of ``stage``, which has the reasons of both stages."""
    return f"""passed AS (SELECT *, reasons1 = '' AND reasons2 = '' AS pass FROM {stage}),
valued AS (SELECT *, CASE WHEN pass THEN {_TRUST} END AS value FROM passed), levelled AS (SELECT *, {_LEVEL} AS level FROM valued), moded AS (SELECT *, {_MODE} AS mode FROM levelled),
done AS (SELECT *, CASE WHEN pass AND mode IN ('restricted_action', 'autonomous_execution') THEN list_filter(names, lambda c: c IN {_names(CAPABILITIES)} AND list_contains(playbooks, c) AND (mode <> 'restricted_action' OR c IN {_names(LOW_RISK)})) ELSE [] END AS e FROM moded)
SELECT plan_id, coalesce(pass AND mode <> 'read_only', false) AS accepted, CASE WHEN reasons1 <> '' THEN 'preprocessing' WHEN NOT pass THEN 'deterministic_controls' ELSE 'capability_enforcement' END AS terminal_stage,
  level AS trust_level, mode AS autonomy_mode, round(value, 6) AS trust_value, array_to_string(e, ',') AS executed, CASE WHEN len(e) = 0 THEN 'not_attempted' ELSE 'simulated' END AS execution_status,
  CASE WHEN reasons1 <> '' THEN reasons1 ELSE reasons2 END AS reasons FROM done"""


def decision_columns(decided):
    reasons = F.array_join(F.flatten(F.transform("stage_results", lambda s: s["reasons"])), "; ")
    return decided.select(
        "plan_id", "accepted", "terminal_stage", "trust_level", "autonomy_mode", F.round("trust_value", 6).alias("trust_value"),
        F.array_join("executed_actions", ",").alias("executed"), "execution_status", reasons.alias("reasons"),
    )


@query("trust_decision", "plan_context", f"WITH {_PLANS}, {_decided('stage2')}")
def _(t: Tables):
    return decision_columns(trust.evaluate_plans(plans(t), FEW))


@query("trust_decision_history", "plan_context", f"""WITH RECURSIVE {_PLANS}, series AS (SELECT plan_id, agent_id, plan_id % 2 AS nonce, as_of_us AS t, row_number() OVER (PARTITION BY agent_id, plan_id % 2 ORDER BY as_of_us, plan_id) AS rn FROM context),
walk AS (SELECT plan_id, agent_id, nonce, rn, t AS used, false AS replay FROM series WHERE rn = 1
  UNION ALL SELECT s.plan_id, s.agent_id, s.nonce, s.rn, CASE WHEN s.t - w.used <= 7200000000 THEN w.used ELSE s.t END, s.t - w.used <= 7200000000
  FROM walk w JOIN series s ON s.agent_id = w.agent_id AND s.nonce = w.nonce AND s.rn = w.rn + 1),
remembered AS (SELECT s.* REPLACE (concat_ws('; ', CASE WHEN w.replay THEN 'nonce replay detected' END, nullif(s.reasons1, '')) AS reasons1) FROM stage2 s JOIN walk w USING (plan_id)), {_decided('remembered')}""")
def _(t: Tables):
    """The decision with nonces that agents use again."""
    with_nonce = plans(t).withColumn("nonce", F.concat(F.lit("nonce"), (F.col("plan_id") % 2).cast("string")))
    return decision_columns(trust.evaluate_plans(with_nonce, {**FEW, "nonce_window_seconds": 7200}))


_DECISIONS = """decisions AS (SELECT sequence, epoch_us(ts) AS t, coalesce(agent_id, 'unknown') AS agent_id, action_count, least(high_risk_count, action_count) AS high_risk_count, NOT accepted AS policy_violation FROM audit),
windowed AS (SELECT *, count(*) OVER w - 1 AS recent_events, count(*) FILTER (policy_violation) OVER w - CAST(policy_violation AS INT) AS violations FROM decisions WINDOW w AS (PARTITION BY agent_id ORDER BY t RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)),
features AS (SELECT sequence, high_risk_count / action_count AS high_risk_share, action_count, CASE WHEN recent_events > 0 THEN violations / recent_events ELSE 0e0 END AS violation_rate, recent_events FROM windowed)"""


def decisions(t: Tables):
    return t.audit.select(
        "sequence", "ts", F.coalesce("agent_id", F.lit("unknown")).alias("agent_id"), "action_count",
        F.least("high_risk_count", "action_count").alias("high_risk_count"), (~F.col("accepted")).alias("policy_violation"),
    )


@query("behaviour_features", "audit", f"WITH {_DECISIONS} SELECT sequence, round(high_risk_share, 6) AS high_risk_share, action_count, round(violation_rate, 6) AS violation_rate, recent_events FROM features")
def _(t: Tables):
    f = trust.behaviour_features(decisions(t), "sequence")
    return f.select("sequence", F.round("high_risk_share", 6).alias("high_risk_share"), "action_count", F.round("violation_rate", 6).alias("violation_rate"), "recent_events")


@query("behaviour_population", "audit", f"WITH {_DECISIONS} SELECT count(*) AS n, round(avg(high_risk_share), 6) AS high_risk_share, round(avg(action_count), 6) AS action_count, round(avg(violation_rate), 6) AS violation_rate, round(avg(recent_events), 6) AS recent_events FROM features")
def _(t: Tables):
    population = trust.behaviour_population(decisions(t), "sequence")
    return population.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in trust.FEATURES])


@query("feature_attribution", "audit", f"WITH {_DECISIONS}, t AS (SELECT *, abs(high_risk_share) + abs(action_count) + abs(violation_rate) + abs(recent_events) AS total FROM features) SELECT sequence, round(high_risk_share / total, 6) AS high_risk_share_part, round(action_count / total, 6) AS action_count_part, round(violation_rate / total, 6) AS violation_rate_part, round(recent_events / total, 6) AS recent_events_part FROM t")
def _(t: Tables):
    parts = trust.feature_attribution(trust.behaviour_features(decisions(t), "sequence"))
    return parts.select("sequence", *[F.round(f"{c}_part", 6).alias(f"{c}_part") for c in trust.FEATURES])


@query("behaviour_anomaly")
def _(t: Tables):
    features = trust.behaviour_features(decisions(t), "sequence")
    forest = anomaly.fit_forest(features, trust.FEATURES, key="sequence", seed=0)
    return anomaly.behaviour_score(features, trust.FEATURES, forest).select("sequence", "behaviour_score")


@query("protected_targets", "", """WITH targets AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '10.0.' || (user_id % 250) || '.' || (event_id % 250) WHEN 2 THEN '169.254.' || (user_id % 250) || '.0/24' WHEN 3 THEN '160.0.0.0/4'
   WHEN 4 THEN 'asset-' || user_id WHEN 5 THEN '::1' WHEN 6 THEN '300.1.1.1' ELSE '169.253.0.0/16' END AS target FROM events),
parsed AS (SELECT *, regexp_matches(target, '^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\\.|$|/)){4}') AND regexp_matches(target, '^[0-9./]+$') AS v4 FROM targets),
nums AS (SELECT *, CASE WHEN v4 THEN CAST(split_part(target, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(target, '.', 2) AS BIGINT) * 65536 + CAST(split_part(target, '.', 3) AS BIGINT) * 256 + CAST(split_part(split_part(target, '.', 4), '/', 1) AS BIGINT) END AS ip,
   CASE WHEN v4 THEN CAST(2 ** (32 - coalesce(try_cast(split_part(target, '/', 2) AS INT), 32)) AS BIGINT) END AS size FROM parsed),
ranges AS (SELECT *, (ip // size) * size AS lo, (ip // size) * size + size - 1 AS hi FROM nums)
SELECT event_id, v4 OR target = '::1' AS valid_network, coalesce((lo <= 2130706433 AND hi >= 2130706433) OR (lo <= 2852061183 AND hi >= 2851995648), target = '::1') AS is_protected FROM ranges""")
def _(t: Tables):
    c, user = F.col("event_id") % 8, F.col("user_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    target = (
        F.when(c == 0, "127.0.0.1").when(c == 1, text("10.0.", user % 250, ".", F.col("event_id") % 250))
        .when(c == 2, text("169.254.", user % 250, ".0/24")).when(c == 3, "160.0.0.0/4").when(c == 4, text("asset-", user))
        .when(c == 5, "::1").when(c == 6, "300.1.1.1").otherwise("169.253.0.0/16")
    )
    checked = trust.protected_target(t.events.withColumn("target", target), "target")
    return checked.select("event_id", "valid_network", "is_protected")


@query("incident_run")
def _(t: Tables):
    """Alert to decision with a fresh nonce per incident."""
    from netwarden.plans.flagship import run_incidents

    return run_incidents(t.alerts).select("incident_id", "accepted", "terminal_stage", "trust_level", "execution_status")
