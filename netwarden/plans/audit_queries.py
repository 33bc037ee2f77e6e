"""Audit log analytics, hash chains, drift, forecasts, nonce replay and trust smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from netwarden.constants import EMA_ALPHA, HASH_GENESIS, THRESHOLD_GRID, WEIGHT_GRID
from netwarden.functions.ordered import micros, order_blocks, with_ema
from netwarden.operators import analytics, audit, trust
from netwarden.plans.registry import Tables, query


def rounded(df, *names, digits=6):
    for name in names:
        df = df.withColumn(name, F.round(name, digits))
    return df


@query("acceptance_rate", "audit", "SELECT count(*) AS entries, round(avg(CASE WHEN accepted THEN 1e0 ELSE 0e0 END), 6) AS acceptance_rate FROM audit")
def _(t: Tables):
    return rounded(analytics.acceptance_rate(t.audit), "acceptance_rate")


_LEVELS = """levels AS (SELECT unnest(['low','medium','high','verified','hard_rejected']) AS level),
level_counts AS (SELECT level, count(a.l) AS n FROM levels LEFT JOIN (SELECT CASE WHEN trust_value IS NULL THEN 'hard_rejected' ELSE trust_level END AS l FROM audit) a ON a.l = level GROUP BY 1)"""
_SUMMARY = """summary AS (SELECT agent_id, count(*) AS interactions, count(trust_value) AS scored, avg(CASE WHEN accepted THEN 1e0 ELSE 0e0 END) AS acceptance_rate,
  avg(trust_value) AS mean_trust, min(sequence) AS first_seen FROM audit WHERE agent_id IS NOT NULL GROUP BY 1)"""
_SIDES = """eligible AS (SELECT *, row_number() OVER (ORDER BY round(mean_trust, 12) DESC, first_seen) AS t, row_number() OVER (ORDER BY round(mean_trust, 12), first_seen DESC) AS b FROM summary WHERE scored >= 2),
sides AS (SELECT 'top' AS side, agent_id, mean_trust, CAST(t AS INTEGER) AS place FROM eligible WHERE t <= 3 UNION ALL SELECT 'bottom', agent_id, mean_trust, CAST(b AS INTEGER) FROM eligible WHERE b <= 3)"""
_REPUTATION = """reputation AS (SELECT agent_id, count(*) AS interactions, count(*) FILTER (NOT accepted) AS violations,
  coalesce((SELECT avg(v.trust_value) FROM (SELECT trust_value FROM audit x WHERE x.agent_id = a.agent_id AND trust_value IS NOT NULL ORDER BY sequence DESC LIMIT 5) v), 0e0)
  - CAST(0.15 AS DOUBLE) * count(*) FILTER (NOT accepted) AS reputation FROM audit a WHERE agent_id IS NOT NULL GROUP BY agent_id)"""


@query("trust_level_distribution", "audit", f"WITH {_LEVELS} SELECT level, n FROM level_counts")
def _(t: Tables):
    return analytics.trust_level_distribution(t.audit)


@query("agent_summary", "audit", f"WITH {_SUMMARY} SELECT agent_id, interactions, scored, round(acceptance_rate, 6) AS acceptance_rate, round(mean_trust, 6) AS mean_trust, first_seen FROM summary")
def _(t: Tables):
    return rounded(analytics.agent_summary(t.audit), "acceptance_rate", "mean_trust")


@query("top_bottom_agents", "audit", f"WITH {_SUMMARY}, {_SIDES} SELECT side, agent_id, place, round(mean_trust, 6) AS mean_trust FROM sides")
def _(t: Tables):
    best = analytics.top_bottom_agents(analytics.agent_summary(t.audit))
    return rounded(best, "mean_trust").select("side", "agent_id", "place", "mean_trust")


@query("kpi_report", "audit", f"""WITH {_LEVELS}, {_SUMMARY}, {_SIDES}
SELECT section, item, round(value, 6) AS value FROM (
  SELECT 'overall' AS section, 'acceptance_rate' AS item, avg(CASE WHEN accepted THEN 1e0 ELSE 0e0 END) AS value FROM audit
  UNION ALL SELECT 'level', level, CAST(n AS DOUBLE) FROM level_counts
  UNION ALL SELECT 'agent_acceptance', agent_id, acceptance_rate FROM summary
  UNION ALL SELECT side, agent_id, mean_trust FROM sides)""")
def _(t: Tables):
    return rounded(analytics.kpi_report(t.audit), "value")


@query("agent_reputation", "audit", f"WITH {_REPUTATION} SELECT agent_id, interactions, violations, round(reputation, 6) AS reputation FROM reputation")
def _(t: Tables):
    return rounded(analytics.reputation(t.audit), "reputation")


def _page_hinkley(source: str, keys: str, limit: str = "1e0") -> str:
    """Recursive Page-Hinkley over ``source(keys, rn, spot, x)``."""
    match = " AND ".join(f"s.{k} = p.{k}" for k in keys.split(", "))
    picked = ", ".join(f"s.{k}" for k in keys.split(", "))
    return f"""ph AS (
  SELECT {keys}, rn, spot, CAST(1 AS BIGINT) AS n, x AS mean, x - x - CAST(0.005 AS DOUBLE) AS total, least(0e0, x - x - CAST(0.005 AS DOUBLE)) AS low, false AS alarm FROM {source} WHERE rn = 1
  UNION ALL
  SELECT {picked}, s.rn, s.spot, u.n, u.mean, u.total, least(u.low, u.total), u.total - least(u.low, u.total) > {limit}
  FROM ph p JOIN {source} s ON {match} AND s.rn = p.rn + 1,
  LATERAL (SELECT CASE WHEN p.alarm THEN 0 ELSE p.n END AS n0, CASE WHEN p.alarm THEN 0e0 ELSE p.mean END AS mean0, CASE WHEN p.alarm THEN 0e0 ELSE p.total END AS total0, CASE WHEN p.alarm THEN 0e0 ELSE p.low END AS low0) z,
  LATERAL (SELECT z.n0 + 1 AS n, z.mean0 + (s.x - z.mean0) / (z.n0 + 1) AS mean, z.total0 + (s.x - (z.mean0 + (s.x - z.mean0) / (z.n0 + 1)) - CAST(0.005 AS DOUBLE)) AS total, z.low0 AS low) u)"""


@query("score_drift", "audit", f"""WITH RECURSIVE series AS (SELECT agent_id, field, rn, spot, x FROM (
   SELECT coalesce(agent_id, 'unknown') AS agent_id, sequence AS spot, row_number() OVER (PARTITION BY coalesce(agent_id, 'unknown') ORDER BY sequence) AS rn, semantic_risk, context_consistency, behavioral_trust, trust_value FROM audit WHERE trust_value IS NOT NULL) w
   UNPIVOT (x FOR field IN (semantic_risk, context_consistency, behavioral_trust, trust_value))), {_page_hinkley('series', 'agent_id, field')}
SELECT agent_id, field, rn - 1 AS index, spot AS sequence FROM ph WHERE alarm""")
def _(t: Tables):
    return analytics.audit_drift(t.audit)


def trust_log(t: Tables):
    """Nested per-round log; a round holds one entry per client taking part in it."""
    rows = t.trust_rounds
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("client_id"))))
    ok = ~F.col("failed_validation")
    return rows.groupBy("round").agg(
        listed(ok & (F.col("score") >= 0.35)).alias("accepted"),
        listed(F.col("failed_validation")).alias("rejected_validation"),
        listed(ok & (F.col("score") < 0.35)).alias("rejected_detector"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(ok, F.struct("client_id", "score"))))).alias("trust_scores"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(ok, F.struct("client_id", "ood"))))).alias("ood_scores"),
        F.struct(F.max("silhouette").alias("silhouette"), F.count_if(ok).alias("n_clients")).alias("detection"),
    )


@query("round_trust_drift", "trust_rounds", f"""WITH RECURSIVE series AS (SELECT client_id, round AS spot, score AS x, row_number() OVER (PARTITION BY client_id ORDER BY round) AS rn FROM trust_rounds WHERE NOT failed_validation), {_page_hinkley('series', 'client_id')}
SELECT count(*) AS clients, sum(alarms) AS alarms FROM (SELECT client_id, CAST(count(*) FILTER (alarm) AS BIGINT) AS alarms FROM ph GROUP BY 1)""".replace("sum(alarms)", "CAST(sum(alarms) AS BIGINT)"))
def _(t: Tables):
    log = trust_log(t)
    alarms = analytics.round_drift(log).groupBy("client_id").agg(F.count(F.lit(1)).alias("alarms"))
    clients = log.select(F.explode(F.map_keys("trust_scores")).alias("client_id")).distinct()
    return clients.join(alarms, "client_id", "left").agg(
        F.count(F.lit(1)).alias("clients"), F.coalesce(F.sum("alarms"), F.lit(0)).alias("alarms")
    )


@query("round_trust_alarms", "trust_rounds", f"""WITH RECURSIVE series AS (SELECT client_id, round AS spot, score AS x, row_number() OVER (PARTITION BY client_id ORDER BY round) AS rn FROM trust_rounds WHERE NOT failed_validation), {_page_hinkley('series', 'client_id', 'CAST(0.15 AS DOUBLE)')}
SELECT client_id, rn - 1 AS index, spot AS round FROM ph WHERE alarm""")
def _(t: Tables):
    """The alarms themselves, of a detector that raises some."""
    return analytics.round_drift(trust_log(t), limit=0.15)


def _forecast_sql(field: str) -> str:
    return f"""WITH series AS (SELECT coalesce(agent_id, 'unknown') AS agent_id, {field} AS y, CAST(row_number() OVER (PARTITION BY coalesce(agent_id, 'unknown') ORDER BY ts, sequence) - 1 AS DOUBLE) AS x FROM audit WHERE trust_value IS NOT NULL),
fit AS (SELECT agent_id, count(*) AS n, coalesce(regr_slope(y, x), 0e0) AS slope, coalesce(regr_intercept(y, x), max(y)) AS start FROM series GROUP BY 1),
spread AS (SELECT agent_id, sqrt(avg((y - slope * x - start) * (y - slope * x - start))) AS sd FROM series JOIN fit USING (agent_id) GROUP BY 1),
steps AS (SELECT f.*, sd, CAST(unnest([1, 2, 3]) AS INTEGER) AS step FROM fit f JOIN spread USING (agent_id))
SELECT agent_id, n, round(slope, 9) AS slope, step, round(greatest(0e0, least(1e0, slope * (n + step - 1) + start)), 6) AS point,
  round(greatest(0e0, least(1e0, slope * (n + step - 1) + start - sd)), 6) AS lower, round(greatest(0e0, least(1e0, slope * (n + step - 1) + start + sd)), 6) AS upper,
  CASE WHEN slope > 1e-6 THEN 'rising' WHEN slope < -1e-6 THEN 'falling' ELSE 'flat' END AS trend FROM steps"""


@query("trust_forecast", "audit", _forecast_sql("trust_value"))
def _(t: Tables):
    return rounded(analytics.trust_forecast(t.audit).withColumn("slope", F.round("slope", 9)), "point", "lower", "upper")


@query("risk_trajectory", "audit", _forecast_sql("semantic_risk"))
def _(t: Tables):
    out = analytics.trust_forecast(t.audit, "semantic_risk").withColumn("slope", F.round("slope", 9))
    return rounded(out, "point", "lower", "upper")


@query("label_summary", "audit analyst_labels", """
SELECT count(*) AS labels, count(DISTINCT a.sequence) AS labelled_decisions, count(*) FILTER (a.sequence IS NULL) AS unmatched, count(DISTINCT a.sequence) >= 20 AS ready
FROM analyst_labels l LEFT JOIN audit a ON a.sequence = l.audit_sequence""")
def _(t: Tables):
    return analytics.label_summary(t.analyst_labels, t.audit)


@query("label_counts", "analyst_labels", "SELECT label, count(*) AS n FROM analyst_labels GROUP BY 1")
def _(t: Tables):
    return analytics.label_counts(t.analyst_labels)


@query("agreement_by_level", "audit analyst_labels", """
SELECT trust_level, count(*) AS n_labels, count(*) FILTER (label = 'correct') AS n_correct, round(count(*) FILTER (label = 'correct') / count(*), 6) AS agreement
FROM analyst_labels l JOIN audit a ON a.sequence = l.audit_sequence WHERE trust_level IS NOT NULL GROUP BY 1""")
def _(t: Tables):
    return rounded(analytics.agreement_by_level(t.analyst_labels, t.audit), "agreement")


@query("unmatched_labels", "audit analyst_labels", "SELECT label_id, audit_sequence FROM analyst_labels WHERE audit_sequence NOT IN (SELECT sequence FROM audit)")
def _(t: Tables):
    return analytics.unmatched_labels(t.analyst_labels, t.audit).select("label_id", "audit_sequence")


@query("production_reviews", "audit analyst_labels", """
SELECT audit_sequence, label_id, label, analyst_id, incident_id FROM analyst_labels l JOIN audit a ON a.sequence = l.audit_sequence WHERE executor_mode = 'production'""")
def _(t: Tables):
    return analytics.production_reviews(t.analyst_labels, t.audit)


_GRID = "grid AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i},{j},{ws}e0,{wc}e0,{wb}e0,{low}e0)" for i, (ws, wc, wb) in enumerate(WEIGHT_GRID) for j, (low, _, _) in enumerate(THRESHOLD_GRID)
) + ") g(weights_no, thresholds_no, ws, wc, wb, low))"
_GRID_SCORES = """counts AS (SELECT weights_no, thresholds_no, ws, wc, wb, low, count(*) FILTER (said AND want) AS tp, count(*) FILTER (said AND NOT want) AS fp, count(*) FILTER (NOT said AND want) AS fn
  FROM (SELECT g.*, f.expected_accepted AS want, ws * (1e0 - semantic_risk) + wc * consistency + wb * behavioral_trust >= low AS said FROM grid g, feedback_rows f) GROUP BY ALL),
ratios AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0e0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0e0) AS recall FROM counts),
scored AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0e0 END AS f1 FROM ratios)"""


@query("weight_grid", "feedback", f"WITH feedback_rows AS (SELECT * FROM feedback), {_GRID}, {_GRID_SCORES} SELECT weights_no, thresholds_no, ws, wc, wb, low, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scored")
def _(t: Tables):
    return rounded(analytics.weight_grid(t.feedback), "precision", "recall", "f1")


@query("validation_report", "audit", f"""WITH {_SUMMARY}, {_REPUTATION}, decisions AS (SELECT *, sequence % 3 <> 0 AS expected_accepted FROM audit),
labelled AS (SELECT *, CASE WHEN accepted = expected_accepted THEN 'correct' WHEN accepted THEN 'false_positive' ELSE 'false_negative' END AS label FROM decisions),
feedback_rows AS (SELECT *, context_consistency AS consistency FROM decisions WHERE trust_value IS NOT NULL), {_GRID}, {_GRID_SCORES}
SELECT section, item, round(value, 6) AS value FROM (
  SELECT 'labels' AS section, label AS item, CAST(count(*) AS DOUBLE) AS value FROM labelled GROUP BY 2
  UNION ALL SELECT 'mean_trust', agent_id, mean_trust FROM summary
  UNION ALL SELECT 'reputation', agent_id, reputation FROM reputation
  UNION ALL SELECT 'ready', 'ready', 1e0
  UNION ALL SELECT 'agreement', trust_level, count(*) FILTER (label = 'correct') / count(*) FROM labelled WHERE trust_level IS NOT NULL GROUP BY 2
  UNION ALL (SELECT 'grid_f1', weights_no || '_' || thresholds_no, f1 FROM scored ORDER BY f1 DESC, weights_no, thresholds_no LIMIT 5))""")
def _(t: Tables):
    decisions = t.audit.withColumn("expected_accepted", F.col("sequence") % 3 != 0)
    return rounded(analytics.validation_report(decisions), "value")


def entry_text():
    c = F.col
    return audit.canonical(
        c("sequence"), micros("ts"), c("incident_id"), c("agent_id"), c("accepted"), c("trust_level"), c("terminal_stage")
    )


def _text_sql(*columns: str) -> str:
    return " || '|' || ".join(
        f"CASE WHEN ({c}) IS NULL THEN '-' ELSE length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in columns
    )


_ENTRY = _text_sql("sequence", "epoch_us(ts)", "incident_id", "agent_id", "accepted", "trust_level", "terminal_stage")


def _chain_sql(source: str, chain: str, order: str, text: str) -> str:
    return f"""entries AS (SELECT {chain} AS chain, {order} AS ord, {text} AS body, row_number() OVER (PARTITION BY {chain} ORDER BY {order}) AS position FROM {source}),
chained AS (SELECT chain, ord, position, body, '{HASH_GENESIS}' AS previous_hash, sha256('{HASH_GENESIS}' || body) AS entry_hash FROM entries WHERE position = 1
  UNION ALL SELECT e.chain, e.ord, e.position, e.body, c.entry_hash, sha256(c.entry_hash || e.body) FROM chained c JOIN entries e ON e.chain = c.chain AND e.position = c.position + 1)"""


def chained(t: Tables):
    rows = t.audit.withColumn("canonical", entry_text())
    return audit.build_chain(rows, "log_id", ["sequence"])


@query("chain_append", "audit", f"WITH RECURSIVE {_chain_sql('audit', 'log_id', 'sequence', _ENTRY)} SELECT chain AS log_id, ord AS sequence, position, previous_hash, entry_hash FROM chained")
def _(t: Tables):
    return chained(t).select("log_id", "sequence", "position", "previous_hash", "entry_hash")


@query("chain_verify", "audit", f"""WITH RECURSIVE {_chain_sql('audit', 'log_id', 'sequence', _ENTRY)},
stored AS (SELECT chain, position, CASE WHEN position % 211 = 97 AND chain <> 'log3' THEN body || 'x' ELSE body END AS body, previous_hash, entry_hash FROM chained),
checked AS (SELECT *, coalesce(lag(entry_hash) OVER (PARTITION BY chain ORDER BY position), '{HASH_GENESIS}') AS before FROM stored)
SELECT chain AS log_id, count(*) AS entries, count(*) FILTER (NOT (sha256(before || body) = entry_hash AND previous_hash = before)) = 0 AS ok,
  min(position) FILTER (NOT (sha256(before || body) = entry_hash AND previous_hash = before)) AS first_broken FROM checked GROUP BY 1""")
def _(t: Tables):
    stored = chained(t)
    touched = (F.col("position") % 211 == 97) & (F.col("log_id") != "log3")
    text = F.when(touched, F.concat("canonical", F.lit("x"))).otherwise(F.col("canonical"))
    return audit.verify_chain(stored.withColumn("canonical", text), "log_id")


_LABEL = _text_sql("label_id", "audit_sequence", "label", "analyst_id", "rationale", "epoch_us(ts)")


@query("label_chain", "analyst_labels", f"""WITH RECURSIVE {_chain_sql('analyst_labels', 'analyst_id', 'position', _LABEL)}
SELECT chain AS analyst_id, ord AS label_position, entry_hash FROM chained""")
def _(t: Tables):
    c = F.col
    rows = t.analyst_labels.withColumn(
        "canonical",
        audit.canonical(c("label_id"), c("audit_sequence"), c("label"), c("analyst_id"), c("rationale"), micros("ts")),
    ).withColumnRenamed("position", "label_position")
    return audit.build_chain(rows, "analyst_id", ["label_position"]).select("analyst_id", "label_position", "entry_hash")


@query("labels_for_decision", "analyst_labels", "SELECT label_id, label FROM analyst_labels WHERE audit_sequence = 100")
def _(t: Tables):
    return audit.labels_for(t.analyst_labels, 100).select("label_id", "label")


@query("recent_events", "history", "SELECT event_id, entity_id FROM history WHERE kind = 'incident' AND entity_id = 'agent3' AND ts >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 1 DAY")
def _(t: Tables):
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return audit.recent_events(t.history, as_of, 86400, "incident", "agent3").select("event_id", "entity_id")


@query("events_of_kind", "history", "SELECT event_id FROM history WHERE kind = 'trust_decision'")
def _(t: Tables):
    return audit.events_of_kind(t.history, "trust_decision").select("event_id")


@query("event_counts_in_window", "history", """
SELECT event_id, count(*) OVER (PARTITION BY entity_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) - 1 AS recent FROM history""")
def _(t: Tables):
    return audit.count_recent(t.history, 86400, "event_id").select("event_id", "recent")


@query("implausible_jumps", "audit", """
SELECT agent_id, sequence, round(trust_value, 6) AS trust_value, round(previous_value, 6) AS previous_value FROM (
  SELECT agent_id, sequence, trust_value, lag(trust_value) OVER (PARTITION BY agent_id ORDER BY sequence) AS previous_value FROM audit WHERE trust_value IS NOT NULL AND agent_id IS NOT NULL)
WHERE abs(trust_value - previous_value) > CAST(0.6 AS DOUBLE)""")
def _(t: Tables):
    jumps = audit.implausible_jumps(t.audit, "agent_id", "sequence", limit=0.6)
    return rounded(jumps.select("agent_id", "sequence", "trust_value", "previous_value"), "trust_value", "previous_value")


def _ema_sql(source: str) -> str:
    return f"""ema AS (SELECT key, rn, spot, CAST(0.3 AS DOUBLE) * x + CAST(0.7 AS DOUBLE) AS e FROM {source} WHERE rn = 1
  UNION ALL SELECT s.key, s.rn, s.spot, CAST(0.3 AS DOUBLE) * s.x + CAST(0.7 AS DOUBLE) * p.e FROM ema p JOIN {source} s ON s.key = p.key AND s.rn = p.rn + 1)"""


@query("client_trust_ema", "trust_rounds", f"""WITH RECURSIVE series AS (SELECT client_id AS key, round AS spot, CASE WHEN score >= CAST(0.35 AS DOUBLE) THEN 1e0 ELSE 0e0 END AS x, row_number() OVER (PARTITION BY client_id ORDER BY round) AS rn FROM trust_rounds WHERE NOT failed_validation), {_ema_sql('series')}
SELECT key AS client_id, spot AS round, round(e, 6) AS trust, e >= CAST(0.35 AS DOUBLE) AS kept FROM ema""")
def _(t: Tables):
    rows = t.trust_rounds.filter("NOT failed_validation").withColumn(
        "round_score", F.when(F.col("score") >= 0.35, 1.0).otherwise(0.0)
    )
    smoothed = trust.client_trust(rows, "client_id", "round", "round_score")
    return rounded(smoothed.select("client_id", "round", "trust", "kept"), "trust")


@query("behaviour_ema", "audit", f"""WITH RECURSIVE series AS (SELECT agent_id AS key, sequence AS spot, behavioral_trust AS x, row_number() OVER (PARTITION BY agent_id ORDER BY sequence) AS rn FROM audit WHERE behavioral_trust IS NOT NULL AND agent_id IS NOT NULL), {_ema_sql('series')}
SELECT key AS agent_id, spot AS sequence, round(e, 6) AS behaviour FROM ema""")
def _(t: Tables):
    rows = t.audit.filter("behavioral_trust IS NOT NULL AND agent_id IS NOT NULL").select("agent_id", "sequence", "behavioral_trust")
    out = with_ema(rows, ["agent_id"], ["sequence"], order_blocks(rows, "sequence"), "behavioral_trust", EMA_ALPHA, 1.0, "behaviour")
    return rounded(out.select("agent_id", "sequence", "behaviour"), "behaviour")


@query("nonce_replay", "sessions_used", """WITH RECURSIVE series AS (SELECT agent_id, nonce, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY agent_id, nonce ORDER BY ts, event_id) AS rn FROM sessions_used),
walk AS (SELECT agent_id, nonce, event_id, rn, t AS used, false AS replay FROM series WHERE rn = 1
  UNION ALL SELECT s.agent_id, s.nonce, s.event_id, s.rn, CASE WHEN s.t - w.used <= 86400000000 THEN w.used ELSE s.t END, s.t - w.used <= 86400000000
  FROM walk w JOIN series s ON s.agent_id = w.agent_id AND s.nonce = w.nonce AND s.rn = w.rn + 1)
SELECT event_id, replay FROM walk""")
def _(t: Tables):
    return trust.nonce_replay(t.sessions_used, window_seconds=86400).select("event_id", "replay")
