"""Client-update validation, aggregation, detection and their evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from netwarden.operators import updates as up
from netwarden.plans.audit_queries import trust_log
from netwarden.plans.registry import Tables, query


def updates(t: Tables):
    v = t.embeddings.select(
        F.floor(F.col("vec_id") / 50).alias("round"), F.concat(F.lit("c"), (F.col("vec_id") % 50).cast("string")).alias("client_id"),
        (1 + F.col("vec_id") % 7).alias("n_examples"), F.posexplode("embedding").alias("at", "value"),
    )
    return v.select(
        "round", "client_id", F.when(F.col("at") < 32, "layer1").otherwise("layer2").alias("param"),
        (F.col("at") % 32).cast("long").alias("idx"), F.col("value").cast("double").alias("value"), "n_examples",
    )


def reference(t: Tables):
    return updates(t).groupBy("param", "idx").agg(((F.max("idx") * 37 % 100) / 1e3).alias("value"))


_U = """updates AS (SELECT round, client_id, n_examples, CASE WHEN spot < 32 THEN 'layer1' ELSE 'layer2' END AS param, spot % 32 AS idx, CAST(x AS DOUBLE) AS value FROM (
  SELECT vec_id // 50 AS round, 'c' || vec_id % 50 AS client_id, 1 + vec_id % 7 AS n_examples, unnest(range(64)) AS spot, unnest(embedding) AS x FROM embeddings)),
reference AS (SELECT param, idx, (idx * 37 % 100) / 1e3 AS value FROM updates GROUP BY 1, 2),
deltas AS (SELECT u.*, u.value - r.value AS delta FROM updates u JOIN reference r USING (param, idx))"""
_POISONED = "round % 2 = 0 AND client_id IN ('c1', 'c2', 'c3')"


def flagged():
    return (F.col("round") % 2 == 0) & F.col("client_id").isin("c1", "c2", "c3")


def coordinates(df, **rounding):
    return df.select("round", "param", "idx", F.round("value", 6).alias("value"))


@query("update_delta", "", f"WITH {_U} SELECT round, client_id, param, idx, round(delta, 9) AS delta FROM deltas")
def _(t: Tables):
    return up.deltas(updates(t), reference(t)).select("round", "client_id", "param", "idx", F.round("delta", 9).alias("delta"))


@query("update_norm", "", f"WITH {_U} SELECT round, client_id, round(sqrt(sum(delta * delta)), 6) AS norm, count(*) AS n_values FROM deltas GROUP BY 1, 2")
def _(t: Tables):
    return up.update_norms(updates(t), reference(t)).withColumn("norm", F.round("norm", 6))


_BROKEN = """broken AS (SELECT round, client_id, param, idx, CASE WHEN client_id = 'c4' AND idx = 3 THEN CAST('nan' AS DOUBLE) WHEN client_id = 'c5' AND idx = 4 THEN 1e4 ELSE value END AS value FROM updates
  WHERE NOT (client_id = 'c6' AND param = 'layer2') AND NOT (client_id = 'c7' AND idx = 9 AND param = 'layer1'))"""


@query("update_validation", "", f"""WITH {_U}, {_BROKEN},
per_param AS (SELECT b.round, client_id, param, count(*) AS n, count(r.value) AS matched, bool_or(isnan(b.value) OR isinf(b.value)) AS bad, max(CASE WHEN NOT isnan(b.value) THEN abs(b.value) END) AS peak, sum((b.value - r.value) ** 2) AS usq FROM broken b LEFT JOIN reference r USING (param, idx) GROUP BY 1, 2, 3),
sizes AS (SELECT param, count(*) AS ref_n, sum(value * value) AS rsq FROM reference GROUP BY 1),
joined AS (SELECT *, n = ref_n AND matched = ref_n AS same FROM per_param JOIN sizes USING (param)),
client AS (SELECT round, client_id, count(*) <> 2 AS mismatch, string_agg(CASE WHEN NOT same THEN 'shape mismatch for ' || param ELSE nullif(concat_ws('; ', CASE WHEN bad THEN 'non-finite values in ' || param END, CASE WHEN peak > 1e2 THEN 'absolute parameter bound exceeded in ' || param END), '') END, '; ' ORDER BY param) AS said,
  sqrt(sum(usq) FILTER (same)) / sqrt(sum(rsq) FILTER (same)) AS ratio FROM joined GROUP BY 1, 2)
SELECT round, client_id, CASE WHEN mismatch THEN 'state keys mismatch' ELSE concat_ws('; ', said, CASE WHEN NOT isnan(ratio) AND ratio > 4e0 THEN 'update norm ratio exceeds 4.0' END) END AS reasons FROM client""")
def _(t: Tables):
    c, value = F.col("client_id"), F.col("value")
    broken = updates(t).withColumn(
        "value", F.when((c == "c4") & (F.col("idx") == 3), float("nan")).when((c == "c5") & (F.col("idx") == 4), 1e4).otherwise(value)
    ).filter(~((c == "c6") & (F.col("param") == "layer2")) & ~((c == "c7") & (F.col("idx") == 9) & (F.col("param") == "layer1")))
    checked = up.validate_updates(broken, reference(t), 100.0, 4.0)
    return checked.select("round", "client_id", F.array_join("reasons", "; ").alias("reasons"))


@query("weighted_average", "", f"WITH {_U} SELECT round, param, idx, round(sum(n_examples * value) / sum(n_examples), 6) AS value FROM updates GROUP BY 1, 2, 3")
def _(t: Tables):
    return coordinates(up.aggregate_updates(updates(t), "weighted_average"))


@query("coordinate_median", "", f"WITH {_U} SELECT round, param, idx, round(median(value), 6) AS value FROM updates GROUP BY 1, 2, 3")
def _(t: Tables):
    return coordinates(up.aggregate_updates(updates(t), "coordinate_median"))


@query("trimmed_mean", "", f"""WITH {_U}, placed AS (SELECT *, row_number() OVER (PARTITION BY round, param, idx ORDER BY value, client_id) AS rn, count(*) OVER (PARTITION BY round, param, idx) AS n FROM updates)
SELECT round, param, idx, round(avg(value), 6) AS value FROM placed WHERE rn > floor(n * CAST(0.2 AS DOUBLE)) AND rn <= n - floor(n * CAST(0.2 AS DOUBLE)) GROUP BY 1, 2, 3""")
def _(t: Tables):
    return coordinates(up.aggregate_updates(updates(t), "trimmed_mean", 0.2))


def _stress_sql(factor: str) -> str:
    return f"WITH {_U} SELECT u.round, client_id, param, idx, round(CASE WHEN {_POISONED.replace('round', 'u.round')} THEN r.value + ({factor}) * (u.value - r.value) ELSE u.value END, 6) AS value FROM updates u JOIN reference r USING (param, idx)"


@query("stress_sign_flip", "", _stress_sql("-2e0"))
def _(t: Tables):
    out = up.sign_flip(updates(t), reference(t), flagged(), 2.0)
    return out.select("round", "client_id", "param", "idx", F.round("value", 6).alias("value"))


@query("stress_gradual_scaling", "", _stress_sql("1e0 + 5e-1 * u.round"))
def _(t: Tables):
    out = up.gradual_scaling(updates(t), reference(t), flagged(), 0.5)
    return out.select("round", "client_id", "param", "idx", F.round("value", 6).alias("value"))


@query("stress_gaussian_noise")
def _(t: Tables):
    return up.gaussian_noise(updates(t), reference(t), flagged(), 0.5, seed=3).select("round", "client_id", "param", "idx", "value")


@query("stress_gaussian_extent", "", f"""WITH {_U}, marked AS (SELECT round, client_id, {_POISONED} AS flagged, count(*) AS n FROM updates GROUP BY 1, 2, 3) SELECT *, CASE WHEN flagged THEN n ELSE 0 END AS n_changed, true AS plausible FROM marked""")
def _(t: Tables):
    """Where the noise goes and how strong it is: of every client's noise, the norm is about the asked share of its update's norm."""
    own = updates(t).select("round", "client_id", "param", "idx", F.col("value").alias("before"))
    noisy = up.gaussian_noise(updates(t), reference(t), flagged(), 0.5, seed=3).join(own, ["round", "client_id", "param", "idx"])
    change = F.col("value") - F.col("before")
    strength = noisy.groupBy("round", "client_id").agg(
        F.max(flagged()).alias("flagged"), F.count(F.lit(1)).alias("n"), F.count_if(change != 0).alias("n_changed"), F.sqrt(F.sum(change * change)).alias("norm")
    )
    ratio = F.col("norm") / F.col("own")
    plausible = F.when(F.col("flagged"), (ratio > 0.25) & (ratio < 0.8)).otherwise(F.col("norm") == 0)
    norms = up.update_norms(updates(t), reference(t)).select("round", "client_id", F.col("norm").alias("own"))
    return strength.join(norms, ["round", "client_id"]).select("round", "client_id", "flagged", "n", "n_changed", plausible.alias("plausible"))


@query("stress_label_noise", "traffic", """WITH risky AS (SELECT row_id, label, row_number() OVER (ORDER BY md5('0|' || row_id), row_id) AS rn, count(*) OVER () AS n FROM traffic WHERE label <> 'click')
SELECT row_id, CASE WHEN rn <= round_even(n * CAST(0.3 AS DOUBLE), 0) THEN 'click' ELSE label END AS label FROM risky UNION ALL SELECT row_id, label FROM traffic WHERE label = 'click'""")
def _(t: Tables):
    return up.label_noise(t.traffic.select("row_id", "label"), "label", "row_id", "click", 0.3)


@query("update_projection")
def _(t: Tables):
    return up.project_updates(up.deltas(updates(t), reference(t))).select("round", "client_id", "point", "explained")


@query("projection_distances", "", f"""WITH {_U}, scaled AS (SELECT round, client_id, param, idx, delta - avg(delta) OVER w AS c, stddev_pop(delta) OVER w AS sd FROM deltas WINDOW w AS (PARTITION BY round, param, idx)),
z AS (SELECT round, client_id, param, idx, CASE WHEN sd = 0 THEN 0e0 ELSE c / sd END AS z FROM scaled)
SELECT a.round, a.client_id, round(sqrt(sum((a.z - b.z) * (a.z - b.z))), 5) AS distance FROM z a JOIN z b ON b.round = a.round AND b.client_id = 'c0' AND b.param = a.param AND b.idx = a.idx WHERE a.client_id <> 'c0' GROUP BY 1, 2""")
def _(t: Tables):
    """Distances to one client survive a projection on all components."""
    p = up.project_updates(up.deltas(updates(t), reference(t)), components=1000).select("round", "client_id", "point")
    base = p.filter("client_id = 'c0'").select("round", F.col("point").alias("base"))
    gap = F.aggregate(F.zip_with("point", "base", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, b: a + b)
    return p.filter("client_id <> 'c0'").join(base, "round").select("round", "client_id", F.round(F.sqrt(gap), 5).alias("distance"))


@query("update_clusters")
def _(t: Tables):
    return up.cluster_clients(up.project_updates(up.deltas(updates(t), reference(t))))


@query("update_density_clusters")
def _(t: Tables):
    return up.cluster_clients(up.project_updates(up.deltas(updates(t), reference(t))), "dbscan")


def points(t: Tables):
    return t.embeddings.select(
        F.floor(F.col("vec_id") / 50).alias("round"), F.concat(F.lit("c"), (F.col("vec_id") % 50).cast("string")).alias("client_id"),
        F.col("embedding").cast("array<double>").alias("point"), (F.col("vec_id") % 3 == 0).cast("int").alias("label"),
    )


_POINTS = "points AS (SELECT vec_id // 50 AS round, 'c' || vec_id % 50 AS client_id, CAST(vec_id % 3 = 0 AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS point FROM embeddings)"
_OOD = f"""{_POINTS}, long AS (SELECT round, client_id, unnest(range(64)) AS axis, unnest(point) AS x FROM points),
centre AS (SELECT round, axis, median(x) AS c FROM long GROUP BY 1, 2),
distance AS (SELECT round, client_id, sqrt(sum((x - c) * (x - c))) AS distance FROM long JOIN centre USING (round, axis) GROUP BY 1, 2),
middle AS (SELECT round, median(distance) AS middle FROM distance GROUP BY 1)"""
_SILHOUETTE = f"""pairs AS (SELECT a.round, a.client_id, a.label AS own, b.label, avg(list_distance(a.point, b.point)) FILTER (a.client_id <> b.client_id) AS m, count(*) AS n FROM points a JOIN points b USING (round) GROUP BY ALL),
sil AS (SELECT round, client_id, max(m) FILTER (own = label) AS a, min(m) FILTER (own <> label) AS b, max(n) FILTER (own = label) AS size FROM pairs GROUP BY 1, 2),
silhouettes AS (SELECT round, avg(CASE WHEN size = 1 THEN 0e0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM sil GROUP BY 1)"""


@query("update_ood", "", f"WITH {_OOD} SELECT round, client_id, round(distance, 6) AS distance, round(distance / middle, 6) AS ood, middle <= 1e-12 AS degenerate FROM distance JOIN middle USING (round)")
def _(t: Tables):
    out = up.ood_scores(points(t))
    return out.select("round", "client_id", F.round("distance", 6).alias("distance"), F.round("ood", 6).alias("ood"), "degenerate")


@query("update_silhouette", "", f"WITH {_POINTS}, {_SILHOUETTE} SELECT round, round(silhouette, 6) AS silhouette FROM silhouettes")
def _(t: Tables):
    return up.silhouette(points(t)).withColumn("silhouette", F.round("silhouette", 6))


@query("benign_fallback", "", f"""WITH {_OOD}, gated AS (SELECT d.*, p.label, (round % 3) / 1e1 AS silhouette, row_number() OVER (PARTITION BY round ORDER BY distance, client_id) AS rn FROM distance d JOIN points p USING (round, client_id)),
counts AS (SELECT round, count(*) AS n, count(*) FILTER (label = 1) AS benign FROM gated GROUP BY 1)
SELECT round, client_id, CASE WHEN silhouette < 15e-2 THEN 1e0 WHEN benign < ceil(n * CAST(0.5 AS DOUBLE)) THEN CASE WHEN rn <= ceil(n * CAST(0.5 AS DOUBLE)) THEN 1e0 ELSE 0e0 END ELSE CAST(label AS DOUBLE) END AS round_score FROM gated JOIN counts USING (round)""")
def _(t: Tables):
    p = points(t)
    clients = p.join(up.ood_scores(p), ["round", "client_id"]).withColumn("in_majority", F.col("label") == 1).withColumn(
        "silhouette", (F.col("round") % 3) / 10.0
    )
    return up.gate_scores(clients).select("round", "client_id", "round_score")


@query("secure_rounds_model")
def _(t: Tables):
    return up.secure_rounds(updates(t), reference(t), max_ratio=1e3)[0]


@query("secure_rounds_evidence")
def _(t: Tables):
    return up.secure_rounds(updates(t), reference(t), max_ratio=1e3, aggregation="coordinate_median")[1].select(
        "round", "accepted", "rejected_validation", "rejected_detector", "detection"
    )


@query("secure_rounds_outcomes", "", "SELECT vec_id // 50 AS round, count(*) AS clients, 0 AS overlap FROM embeddings GROUP BY 1")
def _(t: Tables):
    """Every client of a round has one outcome: accepted, rejected by validation, or rejected by the detector."""
    evidence = up.secure_rounds(updates(t), reference(t), max_ratio=1e3, aggregation="coordinate_median")[1]
    names = ["accepted", "rejected_validation", "rejected_detector"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i]]
    return evidence.select(
        "round", sum((F.size(n) for n in names), F.lit(0)).cast("long").alias("clients"),
        sum((F.size(F.array_intersect(a, b)) for a, b in pairs), F.lit(0)).alias("overlap"),
    )


_CONFUSION = """count(*) FILTER (malicious AND rejected) AS tp, count(*) FILTER (NOT malicious AND rejected) AS fp, count(*) FILTER (NOT malicious AND NOT rejected) AS tn, count(*) FILTER (malicious AND NOT rejected) AS fn"""
_RATES = "round(tp / nullif(tp + fn, 0), 6) AS tpr, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(tn / nullif(tn + fp, 0), 6) AS tnr"


@query("detection_confusion", "matrix_runs", f"WITH c AS (SELECT mode, attack, {_CONFUSION} FROM matrix_runs GROUP BY 1, 2) SELECT *, {_RATES} FROM c")
def _(t: Tables):
    out = up.detection_confusion(t.matrix_runs, "mode", "attack")
    return out.select("mode", "attack", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "tnr")])


@query("mean_overhead", "matrix_runs", "SELECT mode, round(avg(seconds), 6) AS mean_seconds FROM matrix_runs GROUP BY 1")
def _(t: Tables):
    return up.mean_overhead(t.matrix_runs).withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("attack_degradation", "matrix_runs", """WITH cells AS (SELECT mode, attack, avg(macro_f1) AS macro_f1, avg(accuracy) AS accuracy FROM matrix_runs GROUP BY 1, 2)
SELECT c.mode, c.attack, round(c.macro_f1, 6) AS macro_f1, round(c.accuracy, 6) AS accuracy, round(n.macro_f1 - c.macro_f1, 6) AS macro_f1_loss, round(n.accuracy - c.accuracy, 6) AS accuracy_loss FROM cells c JOIN cells n ON n.mode = c.mode AND n.attack = 'none'""")
def _(t: Tables):
    out = up.degradation(t.matrix_runs, ["macro_f1", "accuracy"])
    return out.select("mode", "attack", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("round_summary", "trust_rounds", """SELECT round, max(silhouette) AS silhouette, count(*) FILTER (NOT failed_validation) AS n_clients, CAST(count(*) FILTER (NOT failed_validation AND score >= CAST(0.35 AS DOUBLE)) AS INTEGER) AS n_accepted,
 CAST(count(*) FILTER (failed_validation) AS INTEGER) AS n_rejected_validation, CAST(count(*) FILTER (NOT failed_validation AND score < CAST(0.35 AS DOUBLE)) AS INTEGER) AS n_rejected_detector, coalesce(max(ood) FILTER (NOT failed_validation), 0e0) AS max_ood FROM trust_rounds GROUP BY 1""")
def _(t: Tables):
    return up.round_summary(trust_log(t))


@query("trust_trajectory_rows", "trust_rounds", "SELECT round, client_id, round(score, 6) AS trust FROM trust_rounds WHERE NOT failed_validation")
def _(t: Tables):
    return up.trust_rows(trust_log(t)).withColumn("trust", F.round("trust", 6))


@query("trust_trajectories", "trust_rounds", """SELECT client_id, count(*) AS rounds, min(round) AS first_round, max(round) AS last_round, round(arg_max(score, round), 6) AS last_trust, arg_max(score, round) < CAST(0.35 AS DOUBLE) AS below FROM trust_rounds WHERE NOT failed_validation GROUP BY 1""")
def _(t: Tables):
    return up.trust_trajectories(trust_log(t)).withColumn("last_trust", F.round("last_trust", 6))


@query("rejection_totals", "trust_rounds", """SELECT count(DISTINCT round) AS rounds, count(*) FILTER (NOT failed_validation AND score >= CAST(0.35 AS DOUBLE)) AS accepted, count(*) FILTER (failed_validation) AS rejected_validation, count(*) FILTER (NOT failed_validation AND score < CAST(0.35 AS DOUBLE)) AS rejected_detector FROM trust_rounds""")
def _(t: Tables):
    return up.rejection_totals(trust_log(t))


@query("best_candidate", "matrix_runs", f"""WITH c AS (SELECT seed, {_CONFUSION} FROM matrix_runs GROUP BY 1), r AS (SELECT *, tp / nullif(tp + fn, 0) AS tpr, fp / nullif(fp + tn, 0) AS fpr FROM c)
SELECT seed, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, fpr <= CAST(0.1 AS DOUBLE) AS met_constraint FROM r ORDER BY met_constraint DESC, CASE WHEN met_constraint THEN tpr ELSE tpr - fpr END DESC, seed LIMIT 1""")
def _(t: Tables):
    best = up.best_candidate(up.detection_confusion(t.matrix_runs, "seed"), "seed")
    return best.select("seed", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"), "met_constraint")
