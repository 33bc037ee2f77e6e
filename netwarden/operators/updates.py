"""Client model updates as a long table: validation, robust aggregation, poisoning detection.

``updates``: round, client_id, param, idx, value, n_examples. ``reference``: param, idx, value.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from netwarden.constants import EMA_ALPHA, FLAT_SCALE, MIN_SILHOUETTE, REJECT_BELOW_TRUST
from netwarden.functions.ordered import exact_quantiles, hash_blocks, order_blocks, with_ema, with_rank
from netwarden.session import checkpointed

COORD = ["param", "idx"]
CELLS_PER_CHUNK = 1_000_000
TILE_ROWS = 4_000


def deltas(updates: DataFrame, reference: DataFrame) -> DataFrame:
    """Update minus reference, coordinate by coordinate."""
    base = reference.select(*COORD, F.col("value").alias("__ref"))
    return updates.join(base, COORD).withColumn("delta", F.col("value") - F.col("__ref")).drop("__ref")


def update_norms(updates: DataFrame, reference: DataFrame) -> DataFrame:
    return deltas(updates, reference).groupBy("round", "client_id").agg(
        F.sqrt(F.sum(F.col("delta") * F.col("delta"))).alias("norm"), F.count(F.lit(1)).alias("n_values")
    )


def validate_updates(updates: DataFrame, reference: DataFrame, max_abs: float, max_ratio: float) -> DataFrame:
    """Every structural reason to reject an update, per round and client.

    A parameter set that differs from the reference is the only reason given then; sizes,
    non-finite values, magnitude and the norm ratio are checked otherwise.
    """
    base = reference.select(*COORD, F.col("value").cast("double").alias("__ref"))
    value = F.col("value")
    infinite = F.isnan(value) | (F.abs(value) == float("inf"))
    per_param = updates.join(base, COORD, "left").groupBy("round", "client_id", "param").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("__ref").alias("matched"),
        F.bool_or(infinite).alias("broken"),
        F.max(F.when(~F.isnan(value), F.abs(value))).alias("peak"),
        F.sum((value - F.col("__ref")) * (value - F.col("__ref"))).alias("update_sq"),
    )
    sizes = reference.groupBy("param").agg(F.count(F.lit(1)).alias("ref_n"), F.sum(F.col("value") * F.col("value")).alias("ref_sq"))
    n_params = sizes.count()
    same_shape = (F.col("n") == F.col("ref_n")) & (F.col("matched") == F.col("ref_n"))
    said = F.when(~same_shape, F.array(F.concat(F.lit("shape mismatch for "), "param"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("broken"), F.concat(F.lit("non-finite values in "), "param")),
                F.when(F.col("peak") > max_abs, F.concat(F.lit("absolute parameter bound exceeded in "), "param")),
            )
        )
    )
    # One row per layer of one client: bounded by the model, not by the data.
    client = per_param.join(sizes, "param", "left").groupBy("round", "client_id").agg(
        (F.count("ref_n") != n_params).alias("__missing"),
        F.bool_or(F.col("ref_n").isNull()).alias("__extra"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("param", said.alias("said")))), lambda s: s["said"])).alias("__said"),
        F.coalesce(F.sum(F.when(same_shape, F.col("update_sq"))), F.lit(0.0)).alias("__update_sq"),
        F.coalesce(F.sum(F.when(same_shape, F.col("ref_sq"))), F.lit(0.0)).alias("__ref_sq"),
    )
    norm, ref_norm = F.sqrt("__update_sq"), F.sqrt("__ref_sq")
    ratio = norm / F.greatest(ref_norm, F.lit(1e-12))
    too_far = F.when(~F.isnan(ratio) & (ratio > max_ratio), F.concat(F.lit("update norm ratio exceeds "), F.lit(str(max_ratio))))
    mismatch = F.col("__missing") | F.col("__extra")
    reasons = F.when(mismatch, F.array(F.lit("state keys mismatch"))).otherwise(
        F.array_compact(F.concat(F.col("__said"), F.array(too_far)))
    )
    return client.select(
        "round", "client_id", reasons.alias("reasons"), (F.size(reasons) == 0).alias("accepted"),
        F.when(mismatch, F.lit(0.0)).otherwise(norm).alias("update_norm"),
        F.when(mismatch, F.lit(0.0)).otherwise(ref_norm).alias("reference_norm"),
    )


def weighted_average(updates: DataFrame, weight: str = "n_examples") -> DataFrame:
    """Weighted mean per coordinate; weights must be non-negative with a positive sum."""
    return updates.groupBy("round", *COORD).agg(
        F.when(
            (F.min(weight) >= 0) & (F.sum(weight) > 0), F.sum(F.col(weight) * F.col("value")) / F.sum(weight)
        ).otherwise(F.raise_error(F.lit("weights must be non-negative with a positive sum")).cast("double")).alias("value")
    )


def coordinate_median(updates: DataFrame) -> DataFrame:
    # The group is one coordinate: as many values as the round has clients.
    return updates.groupBy("round", *COORD).agg(F.median("value").alias("value"))


def trimmed_mean(updates: DataFrame, ratio: float) -> DataFrame:
    """Unweighted mean without the ``floor(n*ratio)`` smallest and largest values."""
    if not 0 <= ratio < 0.5:
        raise ValueError("trim ratio must be in [0, 0.5)")
    group = Window.partitionBy("round", *COORD)
    trim = F.floor(F.col("__n") * F.lit(ratio))
    placed = updates.select(
        "round", *COORD, "value",
        F.row_number().over(group.orderBy("value", "client_id")).alias("__rn"),
        F.count(F.lit(1)).over(group).alias("__n"),
    )
    kept = placed.filter((F.col("__rn") > trim) & (F.col("__rn") <= F.col("__n") - trim))
    return kept.groupBy("round", *COORD).agg(F.avg("value").alias("value"))


def aggregate_updates(updates: DataFrame, method: str = "weighted_average", trim_ratio: float = 0.2) -> DataFrame:
    if method == "coordinate_median":
        return coordinate_median(updates)
    if method == "trimmed_mean":
        return trimmed_mean(updates, trim_ratio)
    if method == "weighted_average":
        return weighted_average(updates)
    raise ValueError(f"unknown aggregation method {method!r}")


# --- stress transforms for robustness studies ------------------------------------------------

def _around_reference(updates: DataFrame, reference: DataFrame, flagged: Column, factor: Column) -> DataFrame:
    base = reference.select(*COORD, F.col("value").alias("__ref"))
    moved = F.col("__ref") + factor * (F.col("value") - F.col("__ref"))
    return updates.join(base, COORD).withColumn("value", F.when(flagged, moved).otherwise(F.col("value"))).drop("__ref")


def sign_flip(updates: DataFrame, reference: DataFrame, flagged: Column, scale: float = 1.0) -> DataFrame:
    if scale < 0:
        raise ValueError("scale must be non-negative")
    return _around_reference(updates, reference, flagged, F.lit(-float(scale)))


def gradual_scaling(updates: DataFrame, reference: DataFrame, flagged: Column, growth: float = 1.0) -> DataFrame:
    return _around_reference(updates, reference, flagged, 1.0 + F.lit(float(growth)) * F.col("round"))


def gaussian_noise(updates: DataFrame, reference: DataFrame, flagged: Column, sigma: float, seed: int = 0) -> DataFrame:
    """Noise scaled to each client's own update; hashed per value, so retries repeat it."""
    if not math.isfinite(sigma) or sigma < 0:
        raise ValueError("sigma must be finite and non-negative")
    uniform = lambda salt: (F.pmod(F.xxhash64(F.lit(seed + salt), "round", "client_id", *COORD), F.lit(2**53)) + 0.5) / float(2**53)
    normal = F.sqrt(-2.0 * F.log(uniform(0))) * F.cos(2.0 * math.pi * uniform(1))
    spread = update_norms(updates, reference).select(
        "round", "client_id", (F.lit(float(sigma)) * F.col("norm") / F.sqrt("n_values")).alias("__sd")
    )
    noisy = updates.join(spread, ["round", "client_id"])
    return noisy.withColumn("value", F.when(flagged, F.col("value") + normal * F.col("__sd")).otherwise(F.col("value"))).drop("__sd")


def label_noise(rows: DataFrame, label: str, row_id: str, normal: str, fraction: float = 1.0, seed: int = 0) -> DataFrame:
    """Relabel a seeded fraction of the non-normal rows as normal."""
    risky = rows.filter(F.col(label) != normal).withColumn("__digest", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string"))))
    n = risky.count()
    ranked = with_rank(risky, [], ["__digest", row_id], hash_blocks(risky, "__digest", rows=n), "__rn")
    changed = ranked.withColumn(label, F.when(F.col("__rn") <= round(n * fraction), normal).otherwise(F.col(label)))
    return changed.drop("__digest", "__rn").unionByName(rows.filter((F.col(label) == normal) | F.col(label).isNull()))


# --- detection --------------------------------------------------------------------------------

def in_chunks(vectors: DataFrame) -> DataFrame:
    """The cells with a ``__chunk`` of their coordinate: one chunk a round, and more only in rounds of more than ``CELLS_PER_CHUNK`` cells."""
    # At most one row for every CELLS_PER_CHUNK cells.
    large = vectors.groupBy(F.col("round").alias("__round")).agg(F.ceil(F.count(F.lit(1)) / CELLS_PER_CHUNK).alias("__chunks")).filter("__chunks > 1")
    chunk = F.pmod(F.xxhash64(*COORD), F.coalesce("__chunks", F.lit(1).cast("long"))).alias("__chunk")
    return vectors.join(F.broadcast(large), F.col("round").eqNullSafe(F.col("__round")), "left").select("round", "client_id", *COORD, "delta", chunk)


def _sum_of_shares(shares: Column) -> Column:
    """Element-wise sum of the arrays ``gram`` of an array of structs."""
    total = F.aggregate(
        F.slice(shares, F.lit(2), F.size(shares)), shares[0]["gram"], lambda total, s: F.zip_with(total, s["gram"], lambda x, y: x + y)
    )
    lengths = F.array_distinct(F.transform(shares, lambda s: F.size(s["gram"])))
    return F.when(F.size(lengths) == 1, total).otherwise(F.raise_error(F.lit("every client must hold every coordinate")).cast("array<double>"))


def project_updates(vectors: DataFrame, components: int = 5) -> DataFrame:
    """Standardize each coordinate over a round's clients, then project on the main components.

    Coordinates of a large round are cut into chunks; a chunk yields its share of the clients x
    clients Gram matrix. Only that matrix, whose size is set by the clients of one round, is brought
    together, so the length of the model does not matter. ``vectors``: round, client_id,
    param, idx, delta with every client holding every coordinate.
    """
    def gram(chunk: pd.DataFrame) -> pd.DataFrame:
        wide = chunk.pivot(index="client_id", columns=["param", "idx"], values="delta").sort_index()
        x = wide.to_numpy(dtype=float)
        scale = x.std(axis=0)
        z = (x - x.mean(axis=0)) / np.where(scale == 0, 1.0, scale)
        return pd.DataFrame(
            {"round": chunk["round"].iloc[0], "client_id": wide.index, "__chunk": chunk["__chunk"].iloc[0], "gram": list(z @ z.T)}
        )

    shares = in_chunks(vectors).groupBy("round", "__chunk").applyInPandas(gram, "round long, client_id string, __chunk long, gram array<double>")
    gathered = shares.groupBy("round", "client_id").agg(F.array_sort(F.collect_list(F.struct("__chunk", "gram"))).alias("__shares"))
    summed = gathered.select("round", "client_id", _sum_of_shares(F.col("__shares")).alias("gram"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("client_id")
        matrix = np.stack(rows["gram"].to_list())
        values, axes = np.linalg.eigh(matrix)
        values, axes = np.clip(values[::-1], 0.0, None), axes[:, ::-1]
        k = max(1, min(components, len(matrix) - 1))
        total = values.sum()
        explained = float(np.clip(values[:k].sum() / total, 0.0, 1.0)) if total > 0 else 0.0
        points = axes[:, :k] * np.sqrt(values[:k])
        return pd.DataFrame(
            {"round": rows["round"].to_numpy(), "client_id": rows["client_id"].to_numpy(), "point": list(points),
             "explained": explained, "n_components": k}
        )

    return summed.groupBy("round").applyInPandas(
        solve, "round long, client_id string, point array<double>, explained double, n_components int"
    )


def _ward_halves(points: np.ndarray) -> np.ndarray:
    """Two-cluster Ward labels by nearest-neighbour chains: O(n^2) time, O(n) memory."""
    n = len(points)
    centres, sizes = points.astype(float).copy(), np.ones(n)
    members = {i: [i] for i in range(n)}
    active = np.ones(n, dtype=bool)
    chain: list[int] = []
    labels = np.zeros(n, dtype=int)
    for _ in range(n - 1):
        while True:
            if not chain:
                chain.append(int(np.flatnonzero(active)[0]))
            tip = chain[-1]
            gap = ((centres - centres[tip]) ** 2).sum(axis=1) * sizes * sizes[tip] / (sizes + sizes[tip])
            gap[~active] = np.inf
            gap[tip] = np.inf
            nearest = int(gap.argmin())
            if len(chain) > 1 and gap[chain[-2]] <= gap[nearest]:
                nearest = chain[-2]
            if len(chain) > 1 and nearest == chain[-2]:
                break
            chain.append(nearest)
        b, a = chain.pop(), chain.pop()
        if active.sum() == 2:
            labels[members[b]] = 1
            break
        total = sizes[a] + sizes[b]
        centres[a] = (centres[a] * sizes[a] + centres[b] * sizes[b]) / total
        sizes[a] = total
        active[b] = False
        members[a] += members.pop(b)
    return labels


def _density_labels(points: np.ndarray, radius: float, min_neighbours: int) -> np.ndarray:
    """DBSCAN labels (-1 is noise); neighbours are looked up one point at a time."""
    near = lambda i: np.flatnonzero(((points - points[i]) ** 2).sum(axis=1) <= radius * radius)
    core = np.array([len(near(i)) >= min_neighbours for i in range(len(points))])
    labels = np.full(len(points), -1)
    current = 0
    for start in np.flatnonzero(core):
        if labels[start] >= 0:
            continue
        frontier = [start]
        labels[start] = current
        while frontier:
            for j in near(frontier.pop()):
                if labels[j] < 0:
                    labels[j] = current
                    if core[j]:
                        frontier.append(j)
        current += 1
    return labels


def cluster_clients(projected: DataFrame, method: str = "agglomerative", radius: float = 1.5) -> DataFrame:
    """Cluster label per client and whether it is in the round's largest cluster.

    A group is the clients of one round with a handful of numbers each.
    """
    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("client_id")
        points = np.stack(rows["point"].to_list())
        if method == "dbscan":
            labels = _density_labels(points, radius, max(2, math.ceil(len(points) * 0.2)))
        else:
            labels = _ward_halves(points)
        known = labels[labels >= 0]
        values, counts = np.unique(known, return_counts=True)
        benign = values[counts.argmax()] if len(known) else -1
        return pd.DataFrame(
            {"round": rows["round"].to_numpy(), "client_id": rows["client_id"].to_numpy(), "label": labels, "in_majority": labels == benign}
        )

    return projected.groupBy("round").applyInPandas(split, "round long, client_id string, label int, in_majority boolean")


def ood_scores(points: DataFrame) -> DataFrame:
    """Distance to the coordinate-wise median centre over the round's median distance.

    ``points``: round, client_id, point array<double>. Rounds whose median distance is ~0 get
    zeros and ``degenerate``.
    """
    long = points.select("round", "client_id", F.posexplode("point").alias("axis", "x"))
    centre = long.groupBy("round", "axis").agg(F.median("x").alias("c"))
    squared = (F.col("x") - F.col("c")) * (F.col("x") - F.col("c"))
    distance = long.join(centre, ["round", "axis"]).groupBy("round", "client_id").agg(F.sqrt(F.sum(squared)).alias("distance"))
    middle = exact_quantiles(distance, ["round"], "distance", {"middle": 0.5})
    flat = F.col("middle") <= FLAT_SCALE
    return distance.join(middle, "round").select(
        "round", "client_id", "distance", F.when(flat, F.lit(0.0)).otherwise(F.col("distance") / F.col("middle")).alias("ood"),
        flat.alias("degenerate"),
    )


def silhouette(points: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Mean Euclidean silhouette per round (null unless 2..n-1 labels).

    ``points``: round, client_id, point, label. Clients are cut into tiles; a tile pair only
    emits, per client and label, a distance sum and a count, never the pairs themselves.
    """
    n = points.groupBy("round").count().agg(F.max("count")).first()[0] or 0
    tiles = max(1, math.ceil(n / tile_rows))
    placed = points.select("round", "client_id", "point", "label", F.pmod(F.xxhash64("client_id"), F.lit(tiles)).cast("int").alias("tile"))
    every = F.array(*[F.lit(i) for i in range(tiles)])
    left = placed.withColumnRenamed("tile", "a").withColumn("b", F.explode(every))
    # Fresh column identities, so the two sides of one frame can be told apart.
    fresh = placed.select(*[F.col(c).alias(c) for c in placed.columns])
    right = fresh.withColumnRenamed("tile", "b").withColumn("a", F.explode(every))

    def sums(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        columns = ["round", "client_id", "own", "label", "total", "n"]
        if mine.empty or others.empty:
            return pd.DataFrame(columns=columns)
        p, q = np.stack(mine["point"].to_list()), np.stack(others["point"].to_list())
        parts = []
        for label, at in others.groupby("label").indices.items():
            total = np.zeros(len(p))
            for start in range(0, len(at), 256):
                total += np.sqrt(((p[:, None, :] - q[None, at[start : start + 256], :]) ** 2).sum(axis=2)).sum(axis=1)
            parts.append(pd.DataFrame({
                "round": mine["round"].to_numpy(), "client_id": mine["client_id"].to_numpy(), "own": mine["label"].to_numpy(),
                "label": label, "total": total, "n": len(at),
            }))
        return pd.concat(parts)[columns]

    shares = left.groupBy("round", "a", "b").cogroup(right.groupBy("round", "a", "b")).applyInPandas(
        sums, "round long, client_id string, own int, label int, total double, n long"
    )
    per_label = shares.groupBy("round", "client_id", "own", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    same = F.col("own") == F.col("label")
    per_client = per_label.groupBy("round", "client_id").agg(
        F.max(F.when(same, F.col("n"))).alias("size"),
        F.max(F.when(same, F.col("total"))).alias("inside"),
        F.min(F.when(~same, F.col("total") / F.col("n"))).alias("b"),
        F.max("own").alias("own"),
    )
    a = F.col("inside") / (F.col("size") - 1)
    widest = F.greatest(a, F.col("b"))
    s = F.when(F.col("size") == 1, F.lit(0.0)).when(widest == 0, F.lit(0.0)).otherwise((F.col("b") - a) / widest)
    labels = F.countDistinct("own")
    return per_client.withColumn("s", s).groupBy("round").agg(
        F.when((labels >= 2) & (labels <= F.count(F.lit(1)) - 1), F.avg("s")).alias("silhouette")
    )


def gate_scores(clients: DataFrame, min_benign: float = 0.5, min_silhouette: float = MIN_SILHOUETTE) -> DataFrame:
    """Round score per client after the evidence gate and the minimum-benign fallback.

    ``clients``: round, client_id, in_majority, distance, degenerate, silhouette. Without
    evidence of two groups everybody scores 1; when too few are in the majority, the clients
    closest to the centre are kept instead.
    """
    per_round = clients.groupBy("round").agg(
        F.count(F.lit(1)).alias("__n"), F.count_if("in_majority").alias("__benign")
    )
    ranked = with_rank(clients, ["round"], ["distance", "client_id"], order_blocks(clients, ["distance", "client_id"]), "__rn")
    joined = ranked.join(per_round, "round")
    unclear = F.col("degenerate") | F.col("silhouette").isNull() | (F.col("silhouette") < min_silhouette)
    minimum = F.greatest(F.lit(1), F.ceil(F.col("__n") * F.lit(min_benign)))
    short = F.col("__benign") < minimum
    keep = F.when(unclear, F.lit(True)).when(short, F.col("__rn") <= minimum).otherwise(F.col("in_majority"))
    return joined.withColumn("round_score", keep.cast("double")).withColumn("no_evidence", unclear).withColumn(
        "fallback", ~unclear & short
    ).drop("__n", "__benign", "__rn")


def secure_rounds(
    updates: DataFrame,
    reference: DataFrame,
    max_abs: float = 1e3,
    max_ratio: float = 10.0,
    quorum: int = 3,
    components: int = 5,
    cluster_method: str = "agglomerative",
    aggregation: str = "trimmed_mean",
    trim_ratio: float = 0.2,
    alpha: float = EMA_ALPHA,
    reject_below: float = REJECT_BELOW_TRUST,
) -> tuple[DataFrame, DataFrame]:
    """Validate, detect, smooth and aggregate every round: (new models, evidence per round).

    Updates that carry an ``error`` flag are dropped first. Rounds below the quorum produce
    evidence but no model.
    """
    if "error" in updates.columns:
        updates = updates.filter(~F.col("error")).drop("error")
    checked = checkpointed(validate_updates(updates, reference, max_abs, max_ratio))
    sizes = checked.groupBy("round").agg(F.count_if("accepted").alias("n_valid"))
    able = sizes.filter(F.col("n_valid") >= quorum).select("round")
    valid = checked.filter("accepted").select("round", "client_id").join(able, "round")
    sound = updates.join(valid, ["round", "client_id"])
    projected = checkpointed(project_updates(deltas(sound, reference), components))
    clusters = cluster_clients(projected, cluster_method)
    # Clusters and scores are read by every count and sample of the ordered steps below.
    labelled = checkpointed(projected.join(clusters, ["round", "client_id"]))
    scored = checkpointed(labelled.join(ood_scores(projected), ["round", "client_id"]).join(silhouette(labelled), "round"))
    gated = gate_scores(scored)
    # Per-client rows only; the model values are not in it.
    trusted = checkpointed(
        with_ema(gated, ["client_id"], ["round"], order_blocks(gated, "round"), "round_score", alpha, 1.0, "trust")
        .withColumn("kept", F.col("trust") >= reject_below)
        .drop("point")
    )
    kept = sound.join(trusted.filter("kept").select("round", "client_id"), ["round", "client_id"])
    models = aggregate_updates(kept, aggregation, trim_ratio)
    listed = lambda condition: F.array_sort(F.collect_list(F.when(condition, F.col("client_id"))))
    as_map = lambda column: F.map_from_entries(F.array_sort(F.collect_list(F.struct("client_id", column))))
    detection = trusted.groupBy("round").agg(
        listed(F.col("kept")).alias("accepted"), listed(~F.col("kept")).alias("rejected_detector"),
        as_map("trust").alias("trust_scores"), as_map("ood").alias("ood_scores"),
        F.struct(
            F.lit(cluster_method).alias("cluster_method"), F.count(F.lit(1)).alias("n_clients"),
            F.max("n_components").alias("n_components"), F.max("explained").alias("explained_variance_ratio"),
            F.max("silhouette").alias("silhouette"), F.sum("round_score").cast("long").alias("benign_cluster_size"),
            F.bool_or("fallback").alias("distance_fallback_used"), F.bool_or("degenerate").alias("degenerate"),
            F.bool_or("no_evidence").alias("no_separation_evidence"),
        ).alias("detection"),
    )
    rejected = checked.groupBy("round").agg(listed(~F.col("accepted")).alias("rejected_validation"))
    none = F.array().cast("array<string>")
    evidence = rejected.join(detection, "round", "left").withColumn("accepted", F.coalesce("accepted", none)).withColumn(
        "rejected_detector", F.coalesce("rejected_detector", none)
    )
    return models, evidence


# --- evidence analytics -----------------------------------------------------------------------

def detection_confusion(rows: DataFrame, *keys: str) -> DataFrame:
    """Counts and TPR/FPR/TNR of ``malicious`` against ``rejected``; null on empty denominators."""
    bad, out = F.col("malicious"), F.col("rejected")
    counted = rows.groupBy(*keys).agg(
        F.count_if(bad & out).alias("tp"), F.count_if(~bad & out).alias("fp"),
        F.count_if(~bad & ~out).alias("tn"), F.count_if(bad & ~out).alias("fn"),
    )
    ratio = lambda a, *rest: F.try_divide(F.col(a).cast("double"), sum((F.col(r) for r in rest), F.col(a)).cast("double"))
    return counted.withColumn("tpr", ratio("tp", "fn")).withColumn("fpr", ratio("fp", "tn")).withColumn("tnr", ratio("tn", "fp"))


def mean_overhead(runs: DataFrame, seconds: str = "seconds") -> DataFrame:
    return runs.groupBy("mode").agg(F.avg(seconds).alias("mean_seconds"))


def degradation(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """Metric loss of attacked cells against the clean cell of the same mode."""
    cells = runs.groupBy("mode", "attack").agg(*[F.avg(m).alias(m) for m in metrics])
    clean = cells.filter("attack = 'none'").select("mode", *[F.col(m).alias(f"__clean_{m}") for m in metrics])
    return cells.join(clean, "mode").select(
        "mode", "attack", *metrics, *[(F.col(f"__clean_{m}") - F.col(m)).alias(f"{m}_loss") for m in metrics]
    )


def round_summary(log: DataFrame) -> DataFrame:
    """Accepted/rejected counts, largest OOD score and separation quality per round."""
    return log.select(
        "round", F.col("detection.silhouette").alias("silhouette"), F.col("detection.n_clients").alias("n_clients"),
        F.size("accepted").alias("n_accepted"), F.size("rejected_validation").alias("n_rejected_validation"),
        F.size("rejected_detector").alias("n_rejected_detector"),
        F.coalesce(F.array_max(F.map_values("ood_scores")), F.lit(0.0)).alias("max_ood"),
    )


def trust_rows(log: DataFrame) -> DataFrame:
    return log.select("round", F.explode("trust_scores").alias("client_id", "trust"))


def trust_trajectories(log: DataFrame, reject_below: float = REJECT_BELOW_TRUST) -> DataFrame:
    """Latest trust per client, its first and last round, and whether it is below the limit.

    The trajectory itself stays a row per round (``trust_rows``); no client's history is
    gathered into one value.
    """
    rows = trust_rows(log)
    return rows.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("rounds"), F.min("round").alias("first_round"), F.max("round").alias("last_round"),
        F.max_by("trust", "round").alias("last_trust"),
    ).withColumn("below", F.col("last_trust") < reject_below)


def rejection_totals(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("rounds"), F.sum(F.size("accepted")).alias("accepted"),
        F.sum(F.size("rejected_validation")).alias("rejected_validation"), F.sum(F.size("rejected_detector")).alias("rejected_detector"),
    )


def best_candidate(results: DataFrame, order: str, tolerance: float = 0.1) -> DataFrame:
    """Highest TPR with FPR within tolerance, else highest TPR - FPR; error when none is defined."""
    usable = results.filter(F.col("tpr").isNotNull() & F.col("fpr").isNotNull())
    within = F.col("fpr") <= tolerance
    # "Within" sorts first; the two branches then use their own score. One row by definition.
    best = usable.withColumn("met_constraint", within).withColumn(
        "__score", F.when(within, F.col("tpr")).otherwise(F.col("tpr") - F.col("fpr"))
    ).orderBy(F.desc("met_constraint"), F.desc("__score"), order).limit(1)
    if best.isEmpty():
        raise ValueError("no candidate has a defined TPR and FPR")
    return best.drop("__score")
