"""Leakage-safe splits, sampling and client partitions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from netwarden.functions.ordered import hash_blocks, micros, order_blocks, with_rank


def seeded_digest(seed: int, *columns: str) -> Column:
    """A reproducible shuffle key; md5 so any engine can repeat it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def _ranked_by_hash(df: DataFrame, keys: Sequence[str], row_id: str, seed: int, rows: int | None = None) -> DataFrame:
    df = df.withColumn("__digest", seeded_digest(seed, row_id))
    return with_rank(df, keys, ["__digest", row_id], hash_blocks(df, "__digest", rows=rows), "__rn").drop("__digest")


def _with_key_counts(df: DataFrame, key: str) -> DataFrame:
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), key)


def class_key(label: str) -> Column:
    """The label as a non-null grouping key; rows without a label form their own class."""
    return F.coalesce(F.col(label).cast("string"), F.lit("UNKNOWN"))


def stratified_split(
    df: DataFrame, label: str, row_id: str, test_size: float = 0.15, val_size: float = 0.15, seed: int = 42
) -> DataFrame:
    """Seeded row split with the same shares inside every label."""
    keyed = df.withColumn("__key", class_key(label))
    counted = _with_key_counts(_ranked_by_hash(keyed, ["__key"], row_id, seed), "__key")
    relative = val_size / (1.0 - test_size)
    n_test = F.bround(F.col("__n") * F.lit(test_size), 0)
    n_val = F.bround((F.col("__n") - n_test) * F.lit(relative), 0)
    split = F.when(F.col("__rn") <= n_test, "test").when(F.col("__rn") <= n_test + n_val, "val").otherwise("train")
    return counted.withColumn("split", split).drop("__rn", "__n", "__key")


def split_sizes(n: int, test_size: float, val_size: float) -> tuple[int, int, int]:
    """(train, val, test) counts for ``n`` sessions: one session at least is tested, and validation, from three sessions on,
    takes no more than leaves one for training."""
    test = max(1, round(n * test_size)) if n else 0
    wanted = max(1, round(n * val_size)) if n > 2 else 0
    val = min(wanted, max(0, n - test - 1))
    return n - test - val, val, test


def session_split(
    rows: DataFrame,
    session: str = "session_id",
    ts: str = "ts",
    test_size: float = 0.15,
    val_size: float = 0.15,
    chronological: bool = True,
    seed: int = 42,
) -> DataFrame:
    """Assign whole sessions to train/val/test; a split without sessions is an error."""
    sessions = rows.groupBy(session).agg(F.min(micros(ts)).alias("__start"))
    n = sessions.count()
    train, val, test = split_sizes(n, test_size, val_size)
    if min(train, val, test) <= 0:
        raise ValueError(f"cannot fill every split from {n} session(s): train={train} val={val} test={test}")
    if chronological:
        ranked = with_rank(sessions, [], ["__start", session], order_blocks(sessions, ["__start", session], rows=n), "__rn")
        names, cuts = ("train", "val", "test"), (train, train + val)
    else:
        ranked = _ranked_by_hash(sessions, [], session, seed, rows=n)
        names, cuts = ("test", "val", "train"), (test, test + val)
    split = F.when(F.col("__rn") <= cuts[0], names[0]).when(F.col("__rn") <= cuts[1], names[1]).otherwise(names[2])
    return rows.join(ranked.select(session, split.alias("split")), session)


def leakage_audit(rows: DataFrame, session: str = "session_id", start: str = "ts", end: str = "ts") -> DataFrame:
    """One row: sessions shared by two splits, time order at the split borders, verdict."""
    marks = [F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "val", "test")]
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    overlap = rows.groupBy(session).agg(*marks).agg(
        *[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}_overlap") for a, b in pairs],
        *[F.sum(s).alias(f"{s}_sessions") for s in ("train", "val", "test")],
    )
    at = lambda f, column, s: f(F.when(F.col("split") == s, micros(column)))
    borders = rows.agg(
        at(F.max, end, "train").alias("train_end"),
        at(F.min, start, "val").alias("val_start"),
        at(F.max, end, "val").alias("val_end"),
        at(F.min, start, "test").alias("test_start"),
    )
    both = overlap.withColumn("__one", F.lit(1)).join(borders.withColumn("__one", F.lit(1)), "__one").drop("__one")
    in_order = F.coalesce(
        (F.col("train_end") <= F.col("val_start")) & (F.col("val_end") <= F.col("test_start")), F.lit(False)
    )
    shared = sum((F.col(f"{a}_{b}_overlap") for a, b in pairs), F.lit(0))
    return both.withColumn("chronology_ok", in_order).withColumn("leakage_free", (shared == 0) & in_order)


def heldout_rows(stored: DataFrame, repeated: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stored held-out rows, after checking that repeating the split gives the same rows."""
    a = stored.filter("split = 'test'").select(*columns)
    b = repeated.filter("split = 'test'").select(*columns)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("the stored held-out rows differ from the repeated split")
    return a


def iid_partition(df: DataFrame, row_id: str, clients: int, seed: int = 42) -> DataFrame:
    """Near-equal random client parts (sizes differ by at most one)."""
    n = df.count()
    base, extra = divmod(n, clients)
    ranked = _ranked_by_hash(df, [], row_id, seed, rows=n)
    at = F.col("__rn") - 1
    wide = extra * (base + 1)
    client = F.when(at < wide, F.floor(at / (base + 1))).otherwise(extra + F.floor((at - wide) / max(base, 1)))
    return ranked.withColumn("client_id", client.cast("int")).drop("__rn")


def dirichlet_partition(
    df: DataFrame,
    label: str,
    row_id: str,
    clients: int,
    alpha: float,
    seed: int = 42,
    min_samples: int = 1,
    max_attempts: int = 100,
    min_class_samples: int = 0,
) -> DataFrame:
    """Label-skewed client parts: class shares drawn per client, redrawn until big enough.

    Only the class counts reach the driver; rows are placed by their rank inside the class.
    """
    if clients < 2 or alpha <= 0:
        raise ValueError("need at least two clients and a positive alpha")
    df = df.withColumn("__key", class_key(label))
    classes = [(r[0], r[1]) for r in df.groupBy("__key").count().orderBy("__key").collect()]
    rng = np.random.default_rng(seed)
    for _ in range(max_attempts):
        cuts = [(np.cumsum(rng.dirichlet([alpha] * clients)) * n).astype(int)[:-1].tolist() for _, n in classes]
        sizes = np.array([np.diff([0, *c, n]) for c, (_, n) in zip(cuts, classes)])
        if sizes.sum(axis=0).min() >= min_samples and sizes.min() >= min_class_samples:
            break
    else:
        raise RuntimeError(f"no partition met the minimum sizes in {max_attempts} attempts")
    spark = df.sparkSession
    plan = spark.createDataFrame([(v, c) for (v, _), c in zip(classes, cuts)], "__key string, __cuts array<long>")
    ranked = _ranked_by_hash(df, ["__key"], row_id, seed)
    # One row per class with clients-1 numbers; Spark sees its size.
    placed = ranked.join(plan, "__key")
    at = F.col("__rn") - 1
    client = F.size(F.filter("__cuts", lambda c: c <= at))
    return placed.withColumn("client_id", client).drop("__rn", "__cuts", "__key")


def sample_per_client(df: DataFrame, client: str, row_id: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` seeded rows per client, without replacement."""
    return _ranked_by_hash(df, [client], row_id, seed).filter(F.col("__rn") <= cap).drop("__rn")


def head_tail_split(df: DataFrame, client: str, order: str, share: float = 0.8) -> DataFrame:
    """First share of each client's rows as train, the rest as val; train has at least one."""
    ranked = with_rank(df, [client], [order], order_blocks(df, order), "__rn")
    counted = _with_key_counts(ranked, client)
    head = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(share)))
    return counted.withColumn("split", F.when(F.col("__rn") <= head, "train").otherwise("val")).drop("__rn", "__n")


def sample_sorted(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` seeded rows, returned in row order (the sampling operator; its size is ``n``)."""
    return df.orderBy(seeded_digest(seed, row_id), row_id).limit(n).orderBy(row_id)


def partition_manifest(parts: DataFrame, label: str) -> DataFrame:
    """Rows per client and label."""
    return parts.groupBy("client_id", label).agg(F.count(F.lit(1)).alias("samples"))


def save_partitions(parts: DataFrame, path: str, label: str) -> None:
    parts.write.mode("overwrite").partitionBy("client_id").parquet(f"{path}/rows")
    partition_manifest(parts, label).write.mode("overwrite").json(f"{path}/manifest")
