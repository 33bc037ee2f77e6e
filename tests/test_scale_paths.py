"""The many-block paths must give what the one-block plan gives, with a hot key holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from conftest import rows
from netwarden.functions import folds, ordered
from netwarden.operators import analytics, audit, flows, split, trust, updates


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(5)
    n = 3000
    hot = rng.random(n) < 0.35
    pdf = pd.DataFrame({
        "k": np.where(hot, "hot", np.char.add("k", rng.integers(0, 60, n).astype(str))),
        "t": rng.integers(0, 2000, n),  # many ties
        "id": np.arange(n),
        "v": rng.random(n),
        "n": rng.integers(0, 5, n),
    })
    return spark.createDataFrame(pdf).repartition(7, "id").cache()


@pytest.fixture(scope="module")
def blocks(skewed):
    cut = ordered.order_blocks(skewed, "t", target_rows=90)
    assert cut.n > 20
    return cut


def test_blocks_follow_the_order(skewed, blocks):
    per = skewed.withColumn("b", blocks.column).groupBy("b").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n")).orderBy("b").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(per, per[1:]))
    assert max(r["n"] for r in per) < 400


@pytest.mark.parametrize("keys", [["k"], []])
def test_rank_lag_and_sum(skewed, blocks, keys):
    w = Window.partitionBy(*keys).orderBy("t", "id")
    want = skewed.select("id", F.row_number().over(w).alias("rn"), F.lag("v").over(w).alias("p"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    got = ordered.with_rank(skewed, keys, ["t", "id"], blocks)
    got = ordered.with_lag(got, keys, ["t", "id"], blocks, {"p": "v"})
    got = ordered.with_running_sum(got, keys, ["t", "id"], blocks, {"s": F.col("n")})
    assert rows(got.select("id", "rn", "p", "s")) == rows(want)


def test_hash_blocks_rank(skewed):
    df = skewed.withColumn("d", F.md5(F.col("id").cast("string")))
    cut = ordered.hash_blocks(df, "d", target_rows=100)
    assert cut.n == 30
    w = Window.partitionBy("k").orderBy("d", "id")
    want = df.select("id", F.row_number().over(w).alias("rn"))
    assert rows(ordered.with_rank(df, ["k"], ["d", "id"], cut).select("id", "rn")) == rows(want)


@pytest.mark.parametrize("alpha", [0.3, 0.9])
def test_ema_matches_the_recurrence(skewed, blocks, alpha):
    got = {r["id"]: r["e"] for r in ordered.with_ema(skewed, ["k"], ["t", "id"], blocks, "v", alpha, 1.0, "e").collect()}
    for _, group in skewed.toPandas().sort_values(["t", "id"]).groupby("k"):
        e = 1.0
        for i, v in zip(group["id"], group["v"]):
            e = alpha * v + (1 - alpha) * e
            assert got[i] == pytest.approx(e, abs=1e-12)


@pytest.mark.parametrize("target", [90, 10**6])
def test_trailing_sums(skewed, target):
    df = skewed.withColumn("ts", F.timestamp_seconds("t"))
    cut = ordered.order_blocks(df, "ts", target_rows=target)
    assert (cut.n > 20) == (target == 90)
    out = ordered.with_trailing_sums(df, ["k"], "ts", "id", 50, {"s": F.col("n")}, blocks=ordered.Blocks(
        F.floor(F.col("__t") / 60_000_000).cast("int"), 40, 3000) if target == 90 else cut)
    assert set(out.columns) == {*df.columns, "s"}
    got = {r["id"]: r["s"] for r in out.collect()}
    pdf = skewed.toPandas().sort_values(["t", "id"]).reset_index(drop=True)
    for _, g in pdf.groupby("k"):
        g = g.reset_index(drop=True)
        for i in range(len(g)):
            earlier = g.iloc[:i]
            assert got[g["id"][i]] == earlier.loc[earlier["t"] >= g["t"][i] - 50, "n"].sum()


def test_exact_quantiles_on_large_tables(skewed):
    p = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.95, "e": 1.0}
    for keys in (["k"], []):
        small = rows(ordered.exact_quantiles(skewed, keys, "v", p))
        large = rows(ordered.exact_quantiles(skewed, keys, "v", p, target_rows=200))
        assert len(small) == len(large)
        for x, y in zip(small, large):
            assert x[: len(keys)] == y[: len(keys)]
            assert x == y


def test_sessions_and_windows(spark, skewed):
    df = skewed.select(F.col("id").alias("row_id"), F.timestamp_seconds("t").alias("ts"), F.col("k").alias("ip.src_host"), F.lit("x").alias("ip.dst_host"), F.col("n").cast("string").alias("label"))
    cut = ordered.order_blocks(df, "ts", target_rows=90)
    plain = flows.sessionize(df, inactivity_seconds=9)
    cutup = flows.sessionize(df, inactivity_seconds=9, blocks=cut)
    assert rows(plain.select("row_id", "session_id")) == rows(cutup.select("row_id", "session_id"))
    for stride in (1, 3):
        want = rows(flows.sliding_windows(plain, "flow_key", 4, stride))
        got = rows(flows.sliding_windows(plain, "flow_key", 4, stride, blocks=cut, run_rows=50))
        assert got == want and want


def test_page_hinkley_over_several_rounds(skewed, blocks):
    one = rows(analytics.drift_points(skewed, ["k"], "id", "v", limit=0.5))
    many = rows(analytics.drift_points(skewed, ["k"], "id", "v", limit=0.5, blocks=ordered.order_blocks(skewed, "id", 90), run_rows=100))
    assert one == many and one


@pytest.mark.parametrize("seconds", [0, 3, 40, 5000])
def test_nonce_replay_by_pointers(skewed, seconds):
    """A hot nonce with a use every second: its chain is followed by doubling, in one block or many, as the fold would."""
    df = skewed.select(F.col("k").alias("agent_id"), F.lit("n").alias("nonce"), F.col("id").alias("event_id"), F.timestamp_seconds("t").alias("ts"))
    want = {}
    for _, group in df.toPandas().sort_values(["ts", "event_id"]).groupby("agent_id"):
        used = None
        for at, i in zip(group["ts"], group["event_id"]):
            want[i] = used is not None and (at - used).total_seconds() <= seconds
            used = used if want[i] else at
    for target in (None, 90):
        assert {r["event_id"]: r["replay"] for r in trust.nonce_replay(df, window_seconds=seconds, target_rows=target).collect()} == want


def test_chain_over_several_rounds(skewed):
    df = skewed.withColumn("canonical", audit.canonical(F.col("id"), F.col("v")))
    one = rows(audit.build_chain(df, "k", ["id"]).select("id", "entry_hash"))
    many = rows(audit.build_chain(df, "k", ["id"], blocks=ordered.order_blocks(df, "id", 90), run_rows=100).select("id", "entry_hash"))
    assert one == many


def test_lag_based_jump_check(skewed, blocks):
    df = skewed.withColumnRenamed("v", "trust_value")
    one = rows(audit.implausible_jumps(df, "k", "id", limit=0.8).select("id", "previous_value"))
    many = rows(audit.implausible_jumps(df, "k", "id", limit=0.8, blocks=ordered.order_blocks(df, "id", 90)).select("id", "previous_value"))
    assert one == many and one


def test_silhouette_tiles(spark):
    rng = np.random.default_rng(2)
    data = [(1, f"c{i}", [float(x) for x in rng.normal(i % 2 * 3, 1, 4)], i % 2) for i in range(60)] + [(2, f"c{i}", [float(x) for x in rng.normal(0, 1, 4)], 0) for i in range(5)]
    df = spark.createDataFrame(data, "round long, client_id string, point array<double>, label int")
    whole = {r[0]: r[1] for r in updates.silhouette(df).collect()}
    tiled = {r[0]: r[1] for r in updates.silhouette(df, tile_rows=13).collect()}
    assert whole[1] == pytest.approx(tiled[1], abs=1e-12) and whole[1] > 0.5
    assert whole[2] is None and tiled[2] is None


def test_iid_partition_sizes(skewed):
    parts = split.iid_partition(skewed.select("id"), "id", 7).groupBy("client_id").count().collect()
    sizes = sorted(r["count"] for r in parts)
    assert len(sizes) == 7 and sum(sizes) == 3000 and sizes[-1] - sizes[0] <= 1


@pytest.mark.parametrize("same", ["all", "half"])
def test_rows_of_one_time_are_divided(skewed, monkeypatch, same):
    """One timestamp for all rows, or for half of them: the tie-breaker cuts on, and nothing changes."""
    t = F.lit(7) if same == "all" else F.when(F.col("id") % 2 == 0, 700).otherwise(F.col("t"))
    df = skewed.withColumn("t", t.cast("long"))
    cut = ordered.order_blocks(df, ["t", "id"], target_rows=90)
    assert cut.n > 20
    per = df.withColumn("b", cut.column).groupBy("b").agg(F.min(F.struct("t", "id")).alias("lo"), F.max(F.struct("t", "id")).alias("hi"), F.count("*").alias("n")).orderBy("b").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(per, per[1:])) and max(r["n"] for r in per) < 400
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("id", F.row_number().over(w).alias("rn"), F.lag("v").over(w).alias("p"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    got = ordered.with_rank(df, ["k"], ["t", "id"], cut)
    got = ordered.with_lag(got, ["k"], ["t", "id"], cut, {"p": "v"})
    got = ordered.with_running_sum(got, ["k"], ["t", "id"], cut, {"s": F.col("n")})
    assert rows(got.select("id", "rn", "p", "s")) == rows(want)
    timed = df.withColumn("ts", F.timestamp_seconds("t"))
    plain = [rows(f(timed)) for f in SCANS]
    monkeypatch.setattr(ordered, "TARGET_ROWS", 90)
    assert [rows(f(timed)) for f in SCANS] == plain


SCANS = [
    lambda df: ordered.with_trailing_sums(df, ["k"], "ts", "id", 50, {"s": F.col("n")}).select("id", "s"),
    lambda df: flows.sessionize(df.select("id", "ts", F.col("k").alias("ip.src_host"), F.lit("x").alias("ip.dst_host")), row_id="id", inactivity_seconds=3).select("id", "session_id"),
    lambda df: trust.nonce_replay(df.select(F.col("k").alias("agent_id"), F.lit("n").alias("nonce"), F.col("id").alias("event_id"), "ts"), window_seconds=40).select("event_id", "replay"),
]


def test_a_fold_gets_its_rows_in_batches(spark, skewed):
    """The fold sees an Arrow batch of a key at a time, in one round or many, and its state goes on from batch to batch; a null key is a key."""
    def fold(part: pd.DataFrame, state: dict | None):
        assert len(part) <= 50
        upto = part["id"].cumsum() + (state["total"] if state else 0)
        return part[["id"]].assign(total=upto), {"total": int(upto.iloc[-1])}

    df = skewed.select(F.when(F.col("k") != "hot", F.col("k")).alias("k"), F.col("id").cast("long").alias("id"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        cut = ordered.order_blocks(df, "id", 90)
        got = [rows(folds.run_fold(df, ["k"], ["id"], cut, fold, "id long, total long", "total long", n)) for n in (10**6, 120)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = rows(df.select("k", "id", F.sum("id").over(Window.partitionBy("k").orderBy("id")).alias("total")))
    assert got == [want, want] and want
