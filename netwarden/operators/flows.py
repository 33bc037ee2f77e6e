"""Flow keys, inactivity sessions and sliding windows over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from netwarden.constants import FLOW_COLUMNS
from netwarden.functions.ordered import (
    BLOCK, Blocks, exact_quantiles, micros, order_blocks, with_block, with_lag, with_rank,
)

RUN_ROWS = 1_000_000


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def parse_timestamp(df: DataFrame, column: str, fmt: str | None = None, name: str = "event_time") -> DataFrame:
    """Text to timestamp; unparseable values become null."""
    text = quoted(column).cast("string")
    parsed = F.try_to_timestamp(text, F.lit(fmt)) if fmt else F.try_to_timestamp(text)
    return df.withColumn(name, parsed)


def resolve_flow_columns(columns: Sequence[str], configured: Sequence[str] | None = None) -> list[str]:
    if configured:
        missing = [c for c in configured if c not in columns]
        if missing:
            raise KeyError(f"flow columns not in the table: {missing}")
        return list(configured)
    found = [c for c in FLOW_COLUMNS if c in columns]
    if not found:
        raise ValueError("the table has none of the known flow columns")
    return found


def _text(name: str) -> Column:
    return F.coalesce(quoted(name).cast("string"), F.lit("<NA>"))


def add_flow_key(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Direction-free flow key: both endpoints sorted as text, then the other columns."""
    columns = resolve_flow_columns(df.columns, columns)
    hosts = ["ip.src_host", "ip.dst_host"]
    ports = ["tcp.srcport", "tcp.dstport"]
    if all(c in columns for c in hosts + ports):
        ends = [F.concat_ws(":", _text(h), _text(p)) for h, p in zip(hosts, ports)]
        used = hosts + ports
    elif all(c in columns for c in hosts):
        ends, used = [_text(h) for h in hosts], hosts
    else:
        ends, used = [], []
    parts = [_text(c) for c in columns if c not in used]
    if ends:
        df = df.withColumn("endpoint_a", F.least(*ends)).withColumn("endpoint_b", F.greatest(*ends))
        parts = [F.col("endpoint_a"), F.col("endpoint_b"), *parts]
    return df.withColumn("flow_key", F.concat_ws("|", *parts))


def sessionize(
    df: DataFrame,
    ts: str = "ts",
    row_id: str = "row_id",
    columns: Sequence[str] | None = None,
    inactivity_seconds: float | None = 30.0,
    blocks: Blocks | None = None,
) -> DataFrame:
    """Split each flow where the gap to its previous row is longer than the threshold."""
    df = add_flow_key(df.filter(F.col(ts).isNotNull()), columns)
    if inactivity_seconds is None:
        return df.withColumn("session_no", F.lit(1).cast("long")).withColumn("session_id", F.col("flow_key"))
    blocks = blocks or order_blocks(df, [ts, row_id])
    numbered = _number_sessions(df.withColumn("__t", micros(ts)), row_id, int(inactivity_seconds * 1_000_000), blocks)
    return numbered.withColumn(
        "session_id", F.concat(F.col("flow_key"), F.lit("|session="), F.col("session_no").cast("string"))
    ).drop("__t")


def _number_sessions(df: DataFrame, row_id: str, gap: int, blocks: Blocks) -> DataFrame:
    """``session_no`` per flow. Only the first row of a block needs to know the block before it."""
    placed = with_block(df, blocks)
    inside = Window.partitionBy("flow_key", BLOCK).orderBy("__t", row_id)
    previous = F.lag("__t").over(inside)
    opens = F.when(F.col("__t") - previous > gap, 1).otherwise(0).cast("long")
    flagged = placed.withColumn("__opens", opens)
    counted = flagged.withColumn("session_no", F.sum("__opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    if blocks.n == 1:
        return counted.withColumn("session_no", F.col("session_no") + 1).drop("__opens", BLOCK)
    summary = flagged.groupBy("flow_key", BLOCK).agg(
        F.min("__t").alias("__first"), F.max("__t").alias("__last"), F.sum("__opens").alias("__inner")
    )
    along = Window.partitionBy("flow_key").orderBy(BLOCK)
    before = F.lag("__last").over(along)
    starts = F.when(before.isNull() | (F.col("__first") - before > gap), 1).otherwise(0).cast("long")
    started = summary.withColumn("__starts", starts)
    earlier = F.sum(F.col("__inner") + F.col("__starts")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    carry = started.select("flow_key", BLOCK, (F.coalesce(earlier, F.lit(0)) + F.col("__starts")).alias("__offset"))
    return counted.join(carry, ["flow_key", BLOCK]).withColumn("session_no", F.col("session_no") + F.col("__offset")).drop(
        "__opens", "__offset", BLOCK
    )


def session_stats(sessions: DataFrame, ts: str = "ts") -> DataFrame:
    return sessions.groupBy("flow_key", "session_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        micros(F.min(ts)).alias("first_us"),
        micros(F.max(ts)).alias("last_us"),
        (micros(F.max(ts)) - micros(F.min(ts))).alias("duration_us"),
    )


def sliding_windows(
    df: DataFrame,
    key: str,
    length: int,
    stride: int = 1,
    ts: str = "ts",
    row_id: str = "row_id",
    label: str = "label",
    blocks: Blocks | None = None,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Every ``length``-row window inside one key, labelled by its last row.

    A key longer than ``run_rows`` is cut by position; the first rows of a run are also
    given to the run before it, so windows that cross the cut are complete.
    """
    if length < 1 or stride < 1:
        raise ValueError("length and stride must be positive")
    blocks = blocks or order_blocks(df, [ts, row_id])
    ranked = with_rank(df.select(key, ts, row_id, label), [key], [ts, row_id], blocks, "__rn")
    run = F.floor((F.col("__rn") - 1) / run_rows)
    shared = (run > 0) & ((F.col("__rn") - 1) % run_rows < length - 1)
    placed = ranked.withColumn("__run", run).withColumn(
        "__slot", F.explode(F.when(shared, F.array(run, run - 1)).otherwise(F.array(run)))
    )
    frame = Window.partitionBy(key, "__slot").orderBy("__rn").rowsBetween(0, length - 1)
    framed = placed.select(
        "*",
        F.collect_list(row_id).over(frame).alias("row_ids"),
        F.last(label).over(frame).alias("window_label"),
        F.last(ts).over(frame).alias("__end"),
    )
    kept = framed.filter(
        (F.col("__slot") == F.col("__run")) & (F.size("row_ids") == length) & ((F.col("__rn") - 1) % stride == 0)
    )
    return kept.select(
        key,
        F.col("__rn").alias("window_start"),
        F.col(ts).alias("start_time"),
        F.col("__end").alias("end_time"),
        F.col("window_label").alias("label"),
        F.lit(length).alias("length"),
        "row_ids",
    )


def require_windows(windows: DataFrame) -> DataFrame:
    if windows.isEmpty():
        raise ValueError("no window is long enough; lower the length or check the sessions")
    return windows


def windows_to_tensor(windows: DataFrame, encoded: DataFrame, row_id: str = "row_id", vector: str = "features") -> DataFrame:
    """Replace row ids by their encoded rows; every row is encoded once before the join."""
    placed = windows.select(
        F.element_at("row_ids", 1).alias("window_id"), "label", "length",
        F.posexplode("row_ids").alias("__at", row_id),
    )
    return (
        placed.join(encoded.select(row_id, vector), row_id)
        .groupBy("window_id", "label", "length")
        .agg(F.array_sort(F.collect_list(F.struct("__at", vector))).alias("__cells"))
        .withColumn(
            "tensor",
            F.when(F.size("__cells") == F.col("length"), F.transform("__cells", lambda c: c[vector])).otherwise(
                F.raise_error(F.lit("a window lost rows while gathering features"))
            ),
        )
        .select("window_id", "label", "tensor")
    )


def temporal_audit(df: DataFrame, ts: str = "ts", row_id: str = "row_id", columns: Sequence[str] | None = None) -> DataFrame:
    """One row: timestamp validity, input order, rows per flow, inter-arrival times."""
    total = df.count()
    valid = df.filter(F.col(ts).isNotNull()).withColumn("__t", micros(ts))
    flows = add_flow_key(valid, columns).groupBy("flow_key").agg(F.count(F.lit(1)).alias("n"))
    per_flow = flows.agg(
        F.count(F.lit(1)).alias("unique_flows"),
        F.count_if(F.col("n") > 1).alias("multi_row_flows"),
        F.max("n").alias("max_rows_per_flow"),
    )
    flow_quantiles = exact_quantiles(flows, [], "n", {"median_rows_per_flow": 0.5, "p95_rows_per_flow": 0.95}, rows=total)
    input_order = with_lag(valid, [], [row_id], order_blocks(valid, row_id, rows=total), {"__before": "__t"}).agg(
        F.count(F.lit(1)).alias("valid_rows"),
        (F.count_if(F.col("__t") < F.col("__before")) == 0).alias("input_order_ok"),
    )
    gaps = with_lag(valid, [], ["__t", row_id], order_blocks(valid, ["__t", row_id], rows=total), {"__before": "__t"}).select(
        ((F.col("__t") - F.col("__before")) / 1000.0).alias("gap_ms")
    )
    gap_quantiles = exact_quantiles(gaps, [], "gap_ms", {"median_gap_ms": 0.5, "p95_gap_ms": 0.95}, rows=total)
    report = input_order.withColumn("rows", F.lit(total))
    for part in (per_flow, flow_quantiles, gap_quantiles):
        report = one_row_beside(report, part)
    return report


def one_row_beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Place two one-row aggregates side by side."""
    return left.withColumn("__one", F.lit(1)).join(right.withColumn("__one", F.lit(1)), "__one").drop("__one")


def window_recommendation(audit: DataFrame) -> DataFrame:
    median = F.col("median_rows_per_flow")
    return audit.select(
        F.when(median >= 8, "8,16,32").when(median >= 4, "4,8,16").otherwise("1").alias("candidate_lengths"),
        F.when(F.col("multi_row_flows") == 0, "no flow has more than one row; keep single-row windows")
        .when(~F.col("input_order_ok"), "input is not in time order; build windows inside flows")
        .otherwise("flows have several rows in time order; flow windows are sound")
        .alias("warning"),
    )
