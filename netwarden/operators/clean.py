"""Column cleaning, pruning, row subsets and capture replay offsets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from netwarden.functions.ordered import Blocks, order_blocks, with_lag, with_running_sum
from netwarden.operators.flows import quoted

# External connection-log columns and what they are called here.
EXTERNAL_NAMES = {
    "id.orig_h": "ip.src_host", "id.resp_h": "ip.dst_host", "id.orig_p": "tcp.srcport", "id.resp_p": "tcp.dstport",
    "duration": "flow.duration", "orig_bytes": "orig_bytes", "resp_bytes": "resp_bytes", "orig_pkts": "orig_pkts",
    "resp_pkts": "resp_pkts", "orig_ip_bytes": "orig_ip_bytes", "resp_ip_bytes": "resp_ip_bytes", "service": "service",
    "proto": "proto", "conn_state": "conn_state", "history": "history",
}
PROTOCOL_NUMBERS = {"tcp": 6, "udp": 17, "icmp": 1, "icmp6": 58}


def coerce_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Make a text column numeric when all of its non-null values parse; one pass over the table."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)]
    if not text:
        return df
    parsed = lambda c: F.trim(quoted(c)).try_cast("double")
    counts = df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(text)], *[F.count(parsed(c)).alias(f"p{i}") for i, c in enumerate(text)]).first()
    numeric = {c for i, c in enumerate(text) if counts[f"n{i}"] and counts[f"n{i}"] == counts[f"p{i}"]}
    return df.select(*[parsed(c).alias(c) if c in numeric else quoted(c) for c in df.columns])


def finite_or_null(column: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)


def drop_infinities(df: DataFrame) -> DataFrame:
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[
        finite_or_null(quoted(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else quoted(f.name) for f in df.schema
    ])


def prune(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"input columns missing: {missing}")
    return df.select(*[quoted(c) for c in columns])


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The record cap of a run: the first ``n`` rows."""
    return df.orderBy(order).limit(n)


def keep_rows(df: DataFrame, wanted: DataFrame, row_id: str) -> DataFrame:
    return df.join(wanted.select(row_id), row_id, "left_semi")


def compose_steps(steps: Sequence[tuple[str, DataFrame, str, int | None]]) -> DataFrame:
    """Concatenate named steps (name, rows, order, cap) in order, numbering steps and rows."""
    from netwarden.functions.ordered import with_rank

    out = None
    for number, (name, rows, order, cap) in enumerate(steps, start=1):
        ranked = with_rank(rows, [], [order], order_blocks(rows, order), "row_no")
        if cap is not None:
            ranked = ranked.filter(F.col("row_no") <= cap)
        ranked = ranked.withColumn("step_no", F.lit(number)).withColumn("step", F.lit(name))
        out = ranked if out is None else out.unionByName(ranked)
    return out


def pair_with_packets(records: DataFrame, packets: DataFrame, speed: float = 1.0, blocks: Blocks | None = None) -> DataFrame:
    """Pair records and packets by position in each capture and compute when each is due.

    ``records``: capture, row_no, ...; ``packets``: capture, row_no, ts_us. The longer side is
    cut; a backward timestamp waits zero.
    """
    paired = records.join(packets, ["capture", "row_no"])
    blocks = blocks or order_blocks(paired, "row_no")
    lagged = with_lag(paired, ["capture"], ["row_no"], blocks, {"__before": "ts_us"})
    waited = lagged.withColumn(
        "wait_us", F.coalesce(F.greatest(F.lit(0), F.col("ts_us") - F.col("__before")), F.lit(0)).cast("long")
    ).drop("__before")
    summed = with_running_sum(waited, ["capture"], ["row_no"], blocks, {"__due": F.col("wait_us")})
    return summed.withColumn("due_seconds", F.col("__due") / 1e6 / speed).drop("__due")


def map_external(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rename an external connection log to the given input columns; absent ones are null."""
    sources = {target: source for source, target in EXTERNAL_NAMES.items() if source in df.columns}
    numbers = F.create_map(*[F.lit(x) for pair in PROTOCOL_NUMBERS.items() for x in pair])

    def pick(name: str) -> Column:
        if name == "frame.time" and "ts" in df.columns:
            return F.timestamp_micros((F.col("ts").try_cast("double") * 1_000_000).cast("long"))
        if name == "ip.proto" and "proto" in df.columns:
            return F.try_element_at(numbers, F.lower("proto"))
        return quoted(sources[name]) if name in sources else F.lit(None)

    return df.select(*[pick(c).alias(c) for c in columns])


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, so rows fit a flat file."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        F.to_json(quoted(f.name)).alias(f.name) if isinstance(f.dataType, nested) else quoted(f.name) for f in df.schema
    ])
