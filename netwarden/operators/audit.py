"""Hash-chained logs, event history and plausibility checks."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from netwarden.constants import HASH_GENESIS
from netwarden.functions.folds import RUN_ROWS, run_fold
from netwarden.functions.ordered import Blocks, order_blocks, with_lag, with_rank, with_trailing_sums


class TamperedLog(ValueError):
    """Raised when appending to a log whose chain does not verify."""


def canonical(*columns: Column) -> Column:
    """One unambiguous text per entry: length-prefixed fields, nulls marked."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws("|", *parts)


def build_chain(
    df: DataFrame,
    chain: str,
    order: Sequence[str],
    text: str = "canonical",
    heads: DataFrame | None = None,
    blocks: Blocks | None = None,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Add ``position``, ``previous_hash`` and ``entry_hash`` per chain.

    ``heads`` (chain, position, entry_hash) continues existing chains; a chain without a
    head starts at the genesis hash.
    """
    blocks = blocks or order_blocks(df, order)
    rows = with_rank(df.select(chain, *order, text), [chain], list(order), blocks, "position")
    if heads is not None:
        tips = heads.select(chain, F.col("position").alias("__from"), F.col("entry_hash").alias("__tip"))
        rows = rows.join(tips, chain, "left").withColumn("position", F.col("position") + F.coalesce("__from", F.lit(0)))
    else:
        rows = rows.withColumn("__tip", F.lit(None).cast("string"))

    def fold(entries: pd.DataFrame, state: dict | None):
        tip = entries["__tip"].iloc[0]
        previous = state["hash"] if state else (tip if isinstance(tip, str) else HASH_GENESIS)
        before, after = [], []
        for entry in entries[text]:
            before.append(previous)
            previous = hashlib.sha256((previous + entry).encode("utf-8")).hexdigest()
            after.append(previous)
        # The order columns go along, so nothing has to be joined back.
        return entries[[*order, "position", text]].assign(previous_hash=before, entry_hash=after), {"hash": previous}

    order = list(order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*order).schema)

    return run_fold(
        rows.select(chain, *order, "position", text, "__tip"), [chain], ["position"],
        Blocks(blocks.column, blocks.n, blocks.rows) if blocks.n == 1 else order_blocks(rows, "position", rows=blocks.rows),
        fold, f"{kinds}, position long, {text} string, previous_hash string, entry_hash string", "hash string", run_rows,
    )


def verify_chain(entries: DataFrame, chain: str, text: Column | str = "canonical") -> DataFrame:
    """Per chain: is it intact, and the first broken position.

    Every entry is checked against its stored predecessor, found by an equi-join on
    (chain, position), so a very long chain is checked by all tasks.
    """
    recomputed = entries.withColumn("__text", F.col(text) if isinstance(text, str) else text)
    previous = entries.select(chain, (F.col("position") + 1).alias("position"), F.col("entry_hash").alias("__before"))
    joined = recomputed.join(previous, [chain, "position"], "left").withColumn(
        "__before", F.when(F.col("position") == 1, F.lit(HASH_GENESIS)).otherwise(F.col("__before"))
    )
    expected = F.sha2(F.concat(F.col("__before"), F.col("__text")), 256)
    intact = F.coalesce(
        (expected == F.col("entry_hash")) & (F.col("previous_hash") == F.col("__before")), F.lit(False)
    )
    return joined.groupBy(chain).agg(
        F.count(F.lit(1)).alias("entries"),
        (F.count_if(~intact) == 0).alias("ok"),
        F.min(F.when(~intact, F.col("position"))).alias("first_broken"),
    )


def append_checked(existing: DataFrame, new: DataFrame, chain: str, order: Sequence[str], text: str = "canonical") -> DataFrame:
    """Chain new entries after existing ones; refuse when the stored chain is broken."""
    if not verify_chain(existing, chain, text).filter("NOT ok").isEmpty():
        raise TamperedLog("the stored chain does not verify; refusing to append")
    heads = existing.groupBy(chain).agg(
        F.max("position").alias("position"), F.max_by("entry_hash", "position").alias("entry_hash")
    )
    return build_chain(new, chain, order, text, heads=heads)


def labels_for(labels: DataFrame, sequence: int) -> DataFrame:
    return labels.filter(F.col("audit_sequence") == sequence)


def recent_events(
    history: DataFrame, as_of: Column, seconds: float, kind: str | None = None, entity: str | None = None
) -> DataFrame:
    """Events no older than ``seconds`` at ``as_of``."""
    out = history.filter(F.col("ts") >= as_of - F.make_dt_interval(secs=F.lit(float(seconds))))
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if entity is not None:
        out = out.filter(F.col("entity_id") == entity)
    return out


def events_of_kind(history: DataFrame, kind: str) -> DataFrame:
    return history.filter(F.col("kind") == kind)


def count_recent(history: DataFrame, seconds: float, tie: str) -> DataFrame:
    """For each event, how many earlier events of the entity lie in the window."""
    return with_trailing_sums(history, ["entity_id"], "ts", tie, seconds, {"recent": F.lit(1).cast("long")})


def implausible_jumps(
    decisions: DataFrame, entity: str, order: str, value: str = "trust_value", limit: float = 0.9, blocks: Blocks | None = None
) -> DataFrame:
    """Consecutive scored decisions of one entity whose trust differs by more than ``limit``."""
    scored = decisions.filter(F.col(value).isNotNull() & F.col(entity).isNotNull())
    lagged = with_lag(scored, [entity], [order], blocks or order_blocks(scored, order), {"previous_value": value})
    return lagged.filter(F.abs(F.col(value) - F.col("previous_value")) > limit)
