"""Ordered scans (rank, lag, running sum, EMA, trailing sums) that survive hot keys.

A plain window sends all rows of one key to one task. Here the order axis is first cut
into value blocks of roughly equal size, the window runs per (key, block), and a small
per-block summary carries the result across block borders. A key that holds a third of
the table is then spread over as many tasks as it has blocks. ``target_rows`` tunes the size of a block; results are
bit-equal at any setting, as sums are taken over integers and decimals only.

Keys must be non-null; callers fill or filter them first.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

TARGET_ROWS = 4_000_000
BLOCK = "__block"
MICROS = 1_000_000


@dataclass(frozen=True)
class Blocks:
    """A deterministic block number per row, monotone in the order columns."""

    column: Column
    n: int
    rows: int


def micros(column: str | Column) -> Column:
    """Epoch microseconds of a timestamp with or without zone."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def as_number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name.strip("`")].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(name)
    return F.col(name)


#: A cut: a value of each order column; ``None`` from some column on is the first row with the values before it.
Cut = tuple


def _lookup(values: Sequence[Column], cuts: Sequence[Cut]) -> Column:
    """Number of sorted cuts <= the values, compared column by column, by binary search over constant arrays."""
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    # A column that no cut compares needs no array.
    used = [k for k in range(len(values)) if any(c[k] is not None for c in cuts)]
    known = {k: F.array(*[F.lit(c[k]) for c in cuts]) for k in used}

    def behind(i: Column, k: int = 0) -> Column:
        if k not in known:
            return F.lit(True)
        cut = F.get(known[k], i)
        return cut.isNull() | (cut < values[k]) | ((cut == values[k]) & behind(i, k + 1))

    def narrowed(at: Column, step: Column) -> Column:
        inside = at + step <= len(cuts)
        return at + F.when(inside & F.coalesce(behind(at + step - 1), F.lit(False)), step).otherwise(0)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), narrowed)


def _cuts(df: DataFrame, order: Sequence[str], n: int) -> list[Cut]:
    """Cuts of the rows into about ``n`` equal parts. A value at which several cuts fall is cut on by the next column, among its own rows."""
    value = as_number(df, order[0])
    found = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    times = Counter(found)
    out = [(v, *[None] * (len(order) - 1)) for v in times]
    heavy = {v: m for v, m in times.items() if m > 1}
    if heavy and len(order) > 1 and isinstance(df.schema[order[1].strip("`")].dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType)):
        for v, m in heavy.items():  # half as many as there are parts, at most
            out += [(v, *c) for c in _cuts(df.filter(value == F.lit(v)), order[1:], m + 1)]
    return sorted(out, key=lambda c: [(x is not None, x or 0) for x in c])


def order_blocks(df: DataFrame, order: str | Sequence[str], target_rows: int | None = None, rows: int | None = None) -> Blocks:
    """Measure the table and cut the order columns at approximate quantiles.

    Rows of one value in the first column are cut by the next ones, if those are numbers or times; a single column leaves them together. Only
    the cut points (one for ``target_rows`` rows) reach the driver. They enter the plan as literals, so every branch and every retry sees the same blocks; being approximate
    affects balance only, never results. Pass ``rows`` when the size is already known.
    """
    order = [order] if isinstance(order, str) else list(order)
    target_rows = target_rows or TARGET_ROWS
    rows = df.count() if rows is None else rows
    if rows <= target_rows:
        return Blocks(F.lit(0), 1, rows)
    cuts = _cuts(df, order, math.ceil(rows / target_rows))
    if not cuts:
        return Blocks(F.lit(0), 1, rows)
    return Blocks(F.coalesce(_lookup([as_number(df, c) for c in order], cuts), F.lit(0)), len(cuts) + 1, rows)


def hash_blocks(df: DataFrame, digest: str, target_rows: int = TARGET_ROWS, rows: int | None = None) -> Blocks:
    """Blocks over a hex digest column: its prefix is uniform, so no quantile pass is needed."""
    rows = df.count() if rows is None else rows
    n = max(1, math.ceil(rows / target_rows))
    if n == 1:
        return Blocks(F.lit(0), 1, rows)
    prefix = F.conv(F.substring(F.col(digest), 1, 8), 16, 10).cast("long")
    return Blocks(F.floor(prefix * n / (1 << 32)).cast("int"), n, rows)


def with_block(df: DataFrame, blocks: Blocks) -> DataFrame:
    if blocks.n == 1:
        return df.withColumn(BLOCK, F.lit(0))
    # A generator output carries no "column = expression" constraint. With a plain column the
    # optimizer copies that expression (it holds a lambda) to the carry side of the join,
    # where its input does not exist.
    return df.select("*", F.explode(F.array(blocks.column)).alias(BLOCK))


def _spec(keys: Sequence[str], order: Sequence, blocks: Blocks):
    return Window.partitionBy(*[F.col(k) for k in keys], F.col(BLOCK)).orderBy(*order)


def _attach(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    names = [k.strip("`") for k in keys] + [BLOCK]
    return df.join(carry, on=names, how="left")


def with_rank(df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: Blocks, name: str = "rn") -> DataFrame:
    """Exact 1-based row number per key."""
    df = with_block(df, blocks)
    ranked = df.withColumn(name, F.row_number().over(_spec(keys, order, blocks)).cast("long"))
    if blocks.n > 1:
        counts = df.groupBy(*keys, BLOCK).agg(F.count(F.lit(1)).alias("__n"))
        before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carry = counts.withColumn("__offset", F.sum("__n").over(before)).drop("__n")
        ranked = _attach(ranked, carry, keys).withColumn(name, F.col(name) + F.coalesce("__offset", F.lit(0))).drop("__offset")
    return ranked.drop(BLOCK)


def with_lag(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: Blocks, fields: Mapping[str, str]
) -> DataFrame:
    """Previous row's values per key; ``fields`` maps new column -> source column."""
    df = with_block(df, blocks)
    spec = _spec(keys, order, blocks)
    out = df.select("*", *[F.lag(src).over(spec).alias(new) for new, src in fields.items()])
    if blocks.n > 1:
        first = F.row_number().over(spec) == 1
        values = F.struct(*[F.col(src).alias(new) for new, src in fields.items()])
        if list(fields.values()) == [order[0]]:
            # The last value of the leading order column is its maximum: a plain hash aggregate.
            last = F.struct(F.max(order[0]).alias(next(iter(fields)))).alias("__last")
        else:
            last = F.max_by(values, F.struct(*order)).alias("__last")
        carry = (
            df.groupBy(*keys, BLOCK).agg(last)
            .withColumn("__carry", F.lag("__last").over(Window.partitionBy(*keys).orderBy(BLOCK)))
            .drop("__last")
        )
        out = _attach(out.withColumn("__first", first), carry, keys)
        for new in fields:
            out = out.withColumn(new, F.when(F.col("__first"), F.col("__carry")[new]).otherwise(F.col(new)))
        out = out.drop("__first", "__carry")
    return out.drop(BLOCK)


def with_running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: Blocks, values: Mapping[str, Column]
) -> DataFrame:
    """Inclusive running sums per key in row order, over integers or decimals: those add up alike in any order."""
    for field in df.select(*[v.alias(new) for new, v in values.items()]).schema:
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            raise TypeError(f"the sum {field.name} is over floating-point values; cast them to decimal")
    df = with_block(df, blocks)
    spec = _spec(keys, order, blocks).rowsBetween(Window.unboundedPreceding, 0)
    out = df.select("*", *[F.sum(v).over(spec).alias(new) for new, v in values.items()])
    if blocks.n > 1:
        before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        sums = df.groupBy(*keys, BLOCK).agg(*[F.sum(v).alias(f"__s_{new}") for new, v in values.items()])
        carry = sums.select(
            *keys, BLOCK, *[F.sum(f"__s_{new}").over(before).alias(f"__c_{new}") for new in values]
        )
        out = _attach(out, carry, keys)
        for new in values:
            out = out.withColumn(new, F.col(new) + F.coalesce(F.col(f"__c_{new}"), F.lit(0))).drop(f"__c_{new}")
    return out.drop(BLOCK)


def with_ema(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    blocks: Blocks,
    value: str,
    alpha: float,
    start: float = 1.0,
    name: str = "ema",
) -> DataFrame:
    """Exponential moving average ``e = a*x + (1-a)*e_prev`` per key, as window sums.

    Rows are grouped by position into runs short enough that (1-a)**-run stays in range, so
    the recurrence becomes a scaled running sum inside each run. The weight a run passes
    on is (1-a)**run ~ 1e-100, so each run needs only the last value of the run before it.
    """
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must be in (0, 1)")
    keep = 1.0 - alpha
    run = max(2, int(100.0 / -math.log10(keep)))
    ranked = with_rank(df, keys, order, blocks, "__rn")
    ranked = ranked.withColumn("__run", F.floor((F.col("__rn") - 1) / run)).withColumn(
        "__k", ((F.col("__rn") - 1) % run + 1).cast("double")
    )
    spec = Window.partitionBy(*keys, "__run").orderBy("__rn").rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.sum(F.col(value) * F.pow(F.lit(keep), -F.col("__k"))).over(spec)
    local = ranked.withColumn("__decay", F.pow(F.lit(keep), F.col("__k"))).withColumn(
        "__local", F.lit(alpha) * F.col("__decay") * scaled
    )
    carry = local.filter(F.col("__k") == run).select(
        *keys, (F.col("__run") + 1).alias("__run"), F.col("__local").alias("__carry")
    )
    joined = local.join(carry, on=[*[k.strip("`") for k in keys], "__run"], how="left")
    previous = F.when(F.col("__run") == 0, F.lit(float(start))).otherwise(F.col("__carry"))
    return joined.withColumn(name, F.col("__local") + F.col("__decay") * previous).drop(
        "__rn", "__run", "__k", "__decay", "__local", "__carry"
    )


def with_trailing_sums(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    seconds: float,
    values: Mapping[str, Column],
    blocks: Blocks | None = None,
) -> DataFrame:
    """Sums over strictly earlier rows of the key no older than ``seconds`` (inclusive).

    Every row also leaves the window once, just after ``seconds``; with those leaving rows
    counted negatively, the trailing sum is an ordinary running sum, which blocks keep safe
    for hot keys and bursts. Leaving rows carry only keys and values through the shuffle.
    Use integer values so the differences are exact.
    """
    width = int(round(seconds * MICROS))
    names = list(values)
    timed = df.withColumn("__t", micros(ts)).select("*", *[F.coalesce(v, F.lit(0)).alias(f"__v_{n}") for n, v in values.items()])
    moments = F.array(
        F.struct(F.col("__t").alias("__at"), F.lit(1).alias("__in")),
        F.struct((F.col("__t") + width + 1).alias("__at"), F.lit(0).alias("__in")),
    )
    kept = {k.strip("`") for k in keys} | {tie} | {f"__v_{n}" for n in names}
    slim = [
        F.col(f"`{c}`") if c in kept else F.when(F.col("__in") == 1, F.col(f"`{c}`")).alias(c) for c in df.columns
    ]
    doubled = timed.select("*", F.inline(moments)).select(
        *slim, F.col("__at").alias("__t"), "__in", *[F.col(f"__v_{n}") for n in names]
    )
    blocks = blocks or order_blocks(doubled, ["__t", "__in", tie])
    signed = {n: F.when(F.col("__in") == 1, F.col(f"__v_{n}")).otherwise(-F.col(f"__v_{n}")) for n in names}
    summed = with_running_sum(doubled, keys, ["__t", "__in", tie], blocks, signed)
    arrived = summed.filter(F.col("__in") == 1)
    return arrived.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], *[(F.col(n) - F.col(f"__v_{n}")).alias(n) for n in names])


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    target_rows: int = TARGET_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per key, one row per key, as the built-in ``percentile`` gives them.

    That keeps every distinct value of a key in one buffer; here equal values are counted first and the quantiles are
    read off block-wise cumulative counts.
    """
    present = df.filter(F.col(value).isNotNull())
    counted = present.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    blocks = order_blocks(counted, value, target_rows, rows)
    cumulative = with_running_sum(counted, keys, [value], blocks, {"__upto": F.col("__n")})
    totals = counted.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    # One row per key; small next to the table, and Spark broadcasts it only below its size limit.
    one = F.lit(1).alias("__one")
    placed = cumulative.join(totals, on=list(keys)) if keys else cumulative.select("*", one).join(totals.select("*", one), "__one")
    picks = []
    for i, p in enumerate(probabilities.values()):
        at = F.lit(float(p)) * (F.col("__total") - 1)
        picks += [
            F.min(F.when(F.col("__upto") > F.floor(at), F.col(value))).alias(f"__lo{i}"),
            F.min(F.when(F.col("__upto") > F.ceil(at), F.col(value))).alias(f"__hi{i}"),
            F.first(at - F.floor(at)).alias(f"__up{i}"),
            F.first(F.ceil(at) - at).alias(f"__down{i}"),
        ]
    picked = placed.groupBy(*keys).agg(*picks) if keys else placed.agg(*picks)
    low, high = (lambda i: F.col(f"__lo{i}").cast("double")), (lambda i: F.col(f"__hi{i}").cast("double"))
    between = lambda i: F.when(low(i) == high(i), low(i)).otherwise(F.col(f"__down{i}") * low(i) + F.col(f"__up{i}") * high(i))
    return picked.select(*keys, *[between(i).alias(name) for i, name in enumerate(probabilities)])
