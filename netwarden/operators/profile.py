"""Column roles, leakage-aware projection and table profiles."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from netwarden.constants import ATTACK_TYPE_NAMES, GROUP_NAMES, LABEL_NAMES, LEAKAGE_NAMES, TIME_NAMES
from netwarden.operators.flows import quoted


def find_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    """Exact match in candidate order first, then the first column containing a candidate."""
    clean = {c.lower().strip(): c for c in columns}
    exact = next((clean[x] for x in candidates if x in clean), None)
    return exact or next((c for c in columns if any(x in c.lower().strip() for x in candidates)), None)


def resolve_column(columns: Sequence[str], configured: str | None, candidates: Sequence[str]) -> str:
    if configured and configured != "auto":
        if configured not in columns:
            raise KeyError(f"configured column {configured!r} is not in the table")
        return configured
    found = find_column(columns, candidates)
    if found is None:
        raise KeyError(f"no column matches any of {list(candidates)}")
    return found


def column_roles(columns: Sequence[str]) -> dict[str, str | None]:
    names = {"label": LABEL_NAMES, "attack_type": ATTACK_TYPE_NAMES, "timestamp": TIME_NAMES, "group": GROUP_NAMES}
    return {role: find_column(columns, candidates) for role, candidates in names.items()}


def target_column(df: DataFrame, label: str | None = None) -> str:
    """The attack type when it has more than two distinct values, else the label."""
    label = resolve_column(df.columns, label, LABEL_NAMES)
    attack = find_column(df.columns, ATTACK_TYPE_NAMES)
    if attack is None:
        return label
    # Three values decide the question, so at most three rows reach the driver.
    few = df.select(quoted(attack)).filter(quoted(attack).isNotNull()).distinct().limit(3).count()
    return attack if few > 2 else label


def identifier_columns(columns: Sequence[str], patterns: Sequence[str]) -> list[str]:
    return [c for c in columns if any(re.search(p, c, re.IGNORECASE) for p in patterns)]


def feature_columns(
    columns: Sequence[str], label: str, attack: str | None, target: str, drop: Sequence[str] = (), patterns: Sequence[str] = ()
) -> list[str]:
    """Columns left after removing targets, leakage-like names and identifiers."""
    gone = {label, target, *drop, *([attack] if attack else [])}
    gone |= {c for c in columns if c.lower().strip().replace(" ", "_") in LEAKAGE_NAMES}
    gone |= set(identifier_columns(columns, patterns))
    return [c for c in columns if c not in gone]


def as_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value) rows with values as text."""
    columns = list(columns or df.columns)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells))


def shape_report(df: DataFrame) -> DataFrame:
    """One row per column: position and type, with the row count."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    fields = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
        for i, f in enumerate(df.schema)
    ])
    return rows.select("rows", F.inline(fields))


def missing_fraction(df: DataFrame, top: int = 30) -> DataFrame:
    fractions = df.agg(*[F.avg(quoted(c).isNull().cast("double")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("missing")) for i, c in enumerate(df.columns)])
    return fractions.select(F.inline(cells)).orderBy(F.desc("missing"), "column").limit(top)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one."""
    return df.groupBy(*[quoted(c) for c in df.columns]).agg((F.count(F.lit(1)) - 1).alias("extra")).agg(
        F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicates")
    )


def distinct_counts(df: DataFrame, top: int = 30, approximate: bool = False) -> DataFrame:
    """Distinct values per column, null counted as one; the ``top`` smallest.

    The exact count first reduces (column, value) pairs map-side, so one column's values are
    spread over all tasks.
    """
    cells = as_text(df)
    if approximate:
        counts = cells.groupBy("column").agg(
            (F.approx_count_distinct("value") + F.max(F.col("value").isNull().cast("long"))).alias("distinct")
        )
    else:
        counts = cells.groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("one").alias("distinct"))
    return counts.orderBy("distinct", "column").limit(top)


def value_distribution(df: DataFrame, column: str, top: int = 100) -> DataFrame:
    return df.groupBy(quoted(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first("value")).limit(top)


def feature_coverage(df: DataFrame) -> DataFrame:
    """Share of columns that have any value."""
    seen = [F.max(quoted(c).isNotNull().cast("int")) for c in df.columns]
    return df.agg((sum(seen[1:], seen[0]) / len(seen)).alias("coverage"))
