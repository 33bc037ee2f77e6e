"""Order-dependent folds that no window can express (resets, greedy choices, hash chains).

Rows of a key are cut by position into runs of at most ``run_rows``. Round r folds run r
of every key in parallel, starting from the state round r-1 left; a task therefore never
sorts more than one run of a key. A table whose largest key fits in one run takes one
round and no state hand-over. Within a round the sorted rows pass through Python batch by
batch with the state kept between them, so Python holds one Arrow batch whatever a run has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from netwarden.functions.ordered import Blocks, with_rank
from netwarden.session import scratch_folder

RUN_ROWS = 1_000_000

# fn(some next rows of a key, sorted by order, state dict or None) -> (output rows, new state dict)
Fold = Callable[[pd.DataFrame, dict | None], tuple[pd.DataFrame, dict]]


def run_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    blocks: Blocks,
    fold: Fold,
    output: str,
    state: str,
    run_rows: int = RUN_ROWS,
) -> DataFrame:
    """Apply ``fold`` per key in order. ``output``/``state`` are DDL without the keys.

    Key columns are copied to the output; state columns are dropped from the result.
    """
    keys = list(keys)
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keys)
    out_names = [part.split()[0] for part in output.split(",")]
    state_names = [part.split()[0] for part in state.split(",")]
    state_columns = [f"__state_{n}" for n in state_names]
    state_ddl = ", ".join(f"__state_{part.strip()}" for part in state.split(","))
    order = list(order)

    def folded(batches: Iterator[pd.DataFrame], carried: bool, keep: bool) -> Iterator[pd.DataFrame]:
        """Outputs batch by batch; with ``keep``, a row with the state that every key ends with as well."""
        current, left, ended = None, None, []
        for batch in batches:
            for key, rows in batch.groupby(keys, sort=False, dropna=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                if key != current:
                    if current is not None:
                        ended.append((current, left))
                    current, left = key, {n: rows[f"__state_{n}"].iloc[0] for n in state_names} if carried else None
                out, left = fold(rows.drop(columns=state_columns, errors="ignore").reset_index(drop=True), left)
                out = out.assign(**dict(zip(keys, key)))
                yield out[[*keys, *out_names]] if not keep else out[[*keys, *out_names]].assign(__last=False, **dict.fromkeys(state_columns))
            if keep and ended:
                yield closed(ended)
            ended = []
        if keep and current is not None:
            yield closed([(current, left)])

    def closed(ended: list[tuple]) -> pd.DataFrame:
        columns = {k: [key[i] for key, _ in ended] for i, k in enumerate(keys)}
        columns |= {n: [None] * len(ended) for n in out_names} | {"__last": [True] * len(ended)}
        return pd.DataFrame(columns | {f"__state_{n}": [left[n] for _, left in ended] for n in state_names})

    def passed(rows: DataFrame, carried: bool, keep: bool) -> DataFrame:
        schema = f"{key_ddl}, {output}" + (f", __last boolean, {state_ddl}" if keep else "")
        return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(lambda batches: folded(batches, carried, keep), schema)

    if blocks.rows <= run_rows:
        return passed(df, carried=False, keep=False)

    # Rows by run in folders of their own: a round reads its run and the states of the round before, nothing else.
    folder = scratch_folder(df.sparkSession, "fold")
    read = df.sparkSession.read.parquet
    ranked = with_rank(df, keys, order, blocks, "__rn").withColumn("__run", F.floor((F.col("__rn") - 1) / run_rows)).drop("__rn")
    ranked.repartition("__run", *keys).write.partitionBy("__run").parquet(f"{folder}/rows")
    rounds = (read(f"{folder}/rows").agg(F.max("__run")).first()[0] or 0) + 1
    for r in range(rounds):
        rows = read(f"{folder}/rows").filter(F.col("__run") == r).drop("__run")
        if r > 0:
            states = read(f"{folder}/done/round={r - 1}").filter("__last").select(*[F.col(k).alias(f"__of_{i}") for i, k in enumerate(keys)], *state_columns)
            same = [rows[k].eqNullSafe(states[f"__of_{i}"]) for i, k in enumerate(keys)]
            rows = rows.join(states, same, "left").select(*rows.columns, *state_columns)
        passed(rows, carried=r > 0, keep=True).write.parquet(f"{folder}/done/round={r}")
    return read(f"{folder}/done").filter("NOT __last").select(*keys, *out_names)
