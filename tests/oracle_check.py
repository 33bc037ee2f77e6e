"""Compare registered queries with their SQL equivalents in DuckDB.

usage: python tests/oracle_check.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    mine_cols, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs_cols, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if mine_cols != theirs_cols:
        return f"columns differ: {mine_cols} vs {theirs_cols}"
    if len(mine) != len(theirs):
        return f"row counts differ: {len(mine)} vs {len(theirs)}"
    if not mine:
        return "empty result"
    different = [(a, b) for a, b in zip(mine, theirs) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if different:
        return f"{len(different)} of {len(mine)} rows differ, first:\n   spark  {different[0][0]}\n   oracle {different[0][1]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from netwarden.session import build_session

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark = build_session("oracle-check")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(fn(spark, sf_dir), con, oracles[name])
            else:
                count = fn(spark, sf_dir).count()
                problem = None if count else "empty result"
        except Exception as error:  # report every query, not only the first failure
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:5.2f}s {kind} {name}" + (f"\n   {problem}" if problem else ""), flush=True)
        bad += problem is not None
    print(f"{bad} failures of {len(queries)} registered")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
