"""Registry of runnable queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from netwarden import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Access to driver and domain tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)


def query(name: str, tables: str = "", sql: str | None = None):
    """Register ``fn(Tables) -> DataFrame``; ``sql`` is the oracle over ``tables``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = partial(_run, fn)
        if sql is not None:
            ORACLES[name] = fixtures.oracle(tables, sql)
        return fn

    return register


def _run(fn, spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn(Tables(spark, sf_dir))
