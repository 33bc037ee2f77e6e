"""Registered queries, grouped by subject."""

import importlib

MODULES = ["flow_queries", "audit_queries", "alert_queries", "trust_queries", "update_queries", "evaluation_queries", "table_queries", "stream_queries"]


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"netwarden.plans.{module}")
