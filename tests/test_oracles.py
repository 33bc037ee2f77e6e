"""Registered queries against their SQL. NETWARDEN_ALL=1 runs every query."""

import os

import pytest

import __spark_entry__ as entry
from conftest import SF
from oracle_check import compare, connect

QUICK = """flow_key sessionize session_windows temporal_audit split_chronological leakage_audit partition_iid agent_reputation
score_drift trust_forecast chain_verify weight_grid nonce_replay client_trust_ema alert_enrichment repeat_incidents
sensitive_spans redaction retrieval_top_k semantic_risk trust_decision behaviour_features protected_targets update_validation
trimmed_mean update_ood update_silhouette gate_cascade decision_metrics seed_aggregation pairing_contract class_report
feature_encoding replay_offsets numeric_coercion packet_timestamps stream_sessions stream_reputation stream_chained_log""".split()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("NETWARDEN_ALL") else QUICK)
def test_matches_sql(spark, con, name):
    problem = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


def test_entry(spark):
    assert entry.entry(spark).count() > 0
