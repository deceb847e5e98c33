"""Registered queries against the DuckDB oracle on the smallest scale factor."""

import pytest

from compare import compare, duck_connection
from conftest import SF_SMALL

import __spark_entry__ as E
from govlens.plans.registry import QUERIES

# A cross-section of every layer; the full set runs at sf0.01 in the driver's check.
KEYS = [
    "null_tokens", "typed_flags", "surrogate_keys", "quarantine", "silver", "check_results",
    "gates_to_next_level", "table_governance", "kpi_summary", "cert_level_summary",
    "pii_classification_summary", "domain_summary", "structural_consistency",
    "structural_summary", "governance_gaps", "asset_access_policy", "asset_access_check",
    "top_gaps_by_domain", "cert_checklist", "measure_structural_rate", "join_profile_governance",
    "q_lowest_scores", "q_access", "q_table_health", "q_why_restricted", "rule_alerts",
    "pipeline_status", "feedback_latest", "feedback_stats", "region_assignment",
    "user_access_summary", "q_tables_missing_steward", "q_table_certification", "rule_ratio",
    "silver_valid", "normalized_strings", "measure_certified_by_domain", "measure_completeness_by_steward",
    "join_profile_governance_declared", "q_cde", "filter_cde", "q_completeness_by_table",
]


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF_SMALL)


def test_registry_complete():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 100
    assert set(o) <= set(q)
    assert set(QUERIES) <= set(o), "every query of the catalog registry has an oracle"


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    r = compare(E.queries()[key](spark, SF_SMALL), duck, E.oracle_sql()[key])
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    row = df.first()
    assert row["total_columns"] == 1718
    assert df.columns[0] == "total_columns"
