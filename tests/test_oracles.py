"""Registered queries beside their SQL. All keys with CHECK_ALL=1, else one or two of each kind."""

import os

import pytest

from checks.catalog import QUERIES
from checks.compare import compare, database
from checks.oracles import ORACLES

SOME = [
    "screen_full", "screen_results", "screen_document", "best_alias", "trigram_similarity", "repo_name_search_bulk", "repo_document_search",
    "feature_pivot", "un_names", "token_search", "normalize_name", "name_script", "validate_requests", "security_events", "report_validation",
    "constraint_violations", "fk_orphans", "entity_nested", "request_nested", "screening_stats", "query_stats", "latency_quantile", "entity_rollup",
    "list_by_source", "hash_history", "dedup_requests", "apply_updates", "upsert_insert", "list_diff", "cascade_delete", "source_status",
    "audit_search", "audit_changes", "request_pairs", "error_rate_5m", "p95_5m",
]
KEYS = sorted(ORACLES) if os.environ.get("CHECK_ALL") else SOME


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("key", KEYS)
def test_equal_to_sql(spark, con, sf_dir, key):
    assert compare(spark, con, key, sf_dir, QUERIES, ORACLES) == ""
