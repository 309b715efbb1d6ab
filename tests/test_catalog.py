"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connection, differences

from __spark_entry__ import entry, oracle_sql, queries
from checks.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
# ``python tests/compare.py`` runs every query at the next size.
CHOSEN = [
    "parse_timestamp",
    "calendar_columns",
    "tie_break_sliced",
    "remove_types",
    "detect_timezones",
    "tz_mode2",
    "codebook_dedup_last",
    "codebook_duplicates",
    "merge_unexpected_labels",
    "category_top10",
    "resolve_stop_minimal",
    "resolve_stop_filtered",
    "valid_sessions_ties",
    "first_engagement",
    "device_model",
    "unit_report",
    "preprocess_full",
    "preprocess_full_sliced",
    "daily_usage_segments",
    "gap_segments",
    "write_roundtrip",
    "categorised_roundtrip",
    "scan_raw_mixed",
    "quarantine_ragged",
    "rerun_changed_units",
]


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, con, name):
    assert differences(spark, con, FOLDER, queries()[name], oracle_sql()[name]) == []


def test_one_unit_exchange_and_pruned_scan(spark):
    df = queries()["usage_flags"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # The log is shuffled once, by unit; "value" is not read.
    assert plan.count("Exchange hashpartitioning(participant_id") == 1
    assert "value#" not in plan
