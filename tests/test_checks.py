"""Registered queries against their SQL on the small tables; all of them with ALL_CHECKS=1, else a sample of each kind."""

import os

import pytest
from comparing import database, difference

from wattledger.plans.queries import CHECKS, QUERIES

SAMPLE = [
    "category_table_b3", "a4_table", "matrix_by_unit", "audit_page_trail", "audit_join", "summary_kpis", "municipality_profile",
    "item_measures", "rule_finalize", "standardize_contract", "quality_summary", "municipal_sizing", "infer_tariffs",
    "scenario_sheet_totals", "dedupe_by_content", "text_ascii_upper", "extract_single_layout", "extract_history", "quality_all_zero",
    "quality_missing_months", "run_history", "layout_of_documents", "build_master",
]
NAMES = sorted(CHECKS) if os.environ.get("ALL_CHECKS") else SAMPLE


@pytest.fixture(scope="module")
def con(folder):
    return database(folder)


def test_every_query_is_named_like_its_check():
    assert set(CHECKS) <= set(QUERIES) and len(QUERIES) >= 100


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, folder, con, name):
    assert difference(QUERIES[name](spark, folder), con, CHECKS[name]) == ""
