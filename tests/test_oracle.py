"""Registered queries against their oracle SQL on the small tables.

TALLYSPARK_ALL=1 runs every query; by default one query per operator family keeps the run short.
"""

import os

import pytest

from compare import compare, oracle_connection
from conftest import SF_SMALL
from tallyspark import catalog

FAST = [
    "rule_share_by_client", "j2_all_rule_matches", "j3_vendor_code_match", "j5_register_payee_then_memo", "j21_model_proposal_gate",
    "c1_rule_cascade", "c7_reapply_run", "g1_amortisation_schedule", "g2_loan_split", "a3_unknown_vendor_codes", "a6_merge_warnings",
    "a9_ledger_duplicates", "a13_rule_base_health", "a15_merge_rules", "j14_coa_keyword_match", "j16_top_k_neighbours",
    "c3_similarity_cascade", "m2_update_rules", "m11_ledger_corrections", "l4_continuation_lines", "l5_block_rows", "l13_transaction_pages",
    "io5_check_register_file", "io9_categorized_csv", "k1_incremental_rule_cascade", "k5_event_validity", "t10_ordered_batches",
]


def names():
    every = list(catalog.load())
    return every if os.environ.get("TALLYSPARK_ALL") else [n for n in every if n in FAST]


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_SMALL)


@pytest.mark.parametrize("name", names())
def test_matches_oracle(spark, con, name):
    result = compare(spark, con, catalog.load()[name], SF_SMALL)
    problems = [p for p in result.get("problems", []) if p != "EMPTY"]
    assert not problems, problems


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
