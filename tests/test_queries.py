"""Some registered queries against their SQL at the smallest size; ``python -m tests.oracle SF_DIR`` runs them all."""

import pytest

import __spark_entry__ as entry

from .oracle import compare, database

SF = "/root/testdata/sf0.001"
NAMES = ["daily_ic", "topk_portfolio", "op_corr", "op_pct_rank", "base_fields_trend", "realistic_exit", "interval_asof", "style_residual", "placebo_shuffle", "lineage_validation", "p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p5_profile", "p6_found"]


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    said = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert said.startswith("ok"), said


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
