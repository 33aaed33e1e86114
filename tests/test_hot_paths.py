"""Registered queries with the hot-group paths forced on (every branch with
at least 5 changes counts as hot): results still equal the DuckDB oracle."""

import pytest

from branchdata.plans.registry import builders, oracles
from conftest import SF01
from tools.compare import compare, duck

HOT_KEYS = ["assign_sequence", "record_changes", "clone_history", "conflict_check", "merge_theirs",
            "parent_ahead", "branch_divergence", "chunk_plan", "change_log", "conflict_check_parent", "column_lineage"]


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.fixture
def hot(spark):
    spark.conf.set("branchdata.hotGroupRows", "5")
    yield
    spark.conf.unset("branchdata.hotGroupRows")


@pytest.mark.parametrize("name", HOT_KEYS)
def test_hot_path_matches_oracle(spark, con, hot, name):
    info = compare(spark, con, name, builders()[name], oracles()[name], SF01)
    assert info["ok"], info
