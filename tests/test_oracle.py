"""Every registered query against its DuckDB oracle at sf0.01 (rows-only
where no SQL exists)."""

import pytest

from branchdata.plans.registry import builders, oracles
from conftest import SF01
from tools.compare import compare, duck

NAMES = sorted(builders())


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    info = compare(spark, con, name, builders()[name], oracles().get(name), SF01)
    assert info["ok"] is not False, info
    assert info["rows"] >= 0
