"""The registered queries against their SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import check_oracles  # noqa: E402

from marketlake.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return check_oracles.connection(sf)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, con, sf, name):
    assert check_oracles.compare(spark, con, sf, name) is None


@pytest.mark.parametrize("number", range(1, 14))
def test_every_operator_has_its_query(number):
    assert sum(name.startswith(f"op{number}_") for name in QUERIES) == 1
