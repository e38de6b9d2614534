"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracles  # noqa: E402

import __spark_entry__ as e  # noqa: E402
from marketlake.plans.registry import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return check_oracles.connection(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    assert check_oracles.compare(spark, con, sf, name) is None


KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", ["prompt_messages", "uuid_key", "quotes_vendor_b", "recent_trades", "holdings_fold", "rule_contains_join"])
def test_types_agree(spark, con, sf, name):
    want = {r[0]: r[1] for r in con.execute("DESCRIBE " + e.oracle_sql()[name]).fetchall()}
    assert {f.name: KINDS[f.dataType.simpleString()] for f in e.queries()[name](spark, sf).schema} == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert e.entry(spark).count() > 0
