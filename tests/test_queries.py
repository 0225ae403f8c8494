"""Every registered query against DuckDB on the smallest tables."""

import os
import re
import sys

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402

import __spark_entry__ as spark_entry  # noqa: E402

NAMES = sorted(spark_entry.queries())
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables are not here")


@pytest.fixture(scope="module")
def connection():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, connection, name):
    good, text = check.check(spark, connection, SF_DIR, name)
    assert good, text


def test_entry(spark):
    assert spark_entry.entry(spark).columns == ["product_id", "reviews", "avg_rating"]


def test_every_query_has_a_check_or_is_known_to_have_none():
    assert set(spark_entry.oracle_sql()) <= set(NAMES)
    without = {name for name in set(NAMES) - set(spark_entry.oracle_sql()) if not re.match(r"op\d+_|pipeline$", name)}
    assert not without
