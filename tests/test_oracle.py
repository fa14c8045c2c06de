"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from oracle import compare
from pagestrata.plans.catalogue import load

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = load()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables")
    problem = compare(spark, FOLDER, QUERIES[name])
    assert problem is None or (problem == "no rows" and QUERIES[name].sql), problem


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["site", "page_type", "pages"]
