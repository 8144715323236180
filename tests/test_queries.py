"""Every registered query runs at the smallest scale and equals its SQL."""
import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


#: Queries whose answer is empty at this scale; any other must return rows.
EMPTY_HERE = {"brands_with_many_products", "duplicates_of_active", "canonical_siblings", "gap_no_description", "registry_refusals", "obvious_bad_rows",
              "pending_brands"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df, sql = entry.queries()[name](spark, SF), entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert compare(df, sql, duck) == ("EMPTY" if name in EMPTY_HERE else None)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
