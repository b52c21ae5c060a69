"""Every key with SQL against DuckDB on the same tables."""

import pytest

import __spark_entry__ as E
from pricelab.plans.keys import ALL_KEYS
from pricelab.testing import compare, duck_connection

from conftest import SF_SMALL

#: The corpus queries (present only with their files) are tested in tests/llm.
ORACLE_KEYS = sorted(set(E.oracle_sql()) & set(ALL_KEYS))


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


def test_every_key_is_registered():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


@pytest.mark.parametrize("key", ORACLE_KEYS)
def test_key_matches_oracle(spark, con, key):
    problems = compare(E.queries()[key](spark, SF_SMALL), con.sql(E.oracle_sql()[key]))
    assert not problems, problems


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["month", "avg_price", "n"]
    assert df.count() == 12


def test_every_key_of_the_inventory_has_sql():
    assert set(ALL_KEYS) <= set(E.oracle_sql())
