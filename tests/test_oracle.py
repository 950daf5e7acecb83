"""Every registered query against its checking SQL on the smallest test data."""

from __future__ import annotations

import compare
import pytest
from places import SF_DIR

import __spark_entry__ as contract

ORACLES = contract.oracle_sql()
QUERIES = {k: q for k, q in contract.queries().items() if k in contract._QUERIES}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_every_query_has_checking_sql():
    assert set(QUERIES) <= set(ORACLES)


TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
         "timestamp": "TIMESTAMP", "date": "DATE"}


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, con, key):
    df = QUERIES[key](spark, SF_DIR)
    types = {c[0]: str(c[1]) for c in con.execute(ORACLES[key]).description}
    assert {name: TYPES[kind] for name, kind in df.dtypes} == types
    names, rows = compare.spark_rows(df)
    wanted_names, wanted = compare.sql_rows(con, ORACLES[key])
    assert names == wanted_names
    assert rows == wanted
    assert rows, "the derived data must give this query something to do"


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
