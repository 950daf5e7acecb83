"""Queries that SQL can express, against that SQL."""

from __future__ import annotations

import compare
import pytest

from slotledger.llm import queries

ORACLES = queries.oracle_sql()


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, sf, key):
    names, rows = compare.spark_rows(queries.queries()[key](spark, sf))
    assert rows and (names, rows) == compare.sql_rows(compare.connect(sf), ORACLES[key])
