"""Registered queries: columns of the contracts, and the SQL where there is one."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import difference, oracle_connection
from mailstrata.llm.oracles import ORACLES
from mailstrata.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, oracle_connection(SF), SF, name) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert name in entry.queries()
    assert QUERIES[name](spark, SF).count() > 0
