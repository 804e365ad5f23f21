"""Every registered query against its SQL on the smallest scale factor."""

from __future__ import annotations

import os

import pytest
from compare import difference, oracle_connection

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, SF_DIR, name) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["registered_domain", "code", "pages", "urls"] and df.count() > 0


def test_documents_cover_every_message(spark):
    docs = entry.queries()["message_documents"](spark, SF_DIR)
    assert docs.count() == spark.read.parquet(f"{SF_DIR}/pages.parquet").count()
