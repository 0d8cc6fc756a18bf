"""Every registered query beside its SQL twin."""

import pytest

import __spark_entry__ as entry
from srcgauge import catalog
from tests.oracle_check import compare

@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, sf_dir, name):
    query, sql = entry.queries()[name], entry.oracle_sql()[name]
    assert compare(spark, con, query, sql, sf_dir) == ""


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["file_id", "filename", "language"]


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
