"""Every query with SQL gives the same rows as DuckDB on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare

FOLDERS = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


def test_every_sql_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, name):
    # What is empty on the smaller tables must have rows on the larger.
    for folder in FOLDERS:
        status, note, *_ = compare(spark, folder, name, queries()[name], oracle_sql()[name])
        if status != "EMPTY":
            break
    assert status == "ok", note


def test_entry(spark):
    assert entry(spark).count() > 0
