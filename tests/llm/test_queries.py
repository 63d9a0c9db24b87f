"""Registered queries: SQL on the small tables, and tables without rows."""

import pathlib

import pytest

from tests.compare import compare
from triagelake.llm import queries

SMALL = "/root/testdata/sf0.001"
LAW = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    status, note, *_ = compare(spark, SMALL, name, queries.QUERIES[name], queries.ORACLES[name])
    assert status == "ok", note


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    """The tables without rows."""
    folder = tmp_path_factory.mktemp("bare")
    for table in pathlib.Path(SMALL).glob("*.parquet"):
        spark.read.parquet(str(table)).limit(0).write.parquet(str(folder / table.name))
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_tables_without_rows(spark, bare, name):
    assert queries.QUERIES[name](spark, bare).count() == 0


def test_result_of_sharding(spark):
    got = queries.QUERIES["op2_sharding"](spark, SMALL)
    assert got.columns == LAW
    assert got.where("law != 'key' or shard not between 0 and 39 or grown_shard not in (shard, 40)").count() == 0
