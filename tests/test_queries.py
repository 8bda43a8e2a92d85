"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry

from .oracle import assert_same, connection

QUERIES, SQL = entry.queries(), entry.oracle_sql()
CORE = sorted(k for k in QUERIES if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", [k for k in CORE if k in SQL])
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert_same(duck, QUERIES[name](spark, sf_dir), SQL[name])


@pytest.mark.parametrize("name", [k for k in CORE if k not in SQL])
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
