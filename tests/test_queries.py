"""Every registered query against its SQL, and the shape of the registry."""

import pytest

import __spark_entry__ as entry
from tests.compare import connection, rows

QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = sorted(n for n in SQL if not n.startswith("op") or not n[2].isdigit())


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, sf_dir, con, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.sql(SQL[name]).df()
    assert rows(got) == rows(want)


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_multi_fetch_numbers_the_request_over_all_projects(spark, sf_dir):
    got = [(r.position, r.org, r.project, r.id) for r in QUERIES["multi_fetch"](spark, sf_dir).collect()]
    assert sorted(got) == [(n, *key) for n, key in enumerate(sorted(r[1:] for r in got), 1)]
