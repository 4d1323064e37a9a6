"""Every registered query on the smallest scale, next to its SQL where there is one."""

import pytest

import __spark_entry__ as entry
import check_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return check_queries.connect(SF)


def test_entry_is_lazy_and_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in SQL:
        verdict = check_queries.compare(got, duck.execute(SQL[name]).df())
        assert verdict.startswith("ok"), verdict
    else:
        assert len(got) > 0
