import pytest

from lectern.plans import catalog
from tests.oracle import rows_of, sql_rows

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    names, rows = rows_of(QUERIES[name](spark, sf_dir))
    assert names
    if name in ORACLE:
        assert (names, rows) == sql_rows(ORACLE[name], sf_dir)
    else:
        assert rows


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
