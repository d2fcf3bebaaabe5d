"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest
from conftest import same

from millrace.plans import catalog
from millrace.shipping import ship

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(name, spark, small, duck):
    ship(spark)
    same(catalog.queries()[name](spark, small), duck.sql(SQL[name]))


def test_every_sql_has_its_query():
    assert set(SQL) <= set(catalog.queries())
