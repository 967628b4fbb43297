"""Every core query against its SQL in DuckDB."""

import pytest
from compare import rows_of, rows_of_sql

from chronoweave.plans.queries import ORACLE_SQL, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    assert rows_of(QUERIES[name](spark, sf_dir)) == rows_of_sql(duck, ORACLE_SQL[name])


def test_entry_points():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
