"""Every query with SQL has the SQL's rows, and the others have rows, on the smallest tables."""

import pytest

from creditflow.jobs.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(name, spark):
    assert QUERIES[name](spark, SF).count() > 0
