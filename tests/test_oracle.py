"""Every query with SQL gives the SQL's rows; the others run and have a stable schema."""

import pytest

from tests.support import SMALL, duck, sparked
from textloom.plans import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_equal_sql(spark, name):
    assert sparked(QUERIES[name](spark, SMALL)) == duck(ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
